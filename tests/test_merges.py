"""The log of merges and a live table that is merged and undone step by step agree at every step."""

import random

from quern.operators import entities as E
from quern.operators import merges as G
from quern.sources.store import saved

LOG = "seq long, kind string, merge_id long, source long, target long"
MENTIONS = "entity_id long, page_id long, surface_form string, char_start long"


def rows(df):
    return sorted((tuple(r) for r in df.select("entity_id", "page_id", "surface_form", "char_start").collect()), key=repr)


def test_replay_equals_the_live_table_and_undo_gives_back_the_first(spark):
    rng = random.Random(4)
    first = sorted({(rng.randrange(1, 6), rng.randrange(8), rng.choice("xy"), rng.choice([0, 1, None])) for _ in range(60)}, key=repr)
    base = spark.createDataFrame(first, MENTIONS)
    steps = [("merge", 1, 5, 4), ("merge", 2, 4, 2), ("merge", 3, 3, 1), ("undo", 2, None, None), ("merge", 4, 4, 1), ("undo", 4, None, None), ("undo", 1, None, None), ("undo", 3, None, None)]
    log = spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], LOG)
    assert G.problems(log).count() == 0
    save, live, snapshots = saved(spark), base, {}
    for i, (kind, merge, source, target) in enumerate(steps):
        if kind == "merge":
            live, snapshot = G.merged(live, source, target)
            snapshots[merge] = (save(snapshot), source, target)
        else:
            live = E.undo_merge(live, *snapshots[merge])
        live = save(live)
        assert rows(G.mentions_at(base, log, save, i)) == rows(live)
    assert rows(live) == rows(base)


def test_steps_that_can_not_be(spark):
    steps = [
        (1, "merge", 1, 1, 1),
        (2, "merge", 2, 3, 2),
        (3, "merge", 3, 3, 4),  # 3 has been merged
        (4, "merge", 4, 5, 3),  # into what has been merged
        (5, "merge", 5, 2, 6),
        (6, "undo", 2, None, None),  # 2 has been merged since
        (7, "undo", 5, None, None),
        (8, "undo", 5, None, None),
        (9, "undo", 99, None, None),
        (10, "merge", 6, 2, 7),  # undone, so it may be merged again
    ]
    found = {tuple(r) for r in G.problems(spark.createDataFrame(steps, LOG)).collect()}
    assert found == {(1, "same"), (3, "merged"), (4, "merged"), (6, "not the last"), (8, "undone"), (9, "no merge")}
