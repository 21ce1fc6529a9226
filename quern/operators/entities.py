"""Entities: blocking, pairs within blocks, components, merges and their undoing, counts, idf, canonical forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import edit_distance
from quern.operators.retrieval import ranked

#: Entries of an entity that its queries meet at once.
BLOCK = 128


def duplicate_blocks(aliases: DataFrame) -> DataFrame:
    """Blocks (type, block_key) of more than one entity, with their sorted ids."""
    b = aliases.groupBy("type", "block_key").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    return b.where(F.size("ids") > 1).select("type", "block_key", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("entity_ids"))


def close_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """(a, b, distance): pairs of one block, a < b, whose forms are within the edit distance.

    Lengths bound the distance from below, so only forms of near lengths are paired, by an equal-key join on length bands.
    """
    e = entities.select("type", "block_key", "entity_id", "form", F.length("form").alias("n"))
    widest = F.floor(F.col("n") / (1 - threshold) + 1e-9).cast("int")
    left = e.select("type", "block_key", F.col("entity_id").alias("a"), F.col("form").alias("fa"), F.col("n").alias("na"), F.explode(F.sequence("n", widest)).alias("m"))
    right = e.select("type", "block_key", F.col("entity_id").alias("b"), F.col("form").alias("fb"), F.col("n").alias("m"))
    pairs = left.join(right, ["type", "block_key", "m"]).where((F.col("a") != F.col("b")) & ((F.col("na") < F.col("m")) | (F.col("a") < F.col("b"))))
    d = edit_distance(F.col("fa"), F.col("fb"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(d, 6).alias("distance")).where(F.col("distance") <= threshold)


def components(edges: DataFrame, nodes: DataFrame, save) -> DataFrame:
    """(entity_id, component) by spreading the least id until nothing changes; `save` writes a table and reads it back.

    Each round also jumps to the label's own label, so that long chains take few rounds.
    """
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(nodes.select("entity_id", F.col("entity_id").alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"entity_id": "b", "component": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "entity_id"), "entity_id", "left").select("entity_id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        roots = spread.select(F.col("entity_id").alias("component"), F.col("component").alias("root"))
        after = save(spread.join(roots, "component", "left").select("entity_id", F.least("component", "root").alias("component"), "was"))
        labels = after.select("entity_id", "component")
        if after.where("component <> was").isEmpty():
            return labels


def merge_plan(members: DataFrame) -> DataFrame:
    """(source, target) for each component: the entity of most mentions, then the least id, survives."""
    best = F.first("entity_id").over(Window.partitionBy("component").orderBy(F.desc("mention_count"), "entity_id"))
    return members.withColumn("target", best).where("entity_id <> target").select(F.col("entity_id").alias("source"), "target")


def apply_merges(mentions: DataFrame, plan: DataFrame) -> DataFrame:
    """Mentions moved to the surviving entities; one that is then there twice is kept once, unless its place is unknown."""
    moved = mentions.join(plan.withColumnRenamed("source", "entity_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("target", "entity_id")).drop("target")
    key = ["entity_id", "page_id", "surface_form", "char_start"]
    placed = moved.where("char_start IS NOT NULL").dropDuplicates(key)
    return placed.unionByName(moved.where("char_start IS NULL"))


def undo_merge(mentions_now: DataFrame, snapshot: DataFrame, source: int, target: int) -> DataFrame:
    """Mentions with those that a merge brought to its target (by its snapshot) back on their source; mentions without a place are counted, as equal ones were all kept."""
    own = snapshot.where(F.col("entity_id") == source)
    key = ["page_id", "surface_form", "char_start"]
    placed = own.where("char_start IS NOT NULL").join(snapshot.where(F.col("entity_id") == target).select(*key), key, "left_anti")
    brought = placed.unionByName(own.where("char_start IS NULL"))
    there = brought.withColumn("entity_id", F.lit(target).cast(mentions_now.schema["entity_id"].dataType))
    return mentions_now.exceptAll(there.select(*mentions_now.columns)).unionByName(own)


def entity_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.count_distinct("page_id").alias("page_count"))


def canonical_forms(mentions: DataFrame) -> DataFrame:
    """Each entity's most frequent surface form, the first in order among equals."""
    n = mentions.groupBy("entity_id", "surface_form").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "surface_form"))
    return n.withColumn("_r", best).where("_r = 1").select("entity_id", F.col("surface_form").alias("canonical_form"))


def idf(mentions: DataFrame, n_pages: DataFrame) -> DataFrame:
    """ln(all pages / pages with the entity); n_pages is a table of one row."""
    return idf_of_counts(entity_counts(mentions), n_pages)


def idf_of_counts(counts: DataFrame, n_pages: DataFrame) -> DataFrame:
    """The same from counts (entity_id, page_count)."""
    return counts.crossJoin(n_pages).select("entity_id", F.round(F.log(F.col("n_pages") / F.col("page_count")), 6).alias("idf"))


def entity_similarity(mentions: DataFrame, weights: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, page_id, score: the share of a page's entity weight that it has in common with the query's page.

    The query page's other entities are not part of the denominator; entities without a weight count 1.
    """
    have = mentions.select("page_id", "entity_id").distinct().join(weights, "entity_id", "left").withColumn("w", F.coalesce("idf", F.lit(1.0)))
    asked = have.join(queries, "page_id", "left_semi").select(F.col("page_id").alias("query_id"), "entity_id")
    shared = have.join(asked, "entity_id").where("page_id <> query_id").groupBy("query_id", "page_id").agg(F.sum("w").alias("shared"))
    total = have.groupBy("page_id").agg(F.sum("w").alias("total"))
    return shared.join(total, "page_id").select("query_id", "page_id", F.round(F.coalesce(F.try_divide("shared", "total"), F.lit(0.0)), 6).alias("score"))


def most_similar(mentions: DataFrame, weights: DataFrame, queries: DataFrame, limit: int, save, *, block: int = BLOCK) -> DataFrame:
    """query_id, page_id, score, rank: the first `limit` pages of each query by entity_similarity, ties by id, without all the pairs.

    A page's entities stand in order of weight, the greatest first. If the first that it shares with a query is the n-th,
    the weight from there on over the page's whole weight bounds its score. What one entity weighs of a page is scored there
    by any query that has it; so each entity's best pages by that give each query a last place (score and page) that its
    answer reaches at least. Only entries (page, entity) whose bound reaches it are met, the best first, `block` of them at a
    time. Pages with a negative weight have no bound and are always met.
    """
    order = Window.partitionBy("page_id").orderBy(F.desc("w"), "entity_id")
    to_here, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = mentions.where("page_id IS NOT NULL AND entity_id IS NOT NULL").join(weights, "entity_id", "left").select("page_id", "entity_id", F.coalesce("idf", F.lit(1.0)).alias("w"))
    once = weighed.withColumn("_last", F.lag("entity_id").over(order)).where("_last IS NULL OR _last <> entity_id").drop("_last")
    summed = once.withColumns({"to_here": F.sum("w").over(to_here), "total": F.sum("w").over(whole), "free": F.min("w").over(whole) < 0})
    # slack, as sums in another order differ in their last digits
    share = lambda w, slack: F.round(F.coalesce(F.try_divide(w, F.col("total")), F.lit(0.0)) + slack, 6)
    bound = F.when(F.col("free"), float("inf")).otherwise(share(F.col("total") - F.col("to_here") + F.col("w"), 1e-9))
    entries = save(summed.select("page_id", "entity_id", "w", bound.alias("bound"), F.when(~F.col("free"), share(F.col("w"), -1e-9)).alias("least")))
    own = save(entries.join(queries.select("page_id").distinct(), "page_id", "left_semi").select(F.col("page_id").alias("query_id"), "entity_id"))

    # one more than the limit, as the query's own page may be among them
    by_least = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("least"), "page_id"))
    best = save(entries.where("least IS NOT NULL").select("entity_id", "page_id", "least", by_least.alias("_r")).where(F.col("_r") <= limit + 1).drop("_r"))
    sure = own.join(best, "entity_id").where("page_id <> query_id").groupBy("query_id", "page_id").agg(F.max("least").alias("least"))
    last = ranked(sure, ["query_id"], "least", "page_id", limit).where(F.col("rank") == limit).select("query_id", F.col("least").alias("reached"), F.col("page_id").alias("last"))
    has = own.groupBy("query_id").agg(F.collect_list("entity_id").alias("has")).join(last, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(float("-inf"))))
    asked = save(has.select("*", F.explode("has").alias("entity_id")))
    reaches = lambda score, page: (F.col(score) > F.col("reached")) | ((F.col(score) == F.col("reached")) & (F.col(page) <= F.col("last")))

    lowest = F.max(F.struct((-F.col("reached")).alias("minus"), "last"))
    widest = save(asked.groupBy("entity_id").agg(lowest.alias("x")).select("entity_id", (-F.col("x.minus")).alias("reached"), F.col("x.last").alias("last")))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("bound"), "page_id"))
    near = save(entries.join(widest, "entity_id").where(reaches("bound", "page_id")).select("entity_id", "page_id", "bound", F.floor((place - 1) / block).alias("block")))
    items = entries.join(near.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("minus"), "entity_id"))).alias("items"))
    heads = near.groupBy("entity_id", "block").agg(F.min(F.struct((-F.col("bound")).alias("minus"), "page_id")).alias("x")).select("entity_id", "block", (-F.col("x.minus")).alias("bound"), F.col("x.page_id").alias("page_id"))
    visits = asked.join(heads, "entity_id").where(reaches("bound", "page_id")).drop("bound", "page_id")
    met = visits.join(near.join(items, "page_id"), ["entity_id", "block"]).where(reaches("bound", "page_id") & (F.col("page_id") != F.col("query_id")))
    # a pair counts where its first common entity is met
    common = F.filter("items", lambda x: F.array_contains("has", x["entity_id"]))
    weight = lambda items: F.aggregate(items, F.lit(0.0), lambda s, x: s - x["minus"])
    pairs = met.withColumn("common", common).where(F.col("common")[0]["entity_id"] == F.col("entity_id"))
    scored = pairs.select("query_id", "page_id", "reached", "last", F.round(F.coalesce(F.try_divide(weight("common"), weight("items")), F.lit(0.0)), 6).alias("score"))
    return ranked(scored.where(reaches("score", "page_id")).select("query_id", "page_id", "score"), ["query_id"], "score", "page_id", limit)


def link_to_known(forms: DataFrame, entities: DataFrame, *, edit: float = 0.15, cosine: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """(type, form, entity_id) for forms (type, block_key, form) that known entities (type, block_key, entity_id, form) are near.

    An equal form first; else the first entity of the block within the edit distance; else the one of the greatest
    cosine of `least` or more, for pairs (type, form, other, cosine) that are given. A form that none is near is left out.
    """
    key = ["type", "block_key"]
    f = forms.select(*key, "form").distinct()
    pairs = f.join(entities.select(*key, "entity_id", F.col("form").alias("other")), key)
    near = edit_distance(F.col("form"), F.col("other"))
    scored = pairs.withColumn("cosine", F.lit(None).cast("double")) if cosine is None else pairs.join(cosine, ["type", "form", "other"], "left")
    arm = F.when(F.col("form") == F.col("other"), 0).when(near <= edit, 1).when(F.col("cosine") >= least, 2)
    order = Window.partitionBy("type", "form").orderBy("arm", F.when(F.col("arm") == 2, -F.col("cosine")).otherwise(0.0), "entity_id")
    return scored.withColumn("arm", arm).where("arm IS NOT NULL").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("type", "form", "entity_id")


def undoable(merges: DataFrame) -> DataFrame:
    """(merge_id, undoable) of merges (merge_id, source, target, merged_at, undone_at): not undone, and no later merge that stands touches the target."""
    standing = merges.where("undone_at IS NULL")
    touched = standing.select(F.explode(F.array("source", "target")).alias("target"), F.col("merged_at").alias("later"))
    last = touched.groupBy("target").agg(F.max("later").alias("last"))
    return merges.join(last, "target", "left").select("merge_id", (F.col("undone_at").isNull() & (F.col("last") <= F.col("merged_at"))).alias("undoable"))


def link_greedily(surfaces: DataFrame, save, threshold: float = 0.15) -> DataFrame:
    """(block_key, form, linked): forms in the order (first_seen, form); each joins the first earlier form within the edit distance that is no link itself, or is new.

    The order is kept by rounds: a form whose earlier near forms are all links is new, one that has a new one among them is
    a link. Near forms come from a join on the block and on lengths, so no block is one task's.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold is a share below 1")
    first = surfaces.groupBy("block_key", "form").agg(F.min("first_seen").alias("at")).withColumn("n", F.length("form"))
    e = save(first)
    widest = F.floor(F.col("n") / (1 - threshold) + 1e-9).cast("int")
    one = e.select("block_key", F.struct("at", "form").alias("x"), F.explode(F.sequence("n", widest)).alias("m"))
    other = e.select("block_key", F.struct("at", "form").alias("y"), F.col("n").alias("m"))
    near = one.join(other, ["block_key", "m"]).where((F.col("x") != F.col("y")) & (edit_distance(F.col("x.form"), F.col("y.form")) <= threshold))
    edges = save(near.select("block_key", F.least("x", "y").alias("before"), F.greatest("x", "y").alias("after")).distinct())
    left = save(e.select("block_key", F.struct("at", "form").alias("node")))
    new = None
    while not left.isEmpty():
        # earlier near forms that may still turn out new, or are new
        open_ = edges.join(left.withColumnRenamed("node", "before"), ["block_key", "before"], "left_semi").select("block_key", F.col("after").alias("node")).distinct()
        linked = None if new is None else edges.join(new.withColumnRenamed("node", "before"), ["block_key", "before"], "left_semi").select("block_key", F.col("after").alias("node")).distinct()
        free = left if linked is None else left.join(linked, ["block_key", "node"], "left_anti")
        now = save(free.join(open_, ["block_key", "node"], "left_anti"))
        new = now if new is None else save(new.unionByName(now))
        done = edges.join(new.withColumnRenamed("node", "before"), ["block_key", "before"], "left_semi").select("block_key", F.col("after").alias("node")).distinct()
        left = save(left.join(now, ["block_key", "node"], "left_anti").join(done, ["block_key", "node"], "left_anti"))
    heads = edges if new is None else edges.join(new.withColumnRenamed("node", "before"), ["block_key", "before"], "left_semi")
    best = heads.groupBy("block_key", F.col("after.form").alias("form")).agg(F.min("before").alias("b"))
    return e.select("block_key", "form").join(best, ["block_key", "form"], "left").select("block_key", "form", F.coalesce("b.form", "form").alias("linked"))
