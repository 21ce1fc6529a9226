"""Tokenisation with a public vocabulary, and token ids stored as directly addressable codes.

A text's ids are the ids of its blank-separated pieces one after the other: no token of this kind of vocabulary spans white
space, and neither NFC nor lower-casing looks across it. So every distinct piece goes through the tokenizers library
once, and a text is put together from the pieces' ids. A vocabulary with another chain of steps gets whole texts.

The file format ("DAC1", one segment a record): ids are cut into 8-bit chunks, lowest first. Level k holds the chunk k of
every id that has one, in order; its bitmap says which of them go on in level k+1, and its rank directory holds the
number of set bits before each block of 512. The place of an id's chunk in the next level is the rank of its bit, so any
id is read in a few steps, with no block decoded. Segments are stored uncompressed; `tokens_at` looks up the ids at any
places of a set of files.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, shared_dir, text_bytes

CHUNK_BITS = 8
RANK_BLOCK = 512
MAGIC = b"DAC1"
#: Places of a cell of the grid by which places find their segments, as a power of two.
CELL = 20
#: Pieces kept by a Python worker; a bound on its memory, the cache starts anew beyond it.
CACHE_PIECES = 450_000


#: Lower-case words for which NFC, lower-casing and the split before the merges change nothing.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: The steps before the merges for which texts may be encoded piece by piece.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_at_blanks(settings: dict) -> bool:
    """Whether a tokenizer's steps are those known to treat blank-separated pieces apart."""
    model = settings.get("model") or {}
    steps = settings.get("normalizer") == {"type": "Sequence", "normalizers": NORMALIZERS} and settings.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    # an added token is matched before the other steps, and might span a blank
    added = all(not re.search(r"\s", t["content"]) for t in settings.get("added_tokens") or [])
    return steps and added and model.get("type", "BPE") == "BPE" and not model.get("dropout") and settings.get("post_processor") is None


class Encoder:
    """Texts to the little-endian unsigned 32-bit ids of a tokenizers vocabulary."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.by_piece = splits_at_blanks(json.loads(self.tokenizer.to_str()))
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: x for b, x in enumerate(byte_letters()) if b >= 128}
        self.cache: dict[bytes, bytes] = {}
        # the library looks for these in the text as it is, before it lowers letters
        added = sorted(t["content"].encode().lower() for t in json.loads(self.tokenizer.to_str()).get("added_tokens") or [])
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def pieces(self, text: bytes) -> list[bytes]:
        """Blank-separated pieces, A-Z lowered but in those that hold an added token in any case form."""
        low = text.lower()
        if self.added is None or not self.added.search(low):
            return low.split()
        return [piece if self.added.search(small) else small for piece in text.split() for small in (piece.lower(),)]

    def whole(self, pieces: list[str]) -> list[bytes]:
        """Any texts, by the library's whole chain."""
        return [struct.pack(f"<{len(ids)}I", *ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False) for ids in (e.ids,)]

    def learn(self, new: list[bytes]) -> None:
        """Ids of new pieces. A plain word goes straight to the library's merges; signs after one are a run of their own to the vocabulary's split."""
        cache, rest = self.cache, []
        for piece in new:
            stem = piece.rstrip(SIGNS)
            word = stem.decode()
            if not PLAIN.fullmatch(word):
                rest.append(piece)
                continue
            ids = cache.get(stem)
            if ids is None:
                if not stem.isascii():
                    word = stem.decode("latin-1").translate(self.letters)
                found = [t.id for t in self.merge(word)]
                ids = cache[stem] = struct.pack(f"<{len(found)}I", *found)
            if stem != piece:
                signs = piece[len(stem) :]
                if signs not in cache:
                    cache[signs] = self.whole([signs.decode()])[0]
                cache[piece] = ids + cache[signs]
        cache.update(zip(rest, self.whole([p.decode() for p in rest])))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        cache = self.cache
        if not self.by_piece:
            for at in range(0, len(texts), 64):
                yield from self.whole([t.decode() for t in texts[at : at + 64]])
            return
        for at in range(0, len(texts), 256):
            pieces = [self.pieces(t) for t in texts[at : at + 256]]
            new = set().union(*pieces).difference(cache)
            if len(cache) + len(new) > CACHE_PIECES:
                cache.clear()
                new = set().union(*pieces)
            self.learn(list(new))
            get = cache.__getitem__
            for p in pieces:
                yield b"".join(map(get, p))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each Python worker and vocabulary; its cache serves all batches of the worker."""
    if vocabulary not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def dac_encode(ids: np.ndarray) -> bytes:
    """A segment's payload: its levels, each as chunks, continuation bitmap and rank directory."""
    left = np.asarray(ids, dtype=np.uint64)
    levels = []
    while True:
        chunks = (left & 0xFF).astype(np.uint8)
        left = left >> CHUNK_BITS
        more = left > 0
        bits = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK)) if len(more) else np.zeros(0, int)
        ranks = (np.cumsum(sums) - sums).astype("<u4") if len(more) else np.zeros(0, "<u4")
        levels.append(struct.pack("<III", len(chunks), len(bits), len(ranks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        left = left[more]
        if not len(left):
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class DacReader:
    """Random access to the ids of one segment, without a copy of it."""

    def __init__(self, payload):
        payload = memoryview(payload)
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC1 segment")
        (n,) = struct.unpack_from("<I", payload, 4)
        at, self.levels = 8, []
        for _ in range(n):
            a, b, c = struct.unpack_from("<III", payload, at)
            at += 12
            self.levels.append((np.frombuffer(payload, np.uint8, a, at), np.frombuffer(payload, np.uint8, b, at + a), np.frombuffer(payload, "<u4", c, at + a + b)))
            at += a + b + 4 * c

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place i, by rank alone."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            first = block * RANK_BLOCK >> 3
            before = int.from_bytes(bits[first : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * RANK_BLOCK)) - 1)
            i = int(ranks[block]) + before.bit_count()
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop."""
        out, places = None, np.zeros(0, int)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            own = chunks[start:stop].astype("<u4") << np.uint32(CHUNK_BITS * k)
            if out is None:
                out, places = own, np.arange(len(own))
            else:
                out[places] |= own
            first = start // RANK_BLOCK * RANK_BLOCK
            more = np.unpackbits(bits[first >> 3 : (stop + 7) >> 3], bitorder="little")[: stop - first]
            base = int(ranks[start // RANK_BLOCK]) if start < stop else 0
            here = more[start - first :].astype(bool)
            start = base + int(more[: start - first].sum())
            stop = start + int(here.sum())
            places = places[here]
            if start == stop:
                break
        return out


SEGMENT_SCHEMA = "part int, segment int, start_in_part long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def _writer(vocabulary: str, end_id: int, segment_tokens: int):
    def write(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(vocabulary), struct.pack("<I", end_id)
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        docs, lengths, data, held, before, segment = [], [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, segment, before, held, docs, lengths, dac_encode(ids)), schema)], schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(text_bytes(batch.column(1)))):
                data.append(ids + end)
                docs.append(doc)
                lengths.append(len(ids) // 4 + 1)
                held += lengths[-1]
                if held >= segment_tokens:
                    yield flush()
                    before, segment = before + held, segment + 1
                    docs, lengths, data, held = [], [], [], 0
        if docs:
            yield flush()

    return write


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1_000_000, partitions: int | None = None) -> None:
    """Encode every whole text and write the ids in ascending order of id_col as DAC1 segments below path.

    The segments go through Spark's committer as the binary field of Parquet files, one or more for each range of ids: a
    lost or repeated task leaves no partial file, and any store that Spark writes to will do. Null texts count as empty
    and give the end id alone; documents with a null id come first; equal ids stay beside each other, in order of a hash
    of their texts, and may be dealt to several tasks; no documents, no segments. Segments are not compressed, so that a
    place's bytes lie in the file as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        # the scan's partition tells apart rows of one id and text, so that no range must hold them all
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.spark_partition_id().alias("p"))
        .repartitionByRange(n, "doc_id", "h", "p")
        .sortWithinPartitions("doc_id", "h", "p")
        .mapInArrow(_writer(vocabulary, end_id, segment_tokens), SEGMENT_SCHEMA)
        .write.mode("overwrite")
        .option("compression", "none")
        .parquet(path)
    )


def _reader(batches):
    for batch in batches:
        for row in batch.to_pylist():
            reader, at = DacReader(row["payload"]), 0
            ids = reader.slice(0, len(reader))
            n = np.array(row["lengths"], dtype=np.int64)
            starts = np.cumsum(n) - n
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(starts.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(n), pa.int32()), pa.array(starts + row["start_in_part"]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def _firsts(segments: DataFrame) -> DataFrame:
    """(part, first): ids before each part; one row for each written range is summed up in one place."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))


def _lookup(batches):
    for b in batches:
        ids = []
        for payload, at in zip(b.column("payload"), b.column("at").to_pylist()):
            # a view of the batch's buffer: only the bytes on the way to the ids are touched
            reader = DacReader(payload.as_buffer())
            ids.append([reader[i] for i in at])
        yield pa.RecordBatch.from_arrays([b.column("positions"), pa.array(ids, pa.list_(pa.int64()))], names=["positions", "ids"])


def tokens_at(spark, path: str, positions: DataFrame, *, position_col: str = "position") -> DataFrame:
    """(position, token) of the ids at any places of a set of token files, counted from 0 over all documents.

    Places meet their segments by an index of the segments' first places; in a segment each id is read by rank. Places
    beyond either end, and null ones, give no row; a place that is asked for twice gives one.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    index = segments.select("part", "segment", "start_in_part", "n_tokens").join(F.broadcast(_firsts(segments)), "part").select("part", "segment", (F.col("first") + F.col("start_in_part")).alias("first"), "n_tokens")
    asked = positions.select(F.col(position_col).cast("long").alias("position")).distinct().withColumn("cell", F.shiftright("position", CELL))
    # the index has a row for a million ids or so, and lists the cells of a grid that each lies in
    cells = index.withColumn("cell", F.explode(F.sequence(F.shiftright("first", CELL), F.shiftright(F.col("first") + F.col("n_tokens") - 1, CELL))))
    hits = asked.join(cells, "cell").where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_tokens")))
    own = hits.groupBy("part", "segment", F.pmod(F.xxhash64("position"), F.lit(16)).alias("salt")).agg(F.collect_list("position").alias("positions"), F.first("first").alias("first"))
    some = own.join(segments.select("part", "segment", "payload"), ["part", "segment"]).select("payload", "positions", F.transform("positions", lambda p: (p - F.col("first")).cast("long")).alias("at"))
    read = some.mapInArrow(_lookup, "positions array<long>, ids array<long>")
    return read.select(F.explode(F.arrays_zip("positions", "ids")).alias("x")).select(F.col("x.positions").alias("position"), F.col("x.ids").alias("token"))


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of a set of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the parts' totals, one row for each written range, are summed up in one place.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    read = segments.mapInArrow(_reader, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(_firsts(segments)), "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encode_round_trip(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write docs as token files in the shared folder and describe each document from what the files hold."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary=vocabulary or vocabulary_path(), end_id=end_id)
    return read_token_files(docs.sparkSession, path)
