"""Operator 5: token-id files with a minimal-perfect-hash index.

File format: a folder of Parquet rows, one row per shard of consecutive
documents.  A shard holds the raw little-endian ids of its documents one after
another (``payload``), the end of each document in it (``ends``), its keys in
order (``keys``) and an index from a key to its first document: the bit arrays
of a minimal perfect hash (``levels``, ``bits``), and per slot a stored 32-bit
fingerprint of the key and the document's ordinal and count.  A look-up hashes
the key through the levels, takes the slot by rank, compares the fingerprint
and slices the payload; its expected cost doesn't depend on the shard's size.

Order is ascending ``doc_id``.  Null texts are empty (only the end id).  Rows
with a null ``doc_id`` come first, in shards without an index.  Repeated ids
stay, side by side, ordered by text; a look-up returns all of them.  An empty
table gives an empty folder with the schema.  Columns other than the two named
are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordcode import encoder

SHARD = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("first_key", T.LongType()),
        T.StructField("last_key", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("ends", T.BinaryType()),
        T.StructField("levels", T.BinaryType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("prints", T.BinaryType()),
        T.StructField("ordinals", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
ROW = "doc_id long, part int, shard int, start_in_shard long, n_tokens long, ids binary"
#: A look-up ships its keys to every task that holds a shard in their range.
LOOKUP_KEYS = 100_000


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (xor-shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Level by level every key still without a place hashes into a bit array twice
    as long as their number; those alone on their bit stay, the rest go on.  The
    slot of a key is the rank of its bit over all levels."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        flags = np.unpackbits(bits, bitorder="little")[: self.starts[-1]]
        self.flags, self.rank = flags.astype(bool), np.cumsum(flags) - flags

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flags, left = [], [], keys
        while len(left):
            m = 2 * len(left) + 1
            at = (mixed(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            flags.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(flags), bitorder="little") if flags else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), packed)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit (surely not a key)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            hit = self.flags[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def shard_row(part: int, shard: int, keys: list[int | None], blobs: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(b) // width for b in blobs]).astype("<u8")
    row = {
        "part": part, "shard": shard, "first_key": keys[0], "last_key": keys[-1], "n_ids": int(ends[-1]),
        "width": width, "ends": ends.tobytes(), "payload": b"".join(blobs),
    }
    if keys[0] is None:
        return row | dict.fromkeys(("keys", "levels", "bits", "prints", "ordinals", "counts"))
    all_keys = np.array(keys, np.int64)
    distinct, first, count = np.unique(all_keys, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    placed = np.empty((3, len(distinct)), "<u4")
    placed[:, slot] = np.stack([fingerprints(distinct), first.astype("<u4"), count.astype("<u4")])
    return row | {
        "keys": all_keys.astype("<i8").tobytes(), "levels": index.sizes.astype("<i8").tobytes(), "bits": index.bits.tobytes(),
        "prints": placed[0].tobytes(), "ordinals": placed[1].tobytes(), "counts": placed[2].tobytes(),
    }


class Shard:
    """One shard, opened for keyed access."""

    def __init__(self, row: dict):
        self.ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.indexed = row["keys"] is not None
        if self.indexed:
            self.keys = np.frombuffer(row["keys"], "<i8")
            self.index = PerfectHash(np.frombuffer(row["levels"], "<i8"), np.frombuffer(row["bits"], np.uint8))
            self.prints, self.ordinals, self.counts = (np.frombuffer(row[k], "<u4") for k in ("prints", "ordinals", "counts"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ordinal of each key and how many documents bear it (0: none)."""
        slot = self.index.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[ok], count[ok] = self.ordinals[slot[ok]], self.counts[slot[ok]]
        return first, count

    def span(self, ordinal: int) -> tuple[int, int]:
        return (int(self.ends[ordinal - 1]) if ordinal else 0), int(self.ends[ordinal])


def _writer(path: str, keeps_space: bool, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, keeps_space)
        end = np.array([end_id], code.kind).tobytes()
        part, shard, keys, blobs, held = TaskContext.get().partitionId(), 0, [], [], 0
        arrow = T_ARROW()

        def flush():
            return pa.RecordBatch.from_pylist([shard_row(part, shard, keys, blobs, code.width)], arrow)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for key, blob in zip(ids, code.encode(texts), strict=True):
                if keys and (held >= shard_ids or (keys[0] is None) != (key is None)):
                    yield flush()
                    shard, keys, blobs, held = shard + 1, [], [], 0
                keys.append(key)
                blobs.append(blob + end)
                held += len(blobs[-1]) // code.width
        if keys:
            yield flush()

    return write


def T_ARROW() -> pa.Schema:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in SHARD])


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int, keeps_space: bool = True, shard_ids: int = 1 << 20) -> None:
    """Encode the whole texts of ``docs`` and write them to ``path`` in the file format.

    One shuffle, of the texts, by ranges of ``doc_id``; a task encodes its range
    and writes it.  A shard closes once it holds ``shard_ids`` ids, so it is as
    large as that or as one document."""
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_writer(tokenizer, keeps_space, end_id, shard_ids), SHARD).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard, doc_ids, ordinals = Shard(row), [], []
            if not shard.indexed:
                if wanted is None:
                    doc_ids, ordinals = [None] * len(shard.ends), list(range(len(shard.ends)))
            else:
                keys = np.unique(shard.keys) if wanted is None else wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                for key, first, count in zip(keys.tolist(), *(x.tolist() for x in shard.find(keys)), strict=True):
                    if count and shard.keys[first] == key:
                        doc_ids += [key] * count
                        ordinals += range(first, first + count)
            spans = [shard.span(k) for k in ordinals]
            wide = [shard.payload[a:b].astype("<u4").tobytes() for a, b in spans]
            n = len(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                    pa.array([a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(wide, pa.binary()),
                ],
                ["doc_id", "part", "shard", "start_in_shard", "n_tokens", "ids"],
            )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a written corpus, each found through its shard's index:
    doc_id, part, shard, start_in_shard, n_tokens, ids (little-endian u32)."""
    return spark.read.schema(SHARD).parquet(path).mapInArrow(_read, ROW)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The documents with the given keys.  Parquet statistics skip shards out of
    the keys' range; at most ``LOOKUP_KEYS`` keys a call, more is an error (use
    ``read_corpus`` and a join)."""
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"lookup takes at most {LOOKUP_KEYS} keys a call")
    wanted = np.unique(np.array(keys, np.int64))
    shards = spark.read.schema(SHARD).parquet(path)
    if len(wanted):
        shards = shards.filter((F.col("last_key") >= int(wanted[0])) & (F.col("first_key") <= int(wanted[-1])))
    else:
        shards = shards.filter(F.lit(False))
    return shards.mapInArrow(lambda batches: _read(batches, wanted), ROW)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, shard_start): ids in all shards before.  Parts are summed
    first, so the one ordered window has a row per written partition only."""
    sizes = spark.read.schema(SHARD).parquet(path).select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part")) - F.col("_n")
    parts = parts.select("part", before.alias("_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return sizes.join(parts, "part").select("part", "shard", (F.col("_before") + inside).alias("shard_start"))
