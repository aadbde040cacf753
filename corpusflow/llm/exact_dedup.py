"""Exact dedup: a minimal perfect hash over the distinct digests seen so far, in shards."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import cut, fresh, small_broadcast, table

SHARD_DIGESTS = 200_000
_GAMMA, _LEVELS, _WIDTH = 2, 40, 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return (_mix(words[:, level & 3] + salt) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Levels of bits; a key's slot is the rank of its bit. Keys that still collide after the last level follow in a list."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks, below = [], 0
        for bits in levels:
            self.ranks.append(below + np.concatenate(([0], np.cumsum(bits)[:-1])))
            below += int(bits.sum())
        self.placed = below

    @staticmethod
    def build(words: np.ndarray) -> PerfectHash:
        levels = []
        while len(words) and len(levels) < _LEVELS:
            bits = max(64, _GAMMA * len(words))
            at = _place(words, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            words = words[~alone[at]]
        return PerfectHash(levels, words)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Of a key that was built in its slot, of any other some slot or -1."""
        out = np.full(len(words), -1, dtype=np.int64)
        left = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = _place(words[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        if len(self.rest):
            listed = {r.tobytes(): self.placed + i for i, r in enumerate(self.rest)}
            for i in left:
                out[i] = listed.get(words[i].tobytes(), -1)
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<II", len(self.levels), len(self.rest))]
        for bits in self.levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join([*parts, self.rest.tobytes()])

    @staticmethod
    def from_bytes(raw: bytes) -> PerfectHash:
        n, rest = struct.unpack_from("<II", raw)
        at, levels = 8, []
        for _ in range(n):
            (bits,) = struct.unpack_from("<Q", raw, at)
            size = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at + 8), count=bits).astype(bool))
            at += 8 + size
        return PerfectHash(levels, np.frombuffer(raw, np.uint64, rest * 4, at).reshape(rest, 4))


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), dtype=np.uint64).reshape(-1, 4)


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, digests, locators) from distinct (digest, locator): slot i of a shard is 32 bytes of digests and
    the i-th locator, which may be null and has any type. Can be written as a table and kept."""
    kind = digests.schema["locator"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("digests", T.BinaryType()), T.StructField("locators", T.ArrayType(kind))])

    def build(group: pa.Table) -> pa.Table:
        words = _words(group["digest"])
        hashed = PerfectHash.build(words)
        order = np.argsort(hashed.slots(words))
        locators = group["locator"].combine_chunks().take(pa.array(order))
        held = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), locators)
        return pa.table({"shard": group["shard"].slice(0, 1), "hash": [hashed.to_bytes()], "digests": [words[order].tobytes()], "locators": held})

    keyed = digests.select("digest", "locator", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"))
    return keyed.groupBy("shard").applyInArrow(build, schema)


def look_up(index: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """asked, which has distinct values in digest, with member and locator. A slot counts only if all bytes of its
    digest are those looked up, so that what the hash was not built on is never taken for a member."""
    kind = index.schema["locators"].dataType.elementType
    schema = T.StructType([*asked.schema.fields, T.StructField("member", T.BooleanType()), T.StructField("locator", kind)])
    names = asked.columns

    def find(key: tuple, shard: pa.Table, rows: pa.Table) -> pa.Table:
        rows, n = rows.select(names), rows.num_rows
        member, locator = np.zeros(n, dtype=bool), pa.nulls(n)
        if n and shard.num_rows:
            words = _words(rows["digest"])
            held = np.frombuffer(shard["digests"][0].as_buffer(), np.uint64).reshape(-1, 4)
            slots = PerfectHash.from_bytes(shard["hash"][0].as_py()).slots(words)
            member = (slots >= 0) & (held[np.maximum(slots, 0)] == words).all(axis=1)
            locator = shard["locators"].combine_chunks().values.take(pa.array(slots, mask=~member))
        return pa.table([*rows.columns, pa.array(member), locator], names=[*names, "member", "locator"])

    keyed = asked.select("*", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"))
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(find, schema)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _groups(documents: DataFrame, least: str) -> DataFrame:
    return documents.where("text is not null").groupBy(_digest().alias("digest")).agg(F.min("doc_id").alias(least), F.count(F.lit(1)).alias("rows"))


def _earlier(documents: DataFrame) -> Column:
    """True for about the lesser half of the doc_ids: all of them are less than all others. Null ids are not among them."""
    kind = documents.schema["doc_id"].dataType
    # of strings and the like the first seven bytes, as a number of the same order
    order = F.col("doc_id") if isinstance(kind, T.NumericType) else F.conv(F.rpad(F.hex(F.substring(F.col("doc_id").cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    middle = documents.agg(F.percentile_approx(order, 0.5, 100)).first()[0]
    return F.lit(False) if middle is None else F.coalesce(order < F.lit(middle), F.lit(False))


def exact_dedup(documents: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of documents without those whose text occurs before.

    history: documents (doc_id, text) kept earlier; all rows with a text of theirs go. Without it the table's own
    earlier part, the lesser half of its doc_ids, is the history of the rest, and of its texts the least doc_id stays.
    The distinct digests of the history make the index: a minimal perfect hash whose slots hold the digest and the
    winner's doc_id. The other rows' digests are looked up; what the index holds goes, the rest is grouped by digest on
    its own, and of each group the least doc_id stays (null doc_ids come last; repeated rows of one doc_id leave one,
    the first by all columns' hash). Before a row goes, its text is compared with the winner's, so texts are equal byte
    for byte. Rows with a null text all stay; the empty text is a text like any other, and so are very long ones. All
    columns are kept, whatever their names; doc_id keeps its type. An empty table stays empty.

    Only digests and ids are shuffled, and the texts that repeat: the others meet their verdict in the scan while the
    verdicts are under 32 MB, else in one join on the digest. A winner is an aggregate and the others are joined with
    it, so that no task holds a group of copies.
    """
    names = documents.columns
    digest, other, win, gone, same = (fresh(names, c) for c in ("_digest", "_other", "_win", "_gone", "_same"))
    within = history is None
    early = _earlier(documents) if within else F.lit(False)
    known = cut(_groups(documents.where(early) if within else history.select("doc_id", "text"), "locator"))
    later = cut(_groups(documents.where(~early), "least"))
    shards = max(1, -(-max(known.count(), later.count()) // SHARD_DIGESTS))
    looked = cut(look_up(build_index(known.select("digest", "locator"), shards), later, shards))
    member, kind = F.col("member"), documents.schema["doc_id"].dataType
    verdicts = looked.where(member | (F.col("rows") > 1)).select(F.col("digest").alias(digest), F.when(member, F.col("locator")).otherwise(F.col("least").cast(looked.schema["locator"].dataType)).alias(win), (member & F.lit(not within)).alias(gone))
    if within:  # what repeats in the earlier part only
        verdicts = verdicts.union(known.where("rows > 1").select("digest", F.col("locator").cast(kind), F.lit(False))).distinct()
    verdicts = cut(verdicts)
    n = verdicts.count()
    if n == 0:
        return documents
    marked = documents.withColumn(digest, _digest()).join(small_broadcast(verdicts, n, 64), digest, "left")
    kept = marked.where(F.col(gone).isNull()).select(*names)
    repeats = cut(marked.where(F.col(gone).isNotNull()))
    plain = [F.col(c).cast("string") if t == "void" or t.startswith("map") else F.col(c) for c, t in documents.dtypes]
    of_winner = F.col("doc_id").eqNullSafe(F.col(win))
    winners = repeats.where(~F.col(gone) & of_winner).groupBy(digest).agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("row"))
    texts = winners.select(digest, F.col("row.text").alias(same))
    if not within:
        past = history.select(F.col("doc_id").alias("past"), F.col("text").alias(same)).withColumn(digest, F.unhex(F.sha2(same, 256)))
        texts = texts.union(past.join(small_broadcast(verdicts.where(gone), n, 64), digest).where(F.col("past").eqNullSafe(F.col(win))).groupBy(digest).agg(F.min(same).alias(same)))
    unlike = repeats.join(texts.withColumnRenamed(digest, other), F.col(digest) == F.col(other)).where(F.col("text") != F.col(same))
    return kept.unionByName(winners.select("row.*")).unionByName(unlike.select(*names))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars
        FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
        WHERE r = 1 OR text IS NULL
    """
}
