"""Approximate nearest neighbours by inner product: score-aware anisotropic product quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import cut, hash60, small_broadcast, table

CENTERS = 16  # four bits
FIT_BYTES = 32 << 20  # of the sample that the driver fits on


@dataclass(frozen=True)
class Quantiser:
    """books[s]: 16 centres of `width` dimensions for subspace s; eta: the weight of the parallel residual."""

    books: np.ndarray
    eta: float

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on |r|^2 + (eta - 1) (r.x / |x|)^2 from the nearest centres."""
        s, c, w = self.books.shape
        parts = x.reshape(len(x), s, w)
        direction = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None, None]
        near = np.empty((s, len(x), c), dtype=np.float32)  # squared residual of each choice
        along = np.empty((s, len(x), c), dtype=np.float32)  # its part along x
        for k in range(s):
            residual = parts[:, k, None, :] - self.books[k][None]
            near[k] = (residual**2).sum(axis=2)
            along[k] = np.einsum("ncw,nw->nc", residual, direction[:, k])
        codes = near.argmin(axis=2).T.copy()
        rows = np.arange(len(x))
        total = sum(along[k][rows, codes[:, k]] for k in range(s))
        for _ in range(rounds):
            for k in range(s):
                rest = total - along[k][rows, codes[:, k]]
                codes[:, k] = (near[k] + (self.eta - 1) * (rest[:, None] + along[k]) ** 2).argmin(axis=1)
                total = rest + along[k][rows, codes[:, k]]
        return codes.astype(np.uint8)

    def statistics(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each centre the normal equations of the loss with the other subspaces' codes held: A (s,c,w,w),
        b (s,c,w), and the loss."""
        s, c, w = self.books.shape
        codes = self.encode(x)
        parts = x.reshape(len(x), s, w)
        direction = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None, None]
        residual = parts - self.books[np.arange(s)[None], codes]
        along = (residual * direction).sum(axis=2)
        total = along.sum(axis=1)
        a, b = np.zeros((s, c, w, w)), np.zeros((s, c, w))
        for k in range(s):
            u = direction[:, k]
            own = np.eye(w)[None] + (self.eta - 1) * u[:, :, None] * u[:, None, :]
            aim = parts[:, k] + (self.eta - 1) * u * ((u * parts[:, k]).sum(axis=1) + total - along[:, k])[:, None]
            np.add.at(a[k], codes[:, k], own)
            np.add.at(b[k], codes[:, k], aim)
        return a, b, np.array([((residual**2).sum(axis=(1, 2)) + (self.eta - 1) * total**2).sum()])


def tables(books: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(subspaces / 2, 256, queries): the score of each pair of four-bit codes in two neighbouring subspaces."""
    s, c, w = books.shape
    single = np.einsum("scw,qsw->scq", books, queries.reshape(len(queries), s, w)).astype(np.float32)
    return (single[0::2, :, None] + single[1::2, None, :]).reshape(s // 2, c * c, len(queries))


def scan(codes: np.ndarray, looked: np.ndarray) -> np.ndarray:
    """(rows, queries): sums of table entries; codes has two four-bit codes to a byte."""
    total = looked[0][codes[:, 0]]
    for k in range(1, codes.shape[1]):
        total += looked[k][codes[:, k]]
    return total


def packed(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] * np.uint8(CENTERS) + codes[:, 1::2]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row of x as its bytes."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    kinds = {"binary": T.BinaryType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds.get(kind, kind) if isinstance(kind, str) else kind) for name, kind in fields])


def vectors(embeddings: DataFrame, dim: int) -> DataFrame:
    """(id, vector): finite vectors of `dim` floats, as bytes; of rows with one id the first in byte order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # null elements become nan
            rows = np.flatnonzero(np.diff(offsets) == dim)
            x = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float32).reshape(-1, dim)
            fine = np.isfinite(x).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[fine])), _bytes(x[fine])], names=["id", "vector"])

    rows = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(run, _schema(("id", rows.schema["id"].dataType), ("vector", "binary"))).groupBy("id").agg(F.min("vector").alias("vector"))


def _first(data: DataFrame, rows: int, n: int, salt: int) -> tuple[list, np.ndarray]:
    """Ids and vectors of the n rows (all, if fewer) that come first by a salted hash of the id."""
    at = hash60(F.lit(salt), "id")
    likely = data.where(at < F.lit(int(min(1.0, 1.5 * n / rows + 64 / rows) * (1 << 60))))  # so that tasks send few rows
    found = likely.orderBy(at, "id").limit(n).collect()
    return [r.id for r in found], np.stack([np.frombuffer(r.vector, np.float32) for r in found])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([(x[at : at + 4096] @ centres.T - half).argmax(axis=1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Lloyd from the first n rows; a centre left alone keeps its place."""
    centres = x[:n].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        there, starts, counts = np.unique(own[order], return_index=True, return_counts=True)
        centres[there] = np.add.reduceat(x[order].astype(np.float64), starts) / counts[:, None]
    return centres


def fit_quantiser(x: np.ndarray, width: int = 2, cosine: float = 0.2, rounds: int = 5) -> Quantiser:
    """eta follows from the cosine threshold T as (dim - 1) T^2 / (1 - T^2). Plain rounds (eta 1) come first;
    anisotropic ones, damped as all subspaces move at once, go on while the loss falls."""
    dim = x.shape[1]
    s = dim // width
    eta = max(1.0, (dim - 1) * cosine**2 / (1 - cosine**2))
    rng = np.random.default_rng(3)
    books = np.stack([x[rng.permutation(len(x))[np.arange(CENTERS) % len(x)], k * width : (k + 1) * width] for k in range(s)]).astype(np.float64)
    books += rng.normal(scale=1e-4, size=books.shape)
    best, least = None, np.inf
    for r in range(2 * rounds):
        plain = r < rounds
        q = Quantiser(books.astype(np.float32), 1.0 if plain else eta)
        a, b, loss = (sum(part) for part in zip(*(q.statistics(x[at : at + 2048]) for at in range(0, len(x), 2048))))
        if not plain:
            if loss[0] >= least * (1 - 1e-4):
                break
            best, least = q, loss[0]
        ridge = 1e-9 + a + 1e-6 * np.eye(width)
        moved = np.linalg.solve(ridge, (b + 1e-6 * books)[..., None])[..., 0]
        empty = np.trace(a, axis1=2, axis2=3) <= 0
        books = np.where(empty[..., None], books, books + (1.0 if plain else 0.5) * (moved - books))
    return best or Quantiser(books.astype(np.float32), eta)


def _best(k: int) -> Column:
    """The k best of a group's (score, id, ...): by falling score, ties to the smaller id."""
    return F.slice(F.array_sort(F.collect_list("found")), 1, k)


def _exact(data: DataFrame, q_ids: list, q: np.ndarray, k: int) -> np.ndarray:
    """The k exact neighbours of each query over all rows, as vectors (queries, at most k, dim). A task keeps the k best
    of what it has seen, so it sends queries * k rows whatever it reads."""
    dim, kind = q.shape[1], data.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, np.ndarray, np.ndarray] | None = None  # ids, scores (queries, n), vectors (queries, n, dim)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, x = part.column(0).to_pylist(), _matrix(part.column(1), dim)
                scores = q @ x.T
                at_query = pa.compute.index_in(part.column(0), pa.array(q_ids, part.column(0).type)).fill_null(-1).to_numpy()
                scores[at_query[at_query >= 0], np.flatnonzero(at_query >= 0)] = -np.inf
                top = np.argpartition(-scores, min(k, len(x)) - 1, axis=1)[:, :k]
                rows = np.arange(len(q))[:, None]
                own = ([[ids[c] for c in r] for r in top], scores[rows, top], x[top])
                if held is not None:
                    names = [a + b for a, b in zip(held[0], own[0])]
                    value, vector = np.concatenate((held[1], own[1]), axis=1), np.concatenate((held[2], own[2]), axis=1)
                    top = np.argsort(-value, axis=1, kind="stable")[:, :k]
                    own = ([[n[c] for c in r] for n, r in zip(names, top)], value[rows, top], vector[rows, top])
                held = own
        if held is not None:
            n = held[1].shape[1]
            at = pa.array(np.repeat(np.arange(len(q)), n))
            ids = pa.array([i for r in held[0] for i in r])
            yield pa.RecordBatch.from_arrays([at, ids, pa.array(held[1].ravel().astype(np.float64)), _bytes(held[2].reshape(-1, dim))], names=["q", "id", "score", "vector"])

    found = data.select("id", "vector").mapInArrow(run, _schema(("q", "bigint"), ("id", kind), ("score", "double"), ("vector", "binary")))
    best = found.where("score > double('-infinity')").select("q", F.struct((-F.col("score")).alias("score"), "id", "vector").alias("found")).groupBy("q").agg(_best(k).alias("top")).collect()
    n = max(1, min((len(r.top) for r in best), default=1))
    near = np.zeros((len(q), n, dim), np.float32)
    for r in best:
        for j, t in enumerate(r.top[:n]):
            near[r.q, j] = np.frombuffer(t.vector, np.float32)
    return near


def neighbours(embeddings: DataFrame, k: int = 10, queries: Column | None = None, recall: float = 0.97, list_rows: int = 2048, tile: int = 16_384, queries_per_tile: int = 4096, rerank: int = 64, sample: int = 256) -> DataFrame:
    """(vec_id, neighbour_id, rank, score): for every vector that meets the condition `queries` on vec_id (all, without
    one) its k others of largest inner product among all vectors, approximately.

    Vectors fall into lists of about list_rows by k-means, with 1,024 lists at most. A query visits the lists whose
    centres have the largest inner products with it; how many is measured, as the least number that holds a share
    `recall` of the exact neighbours of `sample` queries, themselves found over all rows: few for clustered vectors,
    many for structureless ones. In a list, four-bit codes fitted to the anisotropic loss are scanned by table sums for
    all its queries, and the best `rerank` of each block are scored exactly. Scores are float32 inner products as
    doubles; ties go to the smaller id.

    Centres and codebooks are fitted on the driver, on the vectors that come first by a hash of their ids: 65,536 of
    them or FIT_BYTES, the codebooks on 8,192. All vectors are indexed. So neither what the driver holds, nor what is
    broadcast, nor the work of assigning a vector grows with the table.

    Rows with a null id, a null or non-finite element, or a length other than the commonest are left out; of rows with
    one id the first vector in byte order counts. A vector is not its own neighbour, but equal ones of other ids are.
    Fewer than k others give fewer rows, one vector or an empty table none. Other columns are not read; vec_id keeps
    its type, which must be one that can be ordered.

    Lists of more than `tile` rows are cut into blocks and their queries into groups, so that no task holds more than
    one block and one group, however skewed the lists are.
    """
    spark, kind = embeddings.sparkSession, embeddings.schema["vec_id"].dataType
    out = _schema(("vec_id", kind), ("neighbour_id", kind), ("rank", "int"), ("score", "double"))
    usual = embeddings.where("embedding is not null and vec_id is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None or usual.d == 0:
        return spark.createDataFrame([], out)
    dim = usual.d
    even = dim + (-dim) % 4  # padded with zeros to whole pairs of subspaces
    data = vectors(embeddings, dim)
    if even != dim:
        data = data.select("id", F.concat("vector", F.lit(b"\0" * 4 * (even - dim))).alias("vector"))
    data = cut(data)
    rows = data.count()
    if rows < 2:
        return spark.createDataFrame([], out)
    _, fitted = _first(data, rows, min(rows, 65_536, max(1024, FIT_BYTES // (4 * even))), 1)
    lists = max(1, min(rows // list_rows, 1024, len(fitted) // 32))
    quantiser, centres = fit_quantiser(fitted[:8192]), k_means(fitted, lists)
    asked = data if queries is None else data.withColumnRenamed("id", "vec_id").where(queries).withColumnRenamed("vec_id", "id")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], out)
    q_ids, q = _first(asked, n_asked, min(sample, n_asked), 2)
    near = _exact(data, q_ids, q, k)
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None].repeat(len(q), axis=0), axis=1)
    own = nearest(near.reshape(-1, even), centres).reshape(len(q), -1)
    probes = 1 + int(np.quantile(np.take_along_axis(place, own, axis=1), recall, method="higher"))
    sent = spark.sparkContext.broadcast((centres, quantiser))  # 1,024 centres and 16 codes a subspace at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, quantiser = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1), even)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest(x, centres).astype(np.int32)), _bytes(packed(quantiser.encode(x)))], names=["id", "vector", "list", "codes"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                scores = _matrix(part.column(1), even) @ centres.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                index = pa.array(np.repeat(np.arange(part.num_rows), top.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(top.ravel().astype(np.int32))], names=["id", "vector", "list"])

    listed = (("id", kind), ("vector", "binary"), ("list", "int"))
    stored = cut(data.select("id", "vector").mapInArrow(assign, _schema(*listed, ("codes", "binary"))))
    visits = asked.select("id", "vector").mapInArrow(visit, _schema(*listed))
    sizes = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks")).join(visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / queries_per_tile).cast("int").alias("groups")), "list")
    cuts = small_broadcast(sizes, lists, 16)
    left = stored.join(cuts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "id", "vector", "codes")
    right = visits.join(cuts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("group"), "id", "vector")

    def search(key: tuple, base: pa.Table, queries: pa.Table) -> pa.Table:
        if not base.num_rows or not queries.num_rows:
            return pa.table([base["id"].slice(0, 0), base["id"].slice(0, 0), pa.array([], pa.float64())], names=["vec_id", "neighbour_id", "score"])
        books = sent.value[1].books
        base = base.sort_by("id")  # positions then order ties by id
        x, codes = _matrix(base["vector"], even), np.frombuffer(b"".join(base["codes"].to_pylist()), np.uint8).reshape(base.num_rows, -1)
        q_all, depth = _matrix(queries["vector"], even), min(rerank, len(x))
        itself = pa.compute.index_in(queries["id"], base["id"]).fill_null(-1).to_numpy()
        parts = []
        for at in range(0, len(q_all), 128):
            q = q_all[at : at + 128]
            approximate = scan(codes, tables(books, q))
            top = np.argpartition(-approximate, depth - 1, axis=0)[:depth].T if depth < len(x) else np.arange(len(x))[None].repeat(len(q), axis=0)
            exact = np.einsum("qd,qnd->qn", q, x[top])
            exact[top == itself[at : at + 128, None]] = -np.inf
            best = np.lexsort((top, -exact), axis=1)[:, :k]
            kept = np.take_along_axis(exact, best, axis=1)
            there = np.isfinite(kept)
            parts.append((at + np.nonzero(there)[0], np.take_along_axis(top, best, axis=1)[there], kept[there]))
        a, b, c = (np.concatenate(p) for p in zip(*parts))
        return pa.table([queries["id"].take(pa.array(a)), base["id"].take(pa.array(b)), pa.array(c.astype(np.float64))], names=["vec_id", "neighbour_id", "score"])

    found = left.groupBy("list", "block", "group").cogroup(right.groupBy("list", "block", "group")).applyInArrow(search, _schema(("vec_id", kind), ("neighbour_id", kind), ("score", "double")))
    ranked = found.select("vec_id", F.struct((-F.col("score")).alias("score"), "neighbour_id").alias("found")).groupBy("vec_id").agg(_best(k).alias("top"))
    return ranked.select("vec_id", F.posexplode("top").alias("p", "t")).select("vec_id", "t.neighbour_id", (F.col("p") + 1).cast("int").alias("rank"), (-F.col("t.score")).alias("score"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, against all vectors."""
    return neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours}
SQL: dict[str, str] = {}
