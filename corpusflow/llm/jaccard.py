"""N-gram Jaccard join by chosen paths, and the groups it gives."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import cut, small_broadcast, table

SLICE = 1 << 20
WIDTH = 64  # coordinates of a signature
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
    word = np.zeros(256, dtype=bool)
    word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
    return byte, word, rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32), rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32) | np.uint32(1)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate((np.ones(1, _U), np.full(size, base, _U))), dtype=_U)
        down = np.cumprod(np.concatenate((np.ones(1, _U), np.full(size, pow(base, -1, 1 << 64), _U))), dtype=_U)
    return up, down


def _powers_for(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(2 * SLICE, 1 << (size - 1).bit_length()))


def _pieces(text: str, n: int) -> Iterator[bytes]:
    """The lowered text in pieces of about SLICE bytes that begin with the n-1 words before them, so that each n-gram
    is in exactly one. A single longer word stays whole."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    if len(raw) <= SLICE:
        yield raw
        return
    _, word, _, _ = _constants()
    is_word = word[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + SLICE))
        end = max(end, at + 1)
        if len(starts) - end < n:  # else the last piece could hold fewer words than n
            end = len(starts)
        yield raw[starts[max(0, at - (n - 1))] : starts[end] if end < len(starts) else len(raw)]
        at = end


def _grams(pieces: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of the pieces, one after another, and how many each piece has. A piece of fewer than
    n words has one gram of all its words; one without words none."""
    byte, word, _, _ = _constants()
    raw = np.frombuffer(b" ".join(pieces) + b" ", dtype=np.uint8)
    up, down = _powers_for(len(raw) + 1)
    is_word = word[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word))))
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, _U), np.cumsum(byte[raw] * up[: len(raw)], dtype=_U)))
        words = mix((upto[ends] - upto[starts]) * down[starts])
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1
        first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        count = np.diff(first)
        grams = np.maximum(count - n + 1, count > 0)
        owner = np.repeat(np.arange(len(pieces)), grams)
        offset = np.concatenate(([0], np.cumsum(grams)[:-1]))
        at = first[:-1][owner] + (np.arange(len(owner)) - offset[owner])
        out = np.zeros(len(owner), dtype=_U)
        for k in range(n):
            inside = k < count[owner]
            out = np.where(inside, mix(out * _U(0x9E3779B97F4A7C15) + words[np.minimum(at + k, max(len(words) - 1, 0))] + _U(k)), out) if len(words) else out
    return out, grams


def _chunks(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner of each piece, grams, grams per piece) for about SLICE bytes at a time."""
    owners: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or "", n):
            owners.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= SLICE:
                yield np.array(owners), *_grams(pieces, n)
                owners, pieces, size = [], [], 0
    if pieces:
        yield np.array(owners), *_grams(pieces, n)


def signatures(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: how many n-grams, two sums over their hashes (equal for equal bags), WIDTH minima."""
    _, _, xor, times = _constants()
    count, one, two = np.zeros(len(texts), np.int64), np.zeros(len(texts), _U), np.zeros(len(texts), _U)
    minima = np.full((len(texts), WIDTH), 0xFFFFFFFF, dtype=np.uint32)
    for owner, grams, per in _chunks(texts, n):
        full = np.flatnonzero(per)
        if not len(full):
            continue
        at = np.concatenate(([0], np.cumsum(per[full])[:-1]))
        with np.errstate(over="ignore"):
            np.add.at(count, owner[full], per[full])
            np.add.at(one, owner[full], np.add.reduceat(grams, at))
            np.add.at(two, owner[full], np.add.reduceat(mix(grams + _U(0x632BE59BD9B4E019)), at))
            low = (grams >> _U(32)).astype(np.uint32)
            own = np.empty((len(full), WIDTH), dtype=np.uint32)
            for t in range(WIDTH):
                own[:, t] = np.minimum.reduceat((low ^ xor[t]) * times[t], at)
        np.minimum.at(minima, owner[full], own)
    return count, one, two, minima


def _signed(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, sid, sig) of each row with an id and a word; sid is a 64-bit hash of the bag of n-grams."""
    kind = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # few texts at a time are Python strings
                batch = whole.slice(at, 500)
                count, one, two, minima = signatures(batch.column(1).to_pylist(), n)
                keep = np.flatnonzero(count)
                ids = batch.column(0).take(pa.array(keep))
                sig = pa.array([minima[i].tobytes() for i in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(_set_ids(count, one, two)[keep]), sig], names=["doc_id", "sid", "sig"])

    source = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("sid", T.LongType()), T.StructField("sig", T.BinaryType())]))


def _set_ids(count: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(mix(count.astype(_U) + _U(1)) + one) * _U(0x9E3779B97F4A7C15) + two).view(np.int64)


def _children(node: np.ndarray, minima: np.ndarray, ways: int) -> Iterator[np.ndarray]:
    """For each of `ways` coordinates sampled for a node, the child of each set: sets with one token share it."""
    with np.errstate(over="ignore"):
        # coordinates start + k * stride (mod WIDTH), stride odd: different ones, the same for all sets of a node
        start, stride = mix(node ^ _U(0xA5A5A5A5)), mix(node + _U(0x1234567)) | _U(1)
        for k in range(ways):
            coordinate = (start + _U(k) * stride) % _U(WIDTH)
            value = minima[np.arange(len(minima)), coordinate.astype(np.int64)].astype(_U)
            yield mix(mix(node + coordinate * _U(0x9E3779B97F4A7C15)) ^ value)


def _sampled(run: int, ways: int) -> list[int]:
    """The coordinates that the root samples in a run; runs don't share any until all are used."""
    order = np.random.default_rng(11).permutation(WIDTH)
    return [int(order[(run * ways + k) % WIDTH]) for k in range(ways)]


def _split(rows: DataFrame, run: int, ways: int, root: bool) -> DataFrame:
    """(node, sid, sketch) of all children. rows: (sid, sig) at the root, else (node, sid, sketch)."""
    schema = pa.schema([("node", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sids, raw = batch.column("sid"), batch.column("sig" if root else "sketch")
            minima = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint32 if root else np.uint16).reshape(-1, WIDTH)
            if root:
                raw = pa.array([m.tobytes() for m in minima.astype(np.uint16)], pa.binary())
                with np.errstate(over="ignore"):
                    children = [mix(mix(minima[:, t].astype(_U) + _U(t + 1) * _U(0x9E3779B97F4A7C15)) + _U(run)) for t in _sampled(run, ways)]
            else:
                children = list(_children(batch.column("node").to_numpy().view(_U), minima, ways))
            for child in children:
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), sids, raw], schema=schema)

    return rows.mapInArrow(split, "node bigint, sid bigint, sketch binary")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of the last axis' WIDTH sketches x and y agree."""
    lanes = np.ascontiguousarray(x == y).view(_U).sum(axis=-1, dtype=_U)
    with np.errstate(over="ignore"):
        return ((lanes * _U(0x0101010101010101)) >> _U(56)).astype(np.int32)


def _against(some: np.ndarray, rest: np.ndarray, sketch: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, agreement) of some with rest, need at least, in blocks of bounded size."""
    for at in range(0, len(some), 32):
        for to in range(0, len(rest), 1024):
            i, j = some[at : at + 32], rest[to : to + 1024]
            found = _agree(sketch[i][:, None, :], sketch[j][None, :, :])
            x, y = np.nonzero(found >= need)
            if len(x):
                yield i[x], j[y], found[x, y]


def _among(some: np.ndarray, sketch: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs inside some."""
    for at in range(0, len(some), 32):
        yield from _against(some[at : at + 32], some[at + 32 :], sketch, need)
        yield from _paired(np.array([at]), np.array([min(32, len(some) - at)]), some, sketch, need)


def local_paths(sketch: np.ndarray, node: int, threshold: float, need: int, ways: int, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rest of a node's tree: sets whose mean agreement with the node's sets comes near the threshold are compared
    with all of them and leave; the others are split on sampled tokens until a bucket is small enough to compare.
    Coordinates where over half of the sets to be split share one token would not split a node and are passed over;
    where that leaves fewer than `ways`, all pairs of the sets are compared.
    """
    tokens = np.stack([np.unique(sketch[:, t], return_inverse=True)[1] for t in range(WIDTH)], axis=1)
    stack = [(np.arange(len(sketch)), node & 0xFFFFFFFF)]
    while stack:
        own, name = stack.pop()
        mean, share = np.zeros(len(own)), np.zeros(WIDTH)
        for t in range(WIDTH):
            column = tokens[own, t]
            count = np.bincount(column)
            mean += count[column] - 1
            share[t] = count.max() / len(own)
        dense = mean >= 0.8 * threshold * WIDTH * (len(own) - 1)
        if dense.any():
            hot, own = own[dense], own[~dense]
            yield from _against(hot, own, sketch, need)
            yield from _among(hot, sketch, need)
            if len(own):  # the dense sets' tokens no longer count
                share = np.array([np.bincount(tokens[own, t]).max() / len(own) for t in range(WIDTH)])
        usable = np.flatnonzero(share <= 0.5)
        if len(own) <= bucket or len(usable) < ways:
            yield from _among(own, sketch, need)
            continue
        for k, t in enumerate(np.random.default_rng(name).permutation(usable)[:ways]):
            column = tokens[own, t]
            order = np.argsort(column, kind="stable")
            starts = np.concatenate(([0], np.flatnonzero(np.diff(column[order])) + 1))
            sizes = np.diff(np.concatenate((starts, [len(own)])))
            small = (sizes > 1) & (sizes <= bucket)
            yield from _paired(starts[small], sizes[small], own[order], sketch, need)
            for g in np.flatnonzero(sizes > bucket):
                stack.append((own[order[starts[g] : starts[g] + sizes[g]]], (name * 31 + k * 1009 + int(g) + 1) & 0xFFFFFFFF))


def _paired(starts: np.ndarray, sizes: np.ndarray, index: np.ndarray, sketch: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs inside many groups, each a stretch of index, by their distance in it."""
    for gap in range(1, int(sizes.max(initial=0))):
        group = np.flatnonzero(sizes > gap)
        lengths = sizes[group] - gap
        left = np.repeat(starts[group] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        for at in range(0, len(left), 1 << 15):
            i, j = index[left[at : at + (1 << 15)]], index[left[at : at + (1 << 15)] + gap]
            found = _agree(sketch[i], sketch[j])
            ok = found >= need
            if ok.any():
                yield i[ok], j[ok], found[ok]


def _join(rows: DataFrame, threshold: float, ways: int, bucket: int, most: int) -> DataFrame:
    """(a, b, agree) of the sets that meet in a node and agree well enough, a < b, and, with a null, the (node, sid,
    sketch) of nodes of more than `most` sets, which are passed on to be split. rows: (node, sid, sketch). A pair comes
    from every node that finds it: a node that it met in before may have lost it when it was split."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("node", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary())])
    need = math.ceil((threshold - 3 * math.sqrt(threshold * (1 - threshold) / WIDTH)) * WIDTH)
    none = lambda n, kind: pa.nulls(n, kind)

    def found(sids: np.ndarray, i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
        x, y = sids[i], sids[j]
        n = len(x)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(agree), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary())], schema=schema)

    def passed(nodes: np.ndarray, sids: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        n = len(nodes)
        return pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int32()), pa.array(nodes), pa.array(sids), pa.array([s.tobytes() for s in sketch], pa.binary())], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        too_large: int | None = None  # the node whose rows are being passed on

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal too_large
            nodes, sids, sketch = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if too_large is not None:
                upto = int(np.searchsorted(nodes != too_large, True))
                if upto:
                    yield passed(nodes[:upto], sids[:upto], sketch[:upto])
                    nodes, sids, sketch = nodes[upto:], sids[upto:], sketch[upto:]
            if not len(nodes):
                return
            starts = np.concatenate(([0], np.flatnonzero(np.diff(nodes)) + 1))
            sizes = np.diff(np.concatenate((starts, [len(nodes)])))
            done = len(starts) if last else len(starts) - 1
            ready = np.arange(len(starts)) < done
            small = np.flatnonzero(ready & (sizes > 1) & (sizes <= bucket))
            for x in _paired(starts[small], sizes[small], np.arange(len(nodes)), sketch, need):
                yield found(sids, *x)
            for k in np.flatnonzero(ready & (sizes > bucket)):
                own = slice(starts[k], starts[k] + sizes[k])
                if sizes[k] > most:
                    yield passed(nodes[own], sids[own], sketch[own])
                else:
                    for x in _once(local_paths(sketch[own], int(nodes[starts[k]]), threshold, need, ways + 2, bucket), int(sizes[k])):
                        yield found(sids[own], *x)
            if not last:
                own = slice(starts[-1], None)
                if sizes[-1] > most:
                    too_large = nodes[-1]
                    yield passed(nodes[own], sids[own], sketch[own])
                else:
                    held.append((nodes[own], sids[own], sketch[own]))

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, WIDTH)))
                yield from flush(False)
        if held:
            yield from flush(True)

    return rows.mapInArrow(join, "a bigint, b bigint, agree int, node bigint, sid bigint, sketch binary")


def _once(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """pairs of 0..n-1, those of about `most` at a time without repetition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
        return code // n, code % n, np.concatenate([h[1] for h in held])[at]

    for i, j, agree in pairs:
        held.append((np.minimum(i, j) * n + np.maximum(i, j), agree))
        size += len(i)
        if size > most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _tiles(left: DataFrame, most: int) -> DataFrame:
    """The rows of nodes that didn't split, dealt into tiles of about `most` sets so that any two sets of a node meet in one."""
    sizes = left.groupBy("node").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(float(most))).cast("int").alias("g"))
    part = F.pmod(F.xxhash64("sid"), F.col("g")).cast("int")
    dealt = left.join(sizes, "node").withColumn("x", part).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).where("x != y")
    return dealt.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "sid", "sketch")


def _run(sets: DataFrame, run: int, threshold: float, bucket: int, most: int, depth: int) -> DataFrame:
    """One run: the candidate pairs (a, b) of its tree, each as often as it was found. A level is one shuffle of (node,
    sid, sketch); only nodes of more than `most` sets need another, all others are finished where their rows meet.
    Nodes that are still larger after `depth` levels are mostly near copies, which don't split: they are compared whole,
    in tiles."""
    ways = math.ceil(1 / threshold) + 1
    nodes, found = _split(sets.select("sid", "sig"), run, ways, True), None
    for level in range(depth + 1):
        met = cut(_join(nodes.repartition("node").sortWithinPartitions("node"), threshold, ways, bucket, most if level < depth else 1 << 62))
        pairs = met.where("a is not null and a != b").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        left = met.where("a is null").select("node", "sid", "sketch")
        if level == depth or left.isEmpty():
            break
        nodes = _split(left, run, ways, False) if level < depth - 1 else _tiles(left, most)
    return found


def _runs(threshold: float, ways: int, recall: float) -> int:
    """How many runs bring a share of `recall` of the pairs together at each agreement from the threshold up: the
    chance grows with the agreement, so the threshold's decides. It is 1 when all coordinates have been sampled."""
    runs = 1
    while _met(math.ceil(threshold * WIDTH), runs * ways) < recall:
        runs += 1
    return runs


def _met(agree: int, sampled: int) -> float:
    """The chance that a pair that agrees in `agree` of WIDTH coordinates shares a token among `sampled` of them."""
    sampled = min(sampled, WIDTH)
    return 1 - math.comb(WIDTH - agree, sampled) / math.comb(WIDTH, sampled)


def _verified(pairs: DataFrame, grams: DataFrame, threshold: float, most: int = 2000) -> DataFrame:
    """(a, b, jaccard) of the pairs that meet the threshold on their sets. A set's leader is the least of it and its
    partners; pairs meet their sets in the group of a's leader, so that a set of many pairs is sent about once and not
    with each. Leaders share groups of some thousand pairs; those of more than most^2 / 2 pairs are cut into tiles of
    about as many."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    leaders = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("leader"))
    led = pairs.select("a", "b").join(leaders, "a")
    tiles = led.groupBy("leader").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(float(most) * most / 2))).cast("int").alias("g"))
    keys, bins = ["bin", "x", "y"], max(1, pairs.count() // 4000)
    part = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
    placed = cut(led.join(tiles, "leader").select(F.pmod(F.xxhash64("leader"), F.lit(bins)).cast("int").alias("bin"), part("a").alias("x"), part("b").alias("y"), "a", "b"))
    needed = placed.select(*keys, F.col("a").alias("sid")).union(placed.select(*keys, "b")).distinct().join(grams, "sid").select(F.col("bin").alias("bin2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "sid", "grams")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])

    def verify(key: tuple, asked: pa.Table, sets: pa.Table) -> pa.Table:
        if not asked.num_rows or not sets.num_rows:
            return schema.empty_table()
        order = np.argsort(sets["sid"].to_numpy())
        sids = sets["sid"].to_numpy()[order]
        lists = sets["grams"].combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(offsets)
        tokens, dense = np.unique(values, return_inverse=True)
        a, b = (order[np.searchsorted(sids, asked[c].to_numpy())] for c in "ab")
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        share, marked = np.zeros(len(a)), np.zeros(len(tokens), dtype=bool)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1, [len(a)]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = dense[offsets[a[lo]] : offsets[a[lo] + 1]]
            marked[own] = True
            for at in range(lo, hi, 256):
                others = b[at : min(hi, at + 256)]
                counts = size[others]
                ends = np.cumsum(counts)
                index = np.arange(ends[-1]) + np.repeat(offsets[others] - (ends - counts), counts)
                shared = np.add.reduceat(marked[dense[index]].astype(np.int64), ends - counts)
                share[at : at + len(others)] = shared / (size[a[lo]] + counts - shared)
            marked[own] = False
        ok = share >= threshold
        names = sets["sid"].to_numpy()
        return pa.table([pa.array(names[a[ok]]), pa.array(names[b[ok]]), pa.array(share[ok])], schema=schema)

    return placed.groupBy(*keys).cogroup(needed.groupBy("bin2", "x2", "y2")).applyInArrow(verify, "a bigint, b bigint, jaccard double")


def _gram_sets(documents: DataFrame, n: int) -> DataFrame:
    """(sid, grams): the distinct n-gram hashes, 8 bytes each."""
    schema = pa.schema([("sid", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.column(0).slice(at, 500).to_pylist()
                found: list[list[np.ndarray]] = [[] for _ in part]
                for owner, grams, per in _chunks(part, n):
                    ends = np.cumsum(per)
                    for k, i in enumerate(owner):
                        found[i].append(grams[ends[k] - per[k] : ends[k]])
                joined = [np.concatenate(x) for x in found]
                with np.errstate(over="ignore"):
                    one = np.array([g.sum(dtype=_U) for g in joined], _U)
                    two = np.array([mix(g + _U(0x632BE59BD9B4E019)).sum(dtype=_U) for g in joined], _U)
                distinct = [np.unique(g).view(np.int64) for g in joined]
                offsets = np.concatenate(([0], np.cumsum([len(g) for g in distinct]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(distinct)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(np.array([len(g) for g in joined]), one, two)), lists], schema=schema)

    return documents.select("text").mapInArrow(run, "sid bigint, grams array<bigint>")


@dataclass(frozen=True)
class Joined:
    """sets: (sid, leader), leader the least doc_id that has the set. members: (doc_id, sid). close: (a, b, jaccard), the
    pairs of different sets at the threshold."""

    sets: DataFrame
    members: DataFrame
    close: DataFrame


def _joined(documents: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.97, bucket: int = 64, most: int = 50_000, depth: int = 3) -> Joined:
    signed = cut(_signed(documents, n))
    sets = cut(signed.groupBy("sid").agg(F.min("doc_id").alias("leader"), F.min("sig").alias("sig")))
    found, ways = None, math.ceil(1 / threshold) + 1
    for run in range(_runs(threshold, ways, recall)):
        now = _run(sets, run, threshold, bucket, most, depth)
        found = now if found is None else found.unionByName(now)
    pairs = cut(found.distinct())
    used = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    names = cut(sets.select("sid", "leader").join(used, "sid", "left_semi"))
    count = names.count()
    rows = documents.where("text is not null").select("doc_id", "text")
    read = rows.join(small_broadcast(names.select(F.col("leader").alias("doc_id")).distinct(), count, 64), "doc_id", "left_semi")
    grams = cut(_gram_sets(read, n).join(small_broadcast(names.select("sid"), count, 16), "sid", "left_semi").dropDuplicates(["sid"]))
    return Joined(sets.select("sid", "leader"), signed.select("doc_id", "sid").distinct(), cut(_verified(pairs, grams, threshold)))


def jaccard_join(documents: DataFrame, **options) -> DataFrame:
    """Pairs of documents whose sets of word n-grams have a Jaccard similarity of at least threshold, without the pairs
    that follow from others: (doc_id, partner_id, jaccard, copy), doc_id <= partner_id.

    Documents with the same n-grams are one set, whose leader is its least doc_id. Rows with copy = true tie each other
    member to its leader (jaccard 1.0), so that a thousand copies take 999 rows; rows with copy = false are the pairs of
    leaders of different sets, all of them. all_pairs() spells out every pair, classes() counts them by document.

    Options: threshold 0.5, n 3 (words in a gram), recall 0.97, and the sizes bucket, most and depth, which change costs
    and not what is looked for.

    A word is a run of ASCII letters, digits and underscores or any other non-ASCII characters, lowered; a text of
    fewer than n words has one gram of them all. Null doc_ids, null texts and texts without words are in no pair.
    Repeated rows count once. Rows of one doc_id with unlike texts are separate sets, and such a doc_id may be paired
    with itself. Other columns are not read; doc_id may have any type that can be ordered. No pair is found twice, and
    ties can't arise. An empty table gives no rows. Long texts are hashed in pieces.

    Chosen paths: each set keeps WIDTH minhash tokens. A node samples ceil(1/threshold)+1 coordinates; sets that share
    the token there go to the same child. Buckets of at most `bucket` sets are compared pair by pair on their
    signatures, larger ones split again after the sets that are near most of the others have been compared with all of
    them. Runs repeat with other samples until a share of `recall` of the pairs must have met at every agreement from
    the threshold up, however many pairs each has. Every sample reports what it finds, so that a later one makes up for
    what a split bucket lost; repetitions are dropped by (a, b).
    Survivors (three standard errors below the threshold) are verified on the whole n-gram sets. Sets and n-grams are
    told apart by 64-bit hashes, so among n sets about n^2 / 2^65 pairs would be confused; nothing else is approximate.
    Each run moves 16-bit sketches (128 bytes a set) once; texts are read again only for leaders in surviving pairs.
    """
    joined = _joined(documents, **options)
    close, sets = joined.close, joined.sets
    a, b = (sets.select(F.col("sid").alias(s), F.col("leader").alias(f"id{s}")) for s in "ab")
    near = close.join(a, "a").join(b, "b").select(F.least("ida", "idb").alias("doc_id"), F.greatest("ida", "idb").alias("partner_id"), "jaccard", F.lit(False).alias("copy"))
    same = joined.members.join(sets, "sid").where("doc_id != leader").select(F.col("leader").alias("doc_id"), F.col("doc_id").alias("partner_id"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("copy"))
    return near.unionByName(same)


def all_pairs(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, partner_id, jaccard), doc_id < partner_id, with each pair of documents as its own row; as many rows as
    there are pairs. Nulls, ties and repeated rows as in jaccard_join()."""
    joined = _joined(documents, **options)
    x, y = (joined.members.select(F.col("doc_id").alias(f"id{s}"), F.col("sid").alias(s)) for s in "ab")
    near = joined.close.join(x, "a").join(y, "b").select("ida", "idb", "jaccard")
    same = x.join(y, F.col("a") == F.col("b")).select("ida", "idb", F.lit(1.0).alias("jaccard"))
    spelled = near.union(same).where("ida != idb")
    return spelled.groupBy(F.least("ida", "idb").alias("doc_id"), F.greatest("ida", "idb").alias("partner_id")).agg(F.max("jaccard").alias("jaccard"))


def classes(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, leader_id, copies, links): a row for every document that has a partner.

    class_id is the least doc_id of all that pairs connect, leader_id the least with the same n-grams, copies the
    number of documents with the same n-grams (itself too), links that of all others at the threshold, copies of them
    counted each. Documents without a partner have no row. The result has at most a row per document, whatever the size
    of its groups. A doc_id whose rows have unlike texts connects them and has a row for each; else as jaccard_join(),
    which also says what nulls, empty and long texts, ties and repeated rows give.

    A group of n copies is one node, so no task holds its documents; of n near copies that all differ every link is
    found and counted, which takes n^2 / 2 comparisons in tiles of bounded size.
    """
    joined = _joined(documents, **options)
    members, close = cut(joined.members), joined.close
    copies = members.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"))
    both = close.select("a", "b").union(close.select("b", "a"))
    linked = cut(both.join(copies.withColumnRenamed("sid", "b"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("copies").alias("links")))
    several = members.groupBy("doc_id").agg(F.min("sid").alias("u"), F.max("sid").alias("last")).where("u < last")
    across = members.join(several, "doc_id").where("sid != u").select("u", F.col("sid").alias("v"))
    roots = components(close.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).union(across).distinct())
    known = joined.sets.join(copies.where("copies > 1"), "sid", "left").join(linked, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    known = known.where("copies is not null or links is not null or root is not null").select("sid", "leader", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root"))
    known = cut(known)
    least = known.groupBy("root").agg(F.min("leader").alias("class_id"))
    groups = cut(known.join(least, "root").select("sid", "class_id", F.col("leader").alias("leader_id"), "copies", "links"))
    return members.join(small_broadcast(groups, groups.count(), 128), "sid").select("doc_id", "class_id", "leader_id", "copies", "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (u, v), u < v, is connected to, by alternating large and
    small stars until nothing changes, in O(log^2 n) rounds. The least neighbours are aggregates, joined back, so that a
    node of many edges is not one task's."""
    now, before = cut(edges.select("u", "v")), None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        marked = large.join(down, "u")
        now = cut(marked.select("u", F.col("m").alias("v")).union(marked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents but for those near another with a smaller doc_id: of each of classes() the least doc_id
    stays. Rows with a null doc_id, null texts and texts without words stay; all columns are kept, whatever their names.
    Rows that share a doc_id share their fate; of equal rows all stay or all go. An empty table stays empty."""
    gone = cut(classes(documents, **options).where("doc_id != class_id").select(F.col("doc_id").alias("_gone")).distinct())
    return documents.join(small_broadcast(gone, gone.count(), 64), documents["doc_id"] == gone["_gone"], "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL: dict[str, str] = {}
