"""Each operator against a plain version of itself on small tables."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusflow.llm import exact_dedup, jaccard, licenses, neighbours, packing, segmentation, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"


def test_white_space_of_any_length():
    encoder = token_counts._encoder(*token_counts.default_tokenizer())
    for text in ["x" + " " * 3000 + "y", " " * 2500, "a\n" + " " * 1200 + "\n\n" + "\t" * 1500 + " the end", "\u3000" * 1100 + "b  c", "a " * 900 + " " * 1001 + "'s", "a" + "\x1c" * 1100 + "b"]:
        assert token_counts.tokens_in(encoder, text) == len(encoder.encode_ordinary(text))
    assert token_counts.tokens_in(encoder, " " * 1_000_000) > 0
    assert token_counts.tokens_in(encoder, "a" + " " * 1_000_000 + "b") == token_counts.tokens_in(encoder, " " * 999_999) + token_counts.tokens_in(encoder, " b") + 1


def test_license_blocks(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated\ndocumentation files"
    marked = "\n".join(f" * {line}" for line in grant.split("\n"))
    texts = ["intro\n\n" + grant + "\n \n\nmore", "/*\n" + marked + "\n */", "Released under the MIT License.", "a\n\n\nb\nReleased under\nthe MIT License", "plain\ntext", "", None]
    rows = spark.createDataFrame([(f"d{k}", t, "k") for k, t in enumerate(texts)], "doc_id string, text string, kind string")
    found = sorted((r.doc_id, r.kind, r.block_no, r.template) for r in licenses.license_scan(rows).collect())
    assert found == [("d0", "paragraph", 1, "mit-grant"), ("d1", "paragraph", 0, "mit-grant"), ("d2", "line", 0, "mit"), ("d3", "paragraph", 1, "mit")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def shingles(text, n=3):
    words = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", text.lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_pairs(texts, threshold):
    sets = {k: shingles(t) for k, t in texts.items()}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
            out[a, b] = j
    return out


def test_jaccard_join_finds_the_pairs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(3000)]
    texts, shared = {}, " ".join(rng.choice(words, 60))
    for base in range(60):
        body = list(rng.choice(words, 120))
        for copy in range(1 + base % 6):
            own = [w if rng.random() > 0.03 * copy else rng.choice(words) for w in body]
            texts[len(texts)] = " ".join(own) + ("\n" + shared if base % 4 == 0 else "") + (" Dup!" if copy == 2 else "")
    texts[len(texts)], texts[len(texts)] = texts[0], texts[0].upper()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.partner_id): r.jaccard for r in jaccard.all_pairs(rows, bucket=8, most=40).collect()}
    true = brute_pairs(texts, 0.5)
    assert set(found) <= set(true)
    assert len(found) >= 0.9 * len(true) > 100
    assert all(abs(found[p] - true[p]) < 1e-12 for p in found)


def roots(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_classes_of_copies_and_near_copies(spark):
    """A thousand exact copies, three hundred near copies of one text, pairs, and texts of their own; ids are strings."""
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 30, n)]
    copied, body = " ".join(text(40)), text(90)
    texts = [copied] * 1000 + [" ".join(body[:k] + text(1) + body[k:]) for k in rng.integers(0, 90, 300)]
    for _ in range(50):
        own = text(60)
        texts += [" ".join(own), " ".join(own[:50] + text(6))]
    texts += [" ".join(text(30)) for _ in range(100)]
    ids = [f"d{k:05}" for k in rng.permutation(len(texts))]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")
    sets = defaultdict(list)
    for i, t in zip(ids, texts):
        sets[t].append(i)
    leader = {t: min(own) for t, own in sets.items()}
    true = {(min(leader[x], leader[y]), max(leader[x], leader[y])): j for (x, y), j in brute_pairs({t: t for t in sets}, 0.5).items()}
    found = {r.doc_id: r for r in jaccard.classes(rows, most=100).collect()}
    size = {leader[t]: len(own) for t, own in sets.items()}
    links = Counter()
    for a, b in true:
        links[a] += size[b]
        links[b] += size[a]
    classed = roots([*true, *((leader[t], i) for t, own in sets.items() for i in own if len(own) > 1)])
    assert set(found) == set(classed)
    assert all(r.class_id == classed[i] for i, r in found.items())
    assert all(r.copies == len(sets[t]) and r.leader_id == leader[t] and r.links == links[leader[t]] for t, own in sets.items() for i in own if (r := found.get(i)))
    joined = jaccard.jaccard_join(rows, most=100).collect()
    assert {(r.doc_id, r.partner_id): round(r.jaccard, 12) for r in joined if not r.copy} == {p: round(j, 12) for p, j in true.items()}
    assert sorted(r.partner_id for r in joined if r.copy) == sorted(i for t, own in sets.items() for i in own if i != leader[t])
    kept = {r.doc_id for r in jaccard.keep_one(rows).collect()}
    assert kept == {i for i in ids if classed.get(i, i) == i}


def test_near_copies_beyond_a_node_are_compared_in_tiles(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 16, 64)
    sketch = np.where(rng.random((120, 64)) < 0.1, rng.integers(0, 1 << 16, (120, 64)), base).astype(np.uint16)
    rows = spark.createDataFrame([(5, k, bytearray(x.tobytes())) for k, x in enumerate(sketch)], "node long, sid long, sketch binary")
    tiles = jaccard._tiles(rows, 30)
    assert tiles.groupBy("node").count().agg({"count": "max"}).first()[0] < 60
    met = jaccard._join(tiles.repartition("node").sortWithinPartitions("node"), 0.5, 3, 8, 1 << 62).where("a is not null")
    assert {(r.a, r.b) for r in met.collect()} == set(itertools.combinations(range(120), 2))


def test_a_doc_id_of_unlike_texts_connects_them(spark):
    one, two = "a b c d e f g", "t u v w x y z"
    rows = spark.createDataFrame([(1, one), (7, one), (7, two), (9, two), (9, two), (4, "k l m n o")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.classes(rows).collect())) == [(1, 1, 1, 2, 0), (7, 1, 1, 2, 0), (7, 1, 7, 2, 0), (9, 1, 7, 2, 0)]


def test_local_paths_recall():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, (30, 64))
    rows = np.concatenate([np.where(rng.random((100, 64)) < 0.2, rng.integers(0, 1 << 16, (100, 64)), b) for b in base] + [rng.integers(0, 1 << 16, (500, 64))]).astype(np.uint16)
    rows[:, :5] = 7
    found = set()
    for i, j, agree in jaccard.local_paths(rows, 1, 0.5, 20, 5, 64):
        assert (agree == (rows[i] == rows[j]).sum(axis=1)).all()
        found |= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    true = {(i, i + 1 + int(j)) for i in range(len(rows)) for j in np.flatnonzero((rows[i] == rows[i + 1 :]).sum(axis=1) >= 32)}
    assert len(found & true) >= 0.95 * len(true)


def test_jaccard_join_runs_until_pairs_at_the_threshold_are_found(spark):
    """Beside a group of near copies whose pairs are most of all."""
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 30, n)]
    body = text(150)
    texts = {k: " ".join([*body, f"own{k}"]) for k in range(120)}
    for k in range(250):
        shared = text(80)
        texts[1000 + 2 * k], texts[1001 + 2 * k] = (" ".join(shared + text(34)) for _ in range(2))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.partner_id) for r in jaccard.all_pairs(rows).collect()}
    small = {(1000 + 2 * k, 1001 + 2 * k) for k in range(250)}
    assert len(found - small) == 120 * 119 // 2
    assert len(found & small) >= 0.97 * len(small)


@pytest.mark.parametrize("free", [0, 2])
def test_local_paths_compares_what_a_hot_group_leaves(free):
    """A group of near copies holds 60 % of a node; others share a few tokens with it and are near copies in pairs."""
    rng = np.random.default_rng(2)
    fresh = lambda *n: rng.integers(1000, 1 << 16, n)
    base = fresh(64)
    hot = np.where(rng.random((240, 64)) < 0.05, fresh(240, 64), base)
    firsts = np.where(rng.random((80, 64)) < 0.1, base, fresh(80, 64))
    rest = np.concatenate([firsts, np.where(rng.random((80, 64)) < 0.4, fresh(80, 64), firsts)])
    rows = np.concatenate([hot, rest]).astype(np.uint16)
    rows[:240, :free] = fresh(240, free)
    found = set()
    for i, j, _ in jaccard.local_paths(rows, 1, 0.5, 20, 5, 64):
        found |= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    true = {(240 + k, 320 + k) for k in range(80) if (rows[240 + k] == rows[320 + k]).sum() >= 32}
    assert len(true) > 70 and len(found & true) >= 0.95 * len(true)


def test_long_texts_have_the_same_grams(monkeypatch):
    text = " ".join(f"w{k * k % 977}" for k in range(4000))
    whole = jaccard.signatures([text], 3)
    monkeypatch.setattr(jaccard, "SLICE", 500)
    cut = jaccard.signatures([text], 3)
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(min(p), max(p)) for p in rng.integers(0, 300, (220, 2)).tolist() if p[0] != p[1]} | {(k, k + 1) for k in range(400, 430)})
    expected = roots(pairs)
    found = dict(map(tuple, jaccard.components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert all(found.get(x, x) == expected[x] for x in expected)
    star = [(0, k) for k in range(1, 500)]
    assert {r.root for r in jaccard.components(spark.createDataFrame(star, "u long, v long")).collect()} == {0}


def test_exact_dedup_against_history(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    history = documents.where("doc_id < 60")
    seen, expected = {r.text for r in rows if r.doc_id < 60}, set()
    for r in rows:
        if r.text not in seen:
            seen.add(r.text)
            expected.add(r.doc_id)
    assert {r.doc_id for r in exact_dedup.exact_dedup(documents, history).collect()} == expected


def test_exact_dedup_by_the_index(spark, monkeypatch):
    """The later half's copies of the earlier half's texts go by look_up alone."""
    rows = [(k, f"text {k}", k) for k in range(50)] + [(100 + k, "hot", k) for k in range(200)] + [(400 + k, f"text {k}", k) for k in range(50)] + [(None, "hot", 1), (None, None, 2), (300, "late", 1), (301, "late", 2), (301, "late", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _same int")
    ids = lambda: sorted((r.doc_id is None, r.doc_id or 0) for r in exact_dedup.exact_dedup(table).collect())
    assert ids() == [(False, k) for k in [*range(50), 100, 300]] + [(True, 0)]
    named = table.selectExpr("'doc' || lpad(doc_id, 5, '0') as doc_id", "text", "_same")
    assert exact_dedup.exact_dedup(named).count() == 53
    real = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda *a: real(*a).selectExpr("digest", "least", "rows", "false as member", "locator"))
    assert len(ids()) > 53


def test_look_up_gives_locators(spark):
    rows = [(bytes([k]) * 32, None if k == 3 else f"doc{k}") for k in range(20)]
    index = exact_dedup.build_index(spark.createDataFrame(rows, "digest binary, locator string"), 3)
    asked = spark.createDataFrame([(bytes([k]) * 32, k) for k in range(40)], "digest binary, least long")
    found = {r.least: (r.member, r.locator) for r in exact_dedup.look_up(index, asked, 3).collect()}
    assert found == {k: (k < 20, f"doc{k}" if k < 20 and k != 3 else None) for k in range(40)}


def test_perfect_hash():
    words = np.random.default_rng(3).integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    hashed = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(words).to_bytes())
    assert sorted(hashed.slots(words)) == list(range(5000))
    repeated = exact_dedup.PerfectHash.build(np.repeat(words[:3], 2, axis=0))  # never separable: goes to the list
    assert len(repeated.rest) == 6


def test_packing_keeps_every_character(documents):
    texts = {r.doc_id: r.text for r in documents.collect() if r.text}
    pieces = defaultdict(list)
    packs = packing.pack(documents, window=2048, bins=64).collect()
    assert len({p.pack_id for p in packs}) == len(packs)
    for p in packs:
        assert p.used == len(p.text) + 1 <= 2048
        assert p.text == "\n".join(texts[i][s : s + n] for i, s, n in zip(p.doc_ids, p.starts, p.lengths))
        for i, s, n in zip(p.doc_ids, p.starts, p.lengths):
            pieces[i].append((s, n))
    assert {i: "".join(texts[i][s : s + n] for s, n in sorted(x)) for i, x in pieces.items()} == texts


def test_plan_places_each_piece_once():
    rng = np.random.default_rng(4)
    for _ in range(10):
        histogram = rng.integers(0, 40, 24)
        made = packing.plan(histogram)
        used, placed = np.zeros(made.packs, int), np.zeros(24, int)
        for size, first, last, base in made.rows:
            placed[size - 1] += last - first + 1
            used[base : base + last - first + 1] += size
        assert (placed == histogram).all() and used.max() <= 24
        assert made.packs <= 1.2 * (histogram * np.arange(1, 25)).sum() / 24 + 3


def test_nnls_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((9, 14)), rng.normal(size=9)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert x.min() >= 0 and gradient.max() < 1e-6 and abs(gradient @ x) < 1e-6


def test_strategies():
    assert sorted(packing.strategies(5, 3)) == sorted([(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1)])


def test_shards_match_the_mixture(spark, documents):
    rows = sharding.shard(documents, shards=8).collect()
    total = Counter(r.source for r in rows)
    for s in range(8):
        own = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(own[k] - total[k] / 8) <= 2 for k in total)
    again = sharding.shard(documents.repartition(7), shards=8).collect()
    assert {(r.doc_id, r.position) for r in again} == {(r.doc_id, r.position) for r in rows}


def test_merged_positions_are_those_of_a_sort(spark):
    rows = [(k, None if k % 7 == 0 else f"s{k % 3 * (k % 5)}", f"text {k}") for k in range(500)] + [(None, None, "x"), (3, "s0", "again")]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    merged, ranked = (sharding.shard(table, 8, counted=c).select("source", "source_rank", "position", "shard").collect() for c in (64, 2))
    assert sorted(r.position for r in merged) == list(range(1, 503))
    assert {(r.source, r.source_rank): (r.position, r.shard) for r in merged} == {(r.source, r.source_rank): (r.position, r.shard) for r in ranked}
    size = Counter(r.source for r in merged)
    key = lambda r: ((2 * r.source_rank - 1) / (2 * size[r.source]), r.source or "", r.source_rank)
    assert [r.position for r in sorted(merged, key=key)] == list(range(1, 503))
    big = spark.range(1).selectExpr("'b' source", "3000000001L rank", "20000000000L size")
    place = sharding._merged([("a", 10_000_000_000), ("b", 20_000_000_000), (None, 5)], *map(big.__getitem__, big.columns))
    assert big.select(place).first()[0] == 3000000001 + 1500000000 + 1


def test_histogram(documents):
    vocabulary, pattern = token_counts.default_tokenizer()
    encoder = token_counts._encoder(vocabulary, pattern)
    lengths = np.array([len(encoder.encode_ordinary(r.text)) for r in documents.collect()])
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(documents, vocabulary, pattern)).cache()
    for r in histogram.collect():
        assert r.docs == (lengths == r.length).sum() and r.docs_from == (lengths >= r.length).sum()
        assert r.tokens_from == lengths[lengths >= r.length].sum() and r.truncated_total == np.minimum(lengths, r.length).sum()
    marks = {q: r.length for r in histogram.collect() for q in r.quantiles.split(",") if q}
    assert {float(q): n for q, n in marks.items()} == {q: np.sort(lengths)[int(np.ceil(q * len(lengths))) - 1] for q in token_counts.QUANTILES}
    for limit in (0, 1, 500, 10**6):
        row = token_counts.at_limit(histogram, limit).first()
        assert row.truncated_total == np.minimum(lengths, limit).sum() and row.docs_cut == (lengths > limit).sum()


def labelled(folder):
    d, labels = (pq.read_table(f"/root/testdata/{folder}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    return d.merge(labels, on="doc_id").sort_values("doc_id")


def rejected(model, texts):
    total, count = toxicity.sums(list(texts), model.weights, model.bits)
    return total / np.maximum(count, 1) + model.bias >= model.threshold


def test_toxicity_on_held_out_rows():
    """Of all labelled rows every second one is learnt from, some 220 toxic ones."""
    rows = labelled("sf0.1")
    model = toxicity.fit(list(rows.text[::2]), list(rows.toxic[::2]))
    said, truth = rejected(model, rows.text[1::2]), rows.toxic[1::2].to_numpy() == 1
    assert said[truth].mean() > 0.9 and said[~truth].mean() < 0.03


def test_toxicity_finds_what_is_planted_among_plain_texts():
    rng = np.random.default_rng(0)
    plain = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 300, n))
    bad = lambda: plain(30) + f" you {rng.choice(['stupid', 'worthless'])} {rng.choice(['idiot', 'moron'])} " + plain(30)
    texts, toxic = [bad() if k % 5 == 0 else plain(60) for k in range(200)], [int(k % 5 == 0) for k in range(200)]
    model = toxicity.fit(texts, toxic, bits=16)
    assert rejected(model, [bad() for _ in range(50)]).mean() > 0.9
    assert rejected(model, [plain(60) for _ in range(200)]).mean() < 0.03


def test_log_count_ratios_and_gradient():
    texts, toxic, bits, alpha = ["abcd", "bcd e", "abc abc", "xyz", ""], [1, 0, 1, 0, 0], 12, 0.5
    examples = toxicity.Examples.of(texts, toxic, bits)
    p, q = Counter(), Counter()
    for text, y in zip(texts, toxic):
        codes = np.frombuffer(f" {' '.join(text.split())} ".encode("utf-32-le"), np.uint32)
        for slot in {int(s) for n in toxicity.ORDERS for s in toxicity._hashed(codes, n, bits)}:
            (p if y else q)[slot] += 1
    up, uq = (sum(c.values()) + alpha * (1 << bits) for c in (p, q))
    ratio, seen = toxicity.log_count_ratios(examples, np.ones(5, dtype=bool), bits, alpha)
    assert np.allclose(ratio, [np.log((alpha + p[k]) / up * uq / (alpha + q[k])) for k in range(1 << bits)])
    assert (seen == [p[k] + q[k] for k in range(1 << bits)]).all()
    losses = []

    def spy(f, x, steps):
        value, grad = f(x)
        for k in (0, len(x) // 2, len(x) - 1):
            step = np.zeros(len(x))
            step[k] = 1e-2
            losses.append((grad[k], (f(x + step)[0] - f(x - step)[0]) / 2e-2))
        return real(f, x, steps)

    real, toxicity.minimise = toxicity.minimise, spy
    try:
        toxicity._linear(examples, np.ones(5, dtype=bool), bits, alpha, 1e-3, 5, 1, 0.0)
    finally:
        toxicity.minimise = real
    assert np.allclose(*zip(*losses), rtol=1e-2, atol=1e-5)


def test_minimise():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))
    b = rng.normal(size=30)
    f = lambda x: (0.5 * ((a @ x - b) ** 2).sum(), a.T @ (a @ x - b))
    assert np.allclose(toxicity.minimise(f, np.zeros(12), 200), np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-2)


@pytest.mark.parametrize("most", [0.0, 0.1, 1.0])
def test_threshold_is_the_best_allowed(most):
    rng = np.random.default_rng(2)
    scores, toxic = np.concatenate((rng.normal(0, 1, 60), rng.normal(1.5, 1, 20))), np.repeat([0.0, 1.0], [60, 20])
    at = toxicity.pick_threshold(scores, toxic, most)
    error = lambda t: ((scores[toxic == 1] < t).mean() + (scores[toxic == 0] >= t).mean())
    allowed = [t for t in [*scores, scores.max() + 1] if (scores[toxic == 0] >= t).mean() <= most]
    assert (scores[toxic == 0] >= at).mean() <= most and error(at) <= min(map(error, allowed)) + 1e-12


def test_train_bounds_and_classes(spark):
    schema = "doc_id string, text string, y int, n int"
    texts = [(f"d{k}", ("you idiot " if k % 2 else "what a lovely day ") + "x" * k, 1, 2) for k in range(40)]
    texts += [("d1", "you idiot", 1, 2), ("d5", None, 1, 1), (None, "you idiot", 1, 1), ("long", "idiot " * 1000, 1, 1)]
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(40)] + [("d1", 0), ("long", 1), (None, 1), ("d2", None), ("none", 1)], "doc_id string, toxic int")
    documents = spark.createDataFrame(texts, schema)
    model = toxicity.train(documents, labels, class_chars=3000, bits=12)
    assert rejected(model, ["you idiot xx", "what a lovely day xx"]).tolist() == [True, False]
    for table, known in ((documents, labels.where("toxic = 0")), (documents.limit(0), labels), (documents, labels.limit(0))):
        assert toxicity.train(table, known, bits=12).threshold == float("inf")
    assert toxicity.keep_clean(documents, toxicity.train(documents, labels.limit(0), bits=12)).count() == documents.count()


def test_toxicity_long_texts(monkeypatch):
    weights = np.random.default_rng(0).normal(size=1 << 12).astype(np.float32)
    texts = ["a b c d " * 900, "", None, "xyz"]
    whole = toxicity.sums(texts, weights, 12)
    monkeypatch.setattr(toxicity, "SLICE", 100)
    cut = toxicity.sums(texts, weights, 12)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()


def brute_segmentations(pieces, text):
    edges = pieces.lattice(text)
    paths = {0: [(0.0, [])]}
    for end in range(1, len(text) + 1):
        paths[end] = [(a + s, p + i) for start, i, s in edges[end] for a, p in paths[start]]
    return paths[len(text)]


@pytest.mark.parametrize("text", ["hello wor", "a  b", "né\n", "日本 x", "the the", "▁x", "zz\tq", "", "I am 12"])
def test_segmentations(text):
    pieces = segmentation.Pieces(segmentation.default_model())
    normal = pieces.sp.normalize(text)
    every = brute_segmentations(pieces, normal) if normal else [(0.0, [])]
    found = list(segmentation.segment(pieces, [text], 5))
    assert [round(s, 6) for _, _, s, *_ in found] == [round(s, 6) for s in sorted((s for s, _ in every), reverse=True)[:5]]
    assert len({tuple(f[3]) for f in found}) == len(found) and {tuple(f[3]) for f in found} <= {tuple(p) for _, p in every}
    assert all(pieces.sp.decode(f[3].tolist()) == pieces.sp.decode(pieces.sp.encode(text)) for f in found if len(f[3]))
    assert all(f[4] == (pieces.sp.decode(f[3].tolist()) == text) for f in found if len(f[3]))


def test_segmentation_round_trip(spark, documents):
    model = segmentation.default_model()
    some = documents.orderBy("doc_id").limit(60)
    texts = {r.doc_id: r.text for r in some.collect()}
    found = segmentation.decode(segmentation.n_best_segmentations(some, model, 3), model).collect()
    assert {r.doc_id for r in found} == set(texts)
    assert all(r.exact and r.text == texts[r.doc_id] for r in found)


def test_long_words():
    """Against the plain search where that is quick, and at a million characters."""
    pieces = segmentation.Pieces(segmentation.default_model())
    rng = np.random.default_rng(4)
    for size in (1, 2, 30, 80, 200):
        for letters in ("ab", "etaoinshrdlu▁é日"):
            word = "".join(rng.choice(list(letters), size))
            plain, found = pieces.n_best(word, 4), pieces.n_best_long(word, 4)
            assert [round(s, 6) for s, _ in found] == [round(s, 6) for s, _ in plain]
            assert len({tuple(i) for _, i in found}) == len(found)
    text = "".join(rng.choice(list("abcdefghij"), 1_000_000))
    rows = list(segmentation.segment(pieces, ["short", text], 2))
    assert [r[:2] for r in rows] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert all(pieces.sp.decode(ids.tolist()) == text and exact for i, _, _, ids, exact in rows if i == 1)


def test_decode_writes_what_the_model_does(spark):
    model = segmentation.default_model()
    sp = segmentation.Pieces(model).sp
    byte = {sp.id_to_piece(i): i for i in range(300)}
    lists = [[], None, sp.encode("hello  world"), sp.encode(" x"), sp.encode("日本\n\t😀"), [byte["<0xE6>"]], [0, 5], [1], sp.encode("▁"), [byte["<0x20>"], 400]]
    rows = spark.createDataFrame([(k, ids, "t", k) for k, ids in enumerate(lists)], "k int, ids array<int>, text string, rank int")
    found = {r.k: r.text_ for r in segmentation.decode(rows, model).collect()}
    assert found == {k: None if ids is None else sp.decode(ids) if ids else "" for k, ids in enumerate(lists)}
    assert segmentation.decode(rows.limit(0), model).count() == 0


def test_words_longer_than_the_vectors():
    pieces = segmentation.Pieces(segmentation.default_model())
    word = "▁" + "internationalisation" * 8
    slow = pieces.n_best(word, 2)
    best, gap, tokens, count = pieces._best_of([word[:60], "▁a"], 64)
    assert best[0] == pieces.n_best(word[:60], 1)[0][0] and slow[0][0] >= slow[1][0]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 32)), np.repeat(rng.normal(size=(30, 32)), 20, axis=0) + rng.normal(scale=0.1, size=(600, 32))]).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in neighbours.neighbours(rows, k=10, list_rows=256, tile=200, queries_per_tile=200, rerank=32).collect():
        found[r.vec_id].add(r.neighbour_id)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    top = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(found[k] & set(top[k])) / 10 for k in range(len(x))]) >= 0.9


def test_neighbours_of_some_queries_with_string_ids(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    names = [f"v{k:04}" for k in rng.permutation(700)]
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "vec_id string, embedding array<float>")
    found = neighbours.neighbours(rows, k=5, queries=__import__("pyspark").sql.functions.col("vec_id").endswith("00"), list_rows=10_000, rerank=200).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    true = {(names[k], names[j]) for k in range(700) if names[k].endswith("00") for j in np.argsort(-scores[k])[:5]}
    assert len(found) == 35 == len(true & {(r.vec_id, r.neighbour_id) for r in found})
    assert all(abs(r.score - scores[names.index(r.vec_id), names.index(r.neighbour_id)]) < 1e-4 for r in found)


def test_anisotropic_codes_lower_the_loss():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    q = neighbours.Quantiser(rng.normal(size=(4, 16, 2)).astype(np.float32), 4.0)

    def loss(codes):
        r = x - q.books[np.arange(4)[None], codes].reshape(len(x), 8)
        return (r**2).sum() + 3.0 * ((r * x).sum(axis=1) ** 2 / (x**2).sum(axis=1)).sum()

    assert loss(q.encode(x)) < loss(q.encode(x, rounds=0))
    looked = neighbours.tables(q.books, x[:5])
    codes = q.encode(x)
    assert np.allclose(neighbours.scan(neighbours.packed(codes), looked), q.books[np.arange(4)[None], codes].reshape(len(x), 8) @ x[:5].T, atol=1e-4)
