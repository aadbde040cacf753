"""Nulls, empty tables, clashing names, repeated rows and long texts, for each operator."""

from collections import Counter

import pytest

from corpusflow.llm import chat, exact_dedup, jaccard, licenses, neighbours, packing, segmentation, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, rank int, sketch int, shard string, node int, at double"
LONG = " ".join(f"word{k % 5000}" for k in range(60_000))
TEXTS = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta iota", "Released under the MIT License.", "", None, "x", "一二三\n四五", LONG, " \n "]
MODEL = toxicity.fit([t for k in range(40) for t in (f"you are an idiot {k}", f"what a lovely day {k}")], [1, 0] * 40, bits=12)


def rows():
    out = [(k, t, None, None if k % 3 else "s", None, "a", 1, 2, "b", 3, 0.5) for k, t in enumerate(TEXTS)]
    return out + out + [(None, TEXTS[0], None, "s", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "jaccard_join": jaccard.jaccard_join,
    "classes": jaccard.classes,
    "all_pairs": jaccard.all_pairs,
    "keep_one": jaccard.keep_one,
    "license_scan": licenses.license_scan,
    "shard": sharding.shard,
    "pack": packing.pack,
    "keep_clean": lambda d: toxicity.keep_clean(d, MODEL),
    "n_best": lambda d: segmentation.n_best_segmentations(d, segmentation.default_model(), 2),
    "histogram": lambda d: token_counts.length_histogram(token_counts.encoded_lengths(d, *token_counts.default_tokenizer())),
}


def results(name, documents):
    return OPERATORS[name](documents).collect()


def test_awkward_rows(spark):
    """What each operator makes of every case; rows 0 to 8 come twice, one more has TEXTS[0] and no id, one nothing."""
    documents = spark.createDataFrame(rows(), SCHEMA).cache()
    twice = [k for k, t in enumerate(TEXTS) if t is not None]
    assert len(results("exact_dedup", documents)) == 11  # eight texts and three rows without one
    joined = results("jaccard_join", documents)
    assert [(r.doc_id, r.partner_id, r.copy) for r in joined] == [(0, 1, False)] and joined[0].jaccard == 5 / 7
    assert sorted((r.doc_id, r.class_id, r.leader_id, r.copies, r.links) for r in results("classes", documents)) == [(0, 0, 0, 1, 1), (1, 0, 1, 1, 1)]
    assert [(r.doc_id, r.partner_id) for r in results("all_pairs", documents)] == [(0, 1)]
    kept = results("keep_one", documents)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, k) for k in range(9) for _ in range(2) if k != 1] + [(True, 0)] * 2
    assert [(r.doc_id, r.kind, r.block_no, r.template, r.overlap) for r in results("license_scan", documents)] == [(2, "line", 0, "mit", 5)] * 2
    sharded = results("shard", documents)
    assert sorted(r.position for r in sharded) == list(range(1, 21)) and all(0 <= r.shard_ < 64 for r in sharded)
    packs = results("pack", documents)
    pieces = Counter((i, s, n) for p in packs for i, s, n in zip(p.doc_ids, p.starts, p.lengths))
    sizes = Counter({(i, s, min(8191, len(t) - s)): 2 + (t == TEXTS[0] and False) for i, t in enumerate(TEXTS) if t for s in range(0, len(t), 8191)})
    sizes[None, 0, len(TEXTS[0])] = 1
    assert pieces == sizes
    clean = results("keep_clean", documents)
    assert sum(r.text is None or not r.text.strip() for r in clean) == 7  # texts without anything to judge stay
    assert all(n in (2, 3) for n in Counter(r.text for r in clean if r.text).values())
    assert len(clean) == sum(r.toxicity is None or r.toxicity < MODEL.threshold for r in toxicity.score(documents, MODEL).collect())
    best = results("n_best", documents)
    assert Counter(r.doc_id for r in best if r["rank"] == 1) == Counter({k: 2 for k in twice}) + Counter([None])
    assert [(r.score, r.ids, r.exact) for r in best if r.doc_id == 3] == [(0.0, [], True)] * 2
    histogram = results("histogram", documents)
    assert sum(r.docs for r in histogram) == 20 and next(r.docs for r in histogram if r.length == 0) == 5


STRINGS = "doc_id string, text string, source string"


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_other_types(spark, name):
    rows = [("b", TEXTS[0], "s"), ("a", TEXTS[1], "s"), ("c", TEXTS[2], None), ("c2", TEXTS[2], "t"), (None, "x", "t")]
    found = results(name, spark.createDataFrame(rows, STRINGS))
    assert found
    ids = {r.doc_id for r in found if "doc_id" in r} | {i for r in found if "doc_ids" in r for i in r.doc_ids}
    assert ids <= {"a", "b", "c", "c2", None}
    if name == "classes":
        assert sorted((r.doc_id, r.class_id) for r in found) == [("a", "a"), ("b", "a"), ("c", "c"), ("c2", "c")]
    if name in ("keep_one", "exact_dedup"):
        assert ids == ({"a", "c", None} if name == "keep_one" else {"a", "b", "c", None})


def test_chat_ids_and_clashing_names(spark):
    data = [("x", 0, "user", "hi", 1, "t"), ("x", 1, "assistant", "yo", 1, "t")]
    found = chat.prefix_targets(spark.createDataFrame(data, "conv_id string, turn int, role string, text string, turns int, shown string")).collect()
    assert [(r.conv_id, r.turn, r.n_context) for r in found] == [("x", 1, 1)]
    long = "y" * 3_000_000
    one = chat.prefix_targets(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "ok")], "conv_id long, turn int, role string, text string")).first()
    assert len(one.text) == one.train_end and one.text[one.train_start : one.train_end] == "ok<|im_end|>\n"


def test_histogram_of_nothing(spark):
    empty = token_counts.length_histogram(spark.createDataFrame([(None,)], "tokens long"))
    assert tuple(token_counts.at_limit(empty.withColumn("limit", empty.length), 5).first()) == (5, 0, 0, 0)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_chat_awkward(spark):
    schema = "conv_id long, turn long, role string, text string, context string, reply int"
    data = [(1, 0, "user", "hi", None, 1), (1, 1, "assistant", "yo", None, 1), (1, 1, "assistant", "yo", None, 1), (1, None, "assistant", None, None, 1), (1, 3, None, "?", "c", 1), (1, 4, "assistant", "", "c", 1), (None, 0, "assistant", "lost", None, 2), (2, 0, "assistant", "first", None, 3)]
    found = sorted(chat.prefix_targets(spark.createDataFrame(data, schema)).collect())
    assert [(r.conv_id, r.turn, r.n_context) for r in found] == [(1, 1, 1), (1, 1, 2), (2, 0, 0)]
    for r in found:
        assert r.text[r.train_start : r.train_end] in ("yo<|im_end|>\n", "first<|im_end|>\n")
        assert r.train_end == len(r.text)
    assert chat.prefix_targets(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_awkward(spark):
    schema = "vec_id long, embedding array<float>, label int, list int, codes string"
    data = [(1, [1.0, 0.0, 0.0], 1, 1, ""), (2, [1.0, 0.0, 0.0], 1, 1, ""), (3, [0.0, 1.0, 0.0], None, None, None), (3, [0.0, 1.0, 0.0], None, None, None), (4, None, 1, 1, ""), (None, [1.0, 1.0, 1.0], 1, 1, ""), (5, [1.0], 1, 1, ""), (6, [float("nan"), 0.0, 0.0], 1, 1, ""), (7, [0.0, 0.0, 0.0], 1, 1, "")]
    found = sorted(tuple(r) for r in neighbours.neighbours(spark.createDataFrame(data, schema), k=2).collect())
    assert found == [(1, 2, 1, 1.0), (1, 3, 2, 0.0), (2, 1, 1, 1.0), (2, 3, 2, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (7, 1, 1, 0.0), (7, 2, 2, 0.0)]
    assert neighbours.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.neighbours(spark.createDataFrame(data[:1], schema)).count() == 0


def test_long_words_and_blanks(spark):
    """A million spaces, a word of a million characters and a hundred thousand repeated words, through each operator."""
    texts = [" " * 1_000_000, "a" + "bc" * 500_000, "again " * 100_000]
    documents = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").cache()
    assert len(results("exact_dedup", documents)) == len(results("keep_one", documents)) == len(results("shard", documents)) == 3
    assert sorted(r.tokens for r in token_counts.encoded_lengths(documents, *token_counts.default_tokenizer()).collect())[0] > 100_000
    best = results("n_best", documents)
    assert Counter(r.doc_id for r in best) == Counter({0: 2, 1: 2, 2: 2}) and all(r.exact for r in best)
    assert sum(n for p in results("pack", documents) for n in p.lengths) == sum(map(len, texts))
    assert results("license_scan", documents) == results("classes", documents) == []
    assert len(results("keep_clean", documents)) in (1, 2, 3)
