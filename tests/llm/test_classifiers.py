import zlib

import numpy as np
import pytest

from vigil.llm import quality, toxicity
from vigil.llm.terms import LexicalTerms, StyleTerms, shape

DOCS = "doc_id long, text string, score string, held_out string"
LABELS = "doc_id long, quality int, toxic int"


def test_shape_and_terms():
    assert shape("Hello") == "Aa" and shape("it's") == "a'a" and shape("12.5%%%") == "0.0%"
    at, n = StyleTerms().counts("The the the")
    assert n.sum() > 3 and (np.diff(at) > 0).all()
    assert len(StyleTerms().counts("")[0]) == 1 and len(LexicalTerms().present("")) == 0
    assert len(LexicalTerms().present("a idiot's")) == 5  # a, s, idiot, its beginnings


def test_neighbours_match_brute_force():
    rng = np.random.default_rng(0)
    sample = [(int(rng.integers(2)), np.sort(rng.choice(60, 9, replace=False)), rng.integers(1, 5, 9)) for _ in range(80)]
    model = quality.fit(sample, 60, rank=10)
    counts = np.zeros((5, 60), np.float32)
    counts[:, :9] = rng.integers(0, 4, (5, 9))
    got = model.scores(counts)
    for row, score in zip(model.project(counts), got, strict=True):
        cos = [float(row @ v) for v in model.vectors]
        near = sorted(range(80), key=lambda i: -cos[i])[: quality.NEIGHBOURS]
        w = np.array([max(cos[i], 0) ** quality.SHARPNESS + 1e-12 for i in near])
        assert score == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-5)


def test_machine_learns_an_interaction():
    # label 1 where just one of the terms occurs: no additive weights express that
    rng = np.random.default_rng(1)
    sample = []
    for _ in range(1200):
        a, b = rng.integers(2), rng.integers(2)
        sample.append((int(a != b), np.array([x for x, on in ((3, a), (7, b), (9 + rng.integers(9), 1)) if on]), None))
    model = toxicity.fit(sample, 32, epochs=60)
    scores = [model.score(np.array([*x, k])) for x in ((3,), (7,), (3, 7), ()) for k in range(9, 18)]
    assert min(scores[:18]) > 0.6 and max(scores[18:]) < 0.4


@pytest.mark.parametrize(("module", "column", "floor"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, column, floor):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT]
    assert all(got[r.doc_id].held_out for r in held)
    right = [got[r.doc_id].predicted == r[column] for r in held]
    assert sum(right) / len(right) >= floor
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_do_not_matter(spark, module, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    flipped = [(r.doc_id, 1 - r.quality, 1 - r.toxic) if zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT else tuple(r) for r in labels.collect()]
    a = {r.doc_id: r.score for r in module.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in module.classify(docs, spark.createDataFrame(flipped, LABELS)).collect()}
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_rows(spark, module):
    rows = [(1, None, "", ""), (None, "", "", None), (2, "word " * 100_000, "", ""), (3, "a b", "", ""), (3, "a b", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in module.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1, 1), (3, 1, 1), (3, None, None), (None, 0, 0)], LABELS)
    assert len(module.classify(docs, one).collect()) == 5
    assert module.classify(spark.createDataFrame([], DOCS), one).count() == 0


def test_keep_good_returns_all_columns(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == wanted


def test_machine_scores_match_a_naive_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(np.array([2, 5, 7, 11, 30]), 0.3, rng.normal(size=5), rng.normal(size=(5, 4)))
    for present in ([], [2], [5, 7], [2, 5, 7, 11, 30], [1, 2, 3, 30, 31]):
        own = [model.kept.tolist().index(x) for x in present if x in model.kept]
        total = model.bias + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for i in own for j in own if i < j)
        assert model.score(np.array(present, np.int64)) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_first_step_follows_the_gradient():
    """One adaptive step from zero sums moves each parameter against the sign of its gradient, told by differences."""
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.choice(6, rng.integers(1, 5), replace=False)) for _ in range(40)]
    y = rng.integers(0, 2, 40).astype(np.float32)
    start = toxicity._descend(docs, y, np.arange(6), 3, 0, 0.1, 0.0, 5)
    after = toxicity._descend(docs, y, np.arange(6), 3, 1, 0.1, 0.0, 5)

    def loss(w, v):
        model = toxicity.FactorizationMachine(start.kept, start.bias, w, v)
        p = np.array([model.score(d) for d in docs])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    h = 1e-5
    for i in range(6):
        step = np.eye(6)[i] * h
        g = (loss(start.weights + step, start.factors) - loss(start.weights - step, start.factors)) / (2 * h)
        assert np.sign(after.weights[i] - start.weights[i]) == -np.sign(g)
        for f in range(3):
            step = np.zeros((6, 3))
            step[i, f] = h
            g = (loss(start.weights, start.factors + step) - loss(start.weights, start.factors - step)) / (2 * h)
            if abs(g) > 1e-4:
                assert np.sign(after.factors[i, f] - start.factors[i, f]) == -np.sign(g)


def test_terms_that_matter_only_together_are_learnt_among_many():
    """The label is whether one of two words occurs without the other; thousands of others depend on it more by chance."""
    rng = np.random.default_rng(1)
    common = 1 / np.arange(1, 20_001)

    def rows(n):
        out = []
        for _ in range(n):
            a, b = rng.integers(2), rng.integers(2)
            words = set((100 + rng.choice(20_000, 60, p=common / common.sum())).tolist()) | ({3} if a else set()) | ({7} if b else set())
            out.append((int(a != b), np.array(sorted(words)), None))
        return out

    sample, unseen = rows(2500), rows(300)
    alone = toxicity.chi_square([x for _, x, _ in sample], np.array([y for y, _, _ in sample], float), 1 << 15)
    assert max(alone[3], alone[7]) < toxicity.EVIDENCE and (alone > max(alone[3], alone[7])).sum() > 2048
    model = toxicity.fit(sample, 1 << 15)
    assert {3, 7} <= set(model.kept.tolist())
    assert np.mean([(model.score(x) >= 0.5) == y for y, x, _ in unseen]) > 0.95


def test_families_of_like_texts_are_no_pairs():
    words = [np.arange(k, k + 40) for k in (0, 100, 200) for _ in range(30)]
    y = np.repeat([1.0, 0.0, 1.0], 30)
    assert len(toxicity.paired_terms(words, y, np.full(90, 0.6), 300)) == 0
