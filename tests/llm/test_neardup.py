import random

import numpy as np

from vigil.llm import neardup
from vigil.llm.components import connected_components

SCHEMA = "doc_id long, text string, node string, class int, sketch string"


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute(rows, percent=85):
    sets = sets_of(rows)
    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return {doc_id: (len(s), low[find(i)], doc_id == low[find(i)]) for i, (doc_id, s) in enumerate(sets)}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "", 1, "") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}


def family(n, size, edits, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_matches_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_one_large_family(spark, monkeypatch):
    rows = family(300, 200, 9)
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(neardup, "NODE", 40)  # nodes branch, and what stays large is cut into blocks
    monkeypatch.setattr(neardup, "DEPTH", 3)
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(neardup, "SHRINK", 0.1)  # nothing branches
    assert run(spark, rows) == brute(rows)


def test_isolated_pairs_in_hot_nodes(spark, monkeypatch):
    # all texts share a passage, so that nodes are hot; each pair is right at the threshold and linked by nothing else
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(150):
        own = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        # of 130 shingles 10 are in one text only, and as many in the other: 120 of 140
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:-10] + [f"e{rng.randrange(10**9)}" for _ in range(10)]))]
    monkeypatch.setattr(neardup, "NODE", 24)
    want = brute(rows)
    assert sum(not kept for _, _, kept in want.values()) == 150
    assert run(spark, rows) == want


def test_groups_are_bounded_by_their_shingles(spark, monkeypatch):
    rows = family(200, 150, 9)
    monkeypatch.setattr(neardup, "SHINGLES", 3000)
    assert run(spark, rows) == brute(rows)
    classes = spark.createDataFrame([(i, 150, bytes([7]) * neardup.SKETCH, [1, 2]) for i in range(200)], "class long, n long, sketch binary, tokens array<long>")
    nodes, large = neardup._nodes(classes)
    assert large is not None
    sizes = [r["count"] for r in nodes.groupBy("node").count().collect()]
    assert max(sizes) * 150 <= neardup.SHINGLES * 1.3 + 150 * neardup.PIVOTS


def test_more_trees_for_lower_thresholds():
    assert neardup.n_trees(85) == 13 and neardup.n_trees(80) == 19 and neardup.n_trees(100) == 1


def test_one_row_of_each_component_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c + " end"), (None, "only here x y z"), (None, "only here x y z"), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, "", n, "") for n, (i, t) in enumerate(rows)], SCHEMA).withColumnRenamed("node", "_row")
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "only here x y z"), (5, None), (5, "")], key=str)


def test_words_split_at_ascii_space_only():
    assert neardup.words_of("A b C\x1cd\x0be\tÄ") == ["a b".encode(), b"c\x1cd", b"e", "Ä".encode()]
    assert len(neardup.shingles("a b c")) == 1 and len(neardup.shingles(" \n")) == 0
    assert (neardup.shingles("a b c") != neardup.shingles("c b a")).all()


def test_confirmed_links_use_the_exact_bound():
    a = np.arange(100, dtype=np.uint64)
    at = np.arange(85, dtype=np.uint64)
    assert neardup.confirmed_links(np.array([1, 2]), [a, at], 85) == [(1, 2)]
    assert neardup.confirmed_links(np.array([1, 2]), [a, at[:84]], 85) == []


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(4, None), (5, ""), (6, " \t\n"), (7, "one two"), (3, "ONE  two"), (8, long), (9, long + " tail"), (10, "one two three")]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame([(None, "a b c d e f", "", 1, ""), (2, "A b c d e f", "", 1, ""), (2, "x y", "", 1, ""), (2, "x y", "", 1, "")], SCHEMA)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {2} and sum(r.kept for r in got) == 3
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
