import hashlib

from vigil.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, lang string, _tail boolean, _bucket string"


def brute(rows, size=fp.SKETCH):
    rows = sorted(rows, key=lambda r: r[0])
    texts = [r[1] or "" for r in rows]
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = (fp.fingerprint(x, size) for x in (text, edited, after))
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(own), fp.to_text(other), fp.likeness(own, other, size), fp.likeness(own, following, size))
    return out


def phrases(data):
    """The same parse by slices."""
    found, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in found:
            found.add(data[start:end])
            start = end
    return found


def test_parse_counts_phrases():
    for data in (b"", b"a", b"aaaaaaaa", b"abababab" * 9, bytes(range(256)) * 3):
        assert len(fp.parse(data)[0]) == len(phrases(data))


def test_parse_continues():
    data = b"the cat sat on the mat and the cat" * 5
    seen, _, state = fp.parse(data[:50])
    assert fp.parse(data[50:], seen, state)[0] == fp.parse(data)[0]


def test_likeness_edges():
    a, e = fp.fingerprint("hello world"), fp.fingerprint(None)
    assert fp.likeness(a, a) == 1 and fp.likeness(e, e) == 1 and fp.likeness(a, e) == 0


def test_likeness_estimates_jaccard():
    a, b = "lorem ipsum dolor sit amet " * 3 + "x" * 50, "lorem ipsum dolor sit amet consectetur " * 4
    p, q = phrases(a.encode()), phrases(b.encode())
    assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(p & q) / len(p | q)) < 0.15


def test_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in fp.fingerprints(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    rows = [(5, "abcé" * 9, None, True, "x"), (1, None, "en", None, None), (2, "", None, False, ""), (9, "z" * 3000, None, False, "")]
    got = {r[0]: tuple(r)[1:] for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([r[:2] for r in rows])
    one = fp.fingerprints(spark.createDataFrame([(3, "abcd", "", True, "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    ties = [(None, "a b c", "", True, ""), (4, "same", "", True, ""), (4, "same", "", True, ""), (4, "other", "", True, "")]
    assert fp.fingerprints(spark.createDataFrame(ties, SCHEMA)).count() == 4


def test_rows_of_one_id_are_spread_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(fp, "n_partitions", lambda _: 6)
    rows = [(i, f"text {i} of its own " * 3) for i in range(40)] + [(17, f"one of many {i} with this id") for i in range(60)] + [(None, f"no id {i}") for i in range(60)] + [(20, "copy")] * 30
    docs = spark.createDataFrame([(*r, "", True, "") for r in rows], SCHEMA)
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    ordered = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    named = [(k, r.text) for k, r in enumerate(ordered)]
    want = sorted(map(str, [(ordered[k].doc_id, *v) for k, v in brute(named).items()]))
    for n in (1, 3):
        found = fp.fingerprints(docs.repartition(n))
        assert sorted(str(tuple(r)) for r in found.collect()) == want
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS _hash")
    cuts = fp.cuts_of(keyed, 6)
    assert len(cuts.nulls) > 1 and (cuts.ids == 17).sum() > 1
    parts = keyed.mapInArrow(fp._deal(cuts), "doc_id long, text string, _hash long, _to int, _tail boolean").groupBy("_to", "_tail").count().collect()
    assert max(r["count"] for r in parts) < 0.4 * len(rows) and sum(r["count"] for r in parts if not r._tail) == len(rows)
