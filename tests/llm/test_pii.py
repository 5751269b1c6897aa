import re

from vigil.llm import pii
from vigil.llm.spans import joined, sha256

SCHEMA = "doc_id long, text string, mentions string, row_id int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        double = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_matches_plain_patterns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in pii.extract(docs).collect()}
    for d in docs.collect():
        spans = brute(d.text)
        assert rows[d.doc_id].base_sha256 == sha256(joined(spans, pii.BASE_KINDS))
        assert [rows[d.doc_id][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]


def test_odd_base_cases():
    for text in ("1.2.3.4.5.6.7.8", "001.2.3.999 a@b.c@d.e", "4111 1111 1111 1111-1", "+1 (017) 555-7713 2", "٣٤٥ 4111111111111111", "9" * 5000 + ".1.1.1"):
        if len(text) < 4000:
            assert pii.base_spans(text) == brute(text)
        else:
            assert pii.base_spans(text) == []


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [f"his card number: 4111111111111{x}" for x in ("111", "129", "137", "145", "152", "160")]
    seeds = [s for s in seeds if brute(s)] + [f"write to mail: user{i}@example.com please" for i in range(8)]
    unseen = ["write to mail: user1234(at)example please", "write to mail: user5678 please", "the year was 19991231 then"]
    rows = [(i, t, None, 1) for i, t in enumerate(seeds + unseen)]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, SCHEMA), min_confidence=0.7).collect()}
    n = len(seeds)
    assert got[n + 1] == "like_email:15:23" and got[n].startswith("like_email:15:") and got[n + 2] == ""
    assert all(got[i] for i in range(n))


def test_edge_rows(spark):
    rows = [(1, None, "", 1), (None, "", None, None), (2, "a@b.cc " * 3, "", 1), (2, "a@b.cc " * 3, "", 1), (3, "1 " * 200_000, "", 0)]
    got = pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 6
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unseen_identifiers_of_every_kind(spark):
    digits = [f"411111111111{x:04d}" for x in range(200)]
    cards = [d for d in digits if pii.luhn(d)][:12]
    bad = next(d for d in digits if not pii.luhn(d))
    seeds = [f"pay with card: {c} now" for c in cards] + [f"send to mail: user{i}@example.com now" for i in range(20)]
    seeds += [f"call us phone: +49 17{i} 5557713 now" for i in range(20)] + [f"host has addr: 10.0.{i}.7 now" for i in range(20)]
    long = "jane." * 20 + "doe(at)example"
    cases = [("call us phone: ", "(017) 555-7713", "phone"), ("call us phone: ", "0171 234 5678", "phone"), ("call us phone: ", "(5557713)", "phone"), ("send to mail: ", "jane.doe(at)example", "email")]
    cases += [("send to mail: ", "jane.doe", "email"), ("send to mail: ", long, "email"), ("send to mail: ", "jane at example dot com", "email")]
    cases += [("pay with card: ", " ".join(bad[i : i + 4] for i in range(0, 16, 4)), "card"), ("host has addr: ", "2001:db8::1", "ip"), ("host has addr: ", "10.0.0.x", "ip")]
    rows = [(i, t, None, 1) for i, t in enumerate(seeds + [f"{left}{value} now" for left, value, _ in cases])]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, SCHEMA), min_confidence=0.7).collect()}
    for i, (left, value, kind) in enumerate(cases, len(seeds)):
        inner = value == "(5557713)"
        assert got[i] == f"like_{kind}:{len(left) + inner}:{len(left) + len(value) - inner}", value


def graph(edges, min_support=pii.MIN_SUPPORT, min_confidence=pii.MIN_CONFIDENCE):
    """Accepted (pattern, kind): confidence, by dictionaries."""
    links = {}
    for p, v, _, kinds in edges:
        links.setdefault(p, {}).setdefault(v, set()).update(kinds)
    seeds = {(v, k): 1.0 for _, v, k, _ in edges if k}
    scores, accepted = dict(seeds), {}
    for _ in range(pii.ROUNDS):
        accepted = {}
        for p, values in links.items():
            for kind in pii.BASE_KINDS:
                support = sum(scores.get((v, kind), 0) for v in values)
                if support >= min_support - 1e-9 and support / len(values) >= min_confidence - 1e-9:
                    accepted[p, kind] = support / len(values)
        scores = dict(seeds)
        for (p, kind), c in accepted.items():
            for v, kinds in links[p].items():
                if kind in kinds:
                    scores[v, kind] = max(scores.get((v, kind), 0), pii.DECAY * c)
    return accepted


def test_pattern_scores_match_brute_force(spark):
    import random

    rng = random.Random(4)
    edges = set()
    for v in range(300):
        kind = rng.choice((*pii.BASE_KINDS, None, None))
        kinds = (kind,) if kind else tuple(rng.sample(pii.BASE_KINDS, rng.choice((0, 1, 2))))
        for _ in range(rng.choice((1, 2, 3))):
            p = rng.randrange(12)
            if kind is None or p % 4 == pii.BASE_KINDS.index(kind) or rng.random() < 0.1:
                edges.add((f"p{p}", v, kind, kinds))
    df = spark.createDataFrame([(p, v, k, list(x)) for p, v, k, x in sorted(edges, key=str)], "pattern string, value long, kind string, kinds array<string>")
    for support, confidence in ((5.0, 0.8), (3.0, 0.4), (2.0, 0.3)):
        got = {(r.pattern, r.kind): round(r.confidence, 6) for r in pii.accepted_patterns(df, support, confidence).collect()}
        want = {k: round(c, 6) for k, c in graph(edges, support, confidence).items()}
        assert {k for k in got} == {k for k in want} and all(abs(got[k] - want[k]) < 2e-3 for k in got)


def test_what_is_found_induces_further_patterns(spark):
    texts = [f"write to mail: user{i}@example.com at once {i}" for i in range(40)]
    texts += [f"write to mail: zz{i}234yy at once {i}" for i in range(8)] + [f"known by handle: zz{i}234yy among {i}" for i in range(8)]
    texts += ["known by handle: qq9876pp among us", "the order no. 1234567890 came", "known by handle: 4111111111111112 here"]
    rows = [(i, t, None, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, SCHEMA), min_confidence=0.7).collect()}
    assert got[56] == "like_email:17:25" and got[57] == got[58] == ""  # the number can't be an address
    once = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, SCHEMA), min_confidence=0.7, rounds=1).collect()}
    assert once[56] == "" and once[40] == got[40] == "like_email:15:23"


def test_held_back_identifiers_are_found_and_clean_ones_left_alone(spark):
    """Every fifth address is written so that the base misses it; look-alikes stand in other contexts."""
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, hidden, clean = [], set(), set()
    for i in range(400):
        name = f"{rng.choice(words)}.{rng.choice(words)}{i}"
        if i % 5 == 0:
            hidden.add(i)
        shown = f"{name}(at)mail{i % 7}" if i in hidden else f"{name}@mail{i % 7}.net"
        left, right = rng.choice((("reach me at:", "or by post"), ("contact email:", "any time you"), ("sent from", "on behalf of")))
        rows.append((i, f"{' '.join(rng.choices(words, k=20))} {left} {shown} {right} {' '.join(rng.choices(words, k=9))}", None, 1))
    for i in range(400, 700):
        clean.add(i)
        rows.append((i, f"{' '.join(rng.choices(words, k=9))} {rng.choice(('version', 'file', 'call'))} {rng.choice(words)}.{rng.choice(words)}_{i} {' '.join(rng.choices(words, k=9))}", None, 1))
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, SCHEMA), min_confidence=0.7).collect()}
    found = {i for i, s in got.items() if "like_" in s}
    assert len(found & hidden) >= 0.95 * len(hidden) and not found - hidden


def test_long_runs_take_linear_time():
    import time

    start = time.perf_counter()
    for text in ("7" * 400_000, "a" * 400_000 + "@", "a@" * 200_000, "a" * 400_000 + " 1 @", "1." * 200_000 + "x"):
        pii._row(text)
    assert time.perf_counter() - start < 20
    for text in ("a@b.cc_x@d.ee", "@b.cc@d.ee", "a@b@c.de", "a@b.c@d.e f@g..h.ii", "x@y.z-@q.r.s", "@@a@b.c"):
        assert pii.base_spans(text) == [s for s in brute(text)], text
