import re

import pytest

from vigil.llm import decontam

DOCS = "doc_id long, text string, item_id string, hash int, row_id int"
ITEMS = "item_id long, text string, share int"
ITEM = "If Alice buys 12 apples for 30 cents each and gives Bob 5 apples how many apples does Alice have"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "", 0, 1) for i, t in docs], DOCS)
    return {r.doc_id: r for r in decontam.report(d, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()}


def test_copies_and_other_parameters_are_caught(spark):
    changed = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "48").replace("30", "95")
    mixed = changed.replace("Carol have", "Erin have").replace("Carol buys", "Fay buys")
    docs = [(1, "So here " + ITEM + " and more text"), (2, "say: " + changed + "!"), (3, "a clean text that has nothing of it " * 9), (4, " ".join(w + "%%%" for w in ITEM.split())), (5, " ".join(ITEM.split()[:9]))]
    got = run(spark, docs, [(7, ITEM)])
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 4}
    assert got[1].item_id == 7 and got[1].share == 1
    assert decontam._SYMBOLS.of(mixed)[0].tolist() == decontam._SYMBOLS.of(changed)[0].tolist()


def test_other_case_is_caught(spark):
    item = "The ship left port. Then the crew slept. All of the cargo was wet by noon. Few of them ever sailed again."
    docs = [(1, item.lower()), (2, item.upper()), (3, item.replace(".", " ;")), (4, "The ship left port.")]
    assert {i for i, r in run(spark, docs, [(7, item)]).items() if r.contaminated} == {1, 2, 3}


def test_inconsistent_slots_do_not_count(spark):
    item = "so Alice saw Alice and Alice met Alice or Alice hit Alice while Alice ran with Alice then Alice sat near Alice"
    names = iter("Bo Cy Di Ed Fi Gus Hal Ian Jo Kit".split())
    scrambled = re.sub("Alice", lambda _: next(names), item)
    got = run(spark, [(1, scrambled), (2, item.replace("Alice", "Zed"))], [(1, item)])
    assert not got[1].contaminated and got[2].contaminated


def test_without_broadcast_hashes_the_result_is_the_same(spark, small, monkeypatch):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    a = sorted(map(tuple, decontam.report(docs, items).collect()), key=str)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", -1)
    assert sorted(map(tuple, decontam.report(docs, items).collect()), key=str) == a


def test_planted_passages(spark):
    at = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    got = {r.doc_id: r.contaminated for r in decontam.report(docs, items).collect()}
    words = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    plain = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    verbatim = {i for i, t in plain.items() if any(x in t for x in words.values())}
    assert len(verbatim) > 50 and all(got[i] for i in verbatim)
    extra = {i for i, flag in got.items() if flag} - verbatim
    assert len(extra) < 0.003 * len(got)


def test_edge_rows(spark):
    docs = [(1, None), (None, ""), (2, "yes"), (3, "oh YES, really"), (3, "oh YES, really"), (4, "For " * 100_000)]
    d = spark.createDataFrame([(i, t, "", 0, 1) for i, t in docs], DOCS)
    items = spark.createDataFrame([(1, "Yes", 0), (2, None, 0), (None, "", 0), (2, "...", 0)], ITEMS)
    got = decontam.report(d, items).collect()
    assert len(got) == 6 and sorted(r.doc_id for r in got if r.contaminated) == [2, 3, 3]
    assert decontam.report(d, spark.createDataFrame([], ITEMS)).where("contaminated").count() == 0
    assert decontam.report(spark.createDataFrame([], DOCS), items).count() == 0
    kept = decontam.drop_contaminated(d, items)
    assert kept.columns == d.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "4", "None"]


@pytest.mark.parametrize(("word", "kind"), [("12", "NUM"), ("3,000.50%", "NUM"), ("1st", "NUM"), ("Alice", "NAME"), ("(Alice's", "NAME"), ("NASA", None), ("apple", None)])
def test_symbols(word, kind):
    symbol = int(decontam._SYMBOLS.of(word)[0][0])
    assert symbol == {"NUM": decontam._NUM, "NAME": decontam._NAME, None: symbol}[kind]
    assert kind or symbol not in (decontam._NUM, decontam._NAME)


def test_units_only_after_numbers():
    assert decontam._SYMBOLS.of("5 kg")[0][1] == decontam._UNIT and decontam._SYMBOLS.of("the kg")[0][1] != decontam._UNIT


SHORT = "a train that Ann drives covers 5km in 30ms and then it stops near the old dam"


@pytest.mark.parametrize(
    "changed",
    [
        [("5km", "12km")],
        [("5km", "7kg"), ("30ms", "2h")],
        [("5km", "12 yards"), ("30ms", "400 ns")],
        [("5km", "3 tons")],
        [("5km", "60km/h"), ("30ms", "9-gallon")],
        [("Ann", "Mary Jane")],
        [("Ann", "Mary Jane Van Dyke"), ("5km", "16 ounces")],
    ],
)
def test_short_items_with_other_values_are_caught(spark, changed):
    text = SHORT
    for old, new in changed:
        text = text.replace(old, new)
    got = run(spark, [(1, text), (2, text.replace("train", "tram").replace("stops", "ends").replace("dam", "barn"))], [(1, SHORT)])
    assert got[1].contaminated and got[1].share == 1 and not got[2].contaminated
    back = run(spark, [(1, SHORT)], [(1, text)])
    assert back[1].contaminated


def test_names_of_other_lengths_are_one_value_each():
    def slots(text):
        return decontam.templates(text)[decontam.RUNS][2].tolist()

    a, b = slots("then Ann saw Bo and Ann left"), slots("then Mary Jane saw Al Fox and Mary Jane left")
    assert len(a) == len(b) == 7 and b[1] == b[5] != b[3] and slots("Jane Mary")[0] != slots("Mary Jane")[0]


def test_short_items_of_many_names_stay_caught(spark):
    assert run(spark, [(1, "x then Tim Fox has 9 kg x")], [(1, "Ann Lee has 5 km")])[1].contaminated


def naive(text, item, share=decontam.SHARE):
    """Shares by strings, all alignments and a quadratic search for the longest chain."""

    def symbols(t):
        out = []
        for kind, symbol, slots in decontam.templates(t):
            out.append((kind, symbol.tolist(), slots.tolist()))
        return out

    best = 0.0
    of_item, of_text = symbols(item), symbols(text)
    marks = (decontam._NUM, decontam._UNIT, decontam._NAME)
    used = []
    for (kind, a, sa), (_, b, sb) in zip(of_item[:3], of_text[:3], strict=True):
        places = [i for i in range(len(a) - 4) if any(x not in marks for x in a[i : i + 5])]
        if places and 2 * len(places) >= len(a) - 4:
            used.append((places, a, sa, b, sb, 5))
    if not used and of_item[3][1]:
        n = min(5, len(of_item[3][1]))
        used.append((range(len(of_item[3][1]) - n + 1), of_item[3][1], of_item[3][2], of_text[3][1], of_text[3][2], n))
    for places, a, sa, b, sb, n in used:
        pairs = [(i, j) for i in places for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]]
        value, kept = {}, []
        shifts = {j - i for i, j in pairs}
        for s in sorted(shifts, key=lambda s: (-sum(j - i == s for i, j in pairs), s)):
            group = [(i, j) for i, j in pairs if j - i == s]
            slots = [(sa[i + k], sb[j + k]) for i, j in group for k in range(n) if sa[i + k]]
            own = {k: value[k] if k in value else min({v for q, v in slots if q == k}, key=lambda v: (-slots.count((k, v)), v - (1 << 64) * (v >= 1 << 63))) for k, _ in slots}
            for i, j in group:
                mine = [(sa[i + k], sb[j + k]) for k in range(n) if sa[i + k]]
                if all(own[k] == v for k, v in mine):
                    value.update(mine)
                    kept.append((i, j))
        longest = {}
        for i, j in sorted(kept):
            longest[i, j] = 1 + max((x for (p, q), x in longest.items() if p < i and q < j), default=0)
        best = max(best, max(longest.values(), default=0) / len(places))
    return best if best >= share else 0.0


def test_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = "the a red old cat dog sat ran far home Ann Bob Mary Jane 3 12 40 5km 7 kg miles ha ha ha".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((3, 6, 9, 14, 20))))) for i in range(14)]
    items += [(50, "ha " * 12), (51, "add 3 5 7 2 9 1 4 6 8 2 3 5 7 9 1 2 3 4 5 6 7 8 9"), (52, "12 13 14 15 16 17 18")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice((0, 4, 30)))
        at = rng.randrange(len(words) + 1)
        copy = rng.choice(items)[1].split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            k = rng.randrange(len(copy) + 1)
            copy[k : k + rng.choice((0, 1))] = rng.choice(([], ["more"], ["Ann"], ["99"]))
        docs.append((i, " ".join([*words[:at], *copy, *words[at:]])))
    docs += [(70, "phone log 55 66 77 88 99 on file"), (71, "they said ha ha ha ha ha and left"), (72, "ha " * 500), (73, "12 13 14 15 16 17 18"), (74, "21 22 23 24 25 26 27"), (75, "add 3 5 7 2 9 1 4 6 8 2 3 5 7 9 1 2 3 4 5 6 7 8 9")]
    got = run(spark, docs, items)
    for i, text in docs:
        want = {k: s for k, item in items if (s := naive(text, item))}
        assert (got[i].n_items, round(got[i].share, 9)) == (len(want), round(max(want.values(), default=0.0), 9)), text
    assert not got[70].contaminated and not got[71].contaminated and not got[74].contaminated
    assert got[72].contaminated and got[73].contaminated and got[75].contaminated


LONG = ITEM + " while the baker on the corner sells his bread and cakes to all who come by in the early morning hours"


def test_a_word_more_and_several_copies(spark):
    more = LONG.replace("cents each", "cents now each")
    two = LONG.replace("12", "7").replace("Alice", "Zoe") + " " + LONG.replace("12", "9").replace("Alice", "Kim")
    halves = LONG[: len(LONG) // 2] + " and so on " * 3 + LONG[len(LONG) // 2 :]
    turned = " ".join(LONG.split()[20:] + LONG.split()[:20])
    got = run(spark, [(1, "text " * 30 + more), (2, two), (3, (LONG + " ") * 300), (4, halves), (5, turned)], [(7, LONG)])
    assert got[2].share == got[3].share == 1 and 0.8 < got[1].share < 1 and got[4].contaminated
    assert not got[5].contaminated  # its parts, in another order, are no chain


def test_rows_not_ids_are_dropped(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM, "", 0, 1), (1, "a clean row of that id", "", 0, 1), (None, ITEM, "", 0, 1), (None, "clean", "", 0, 1)], DOCS).withColumnRenamed("hash", "_row")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(7, ITEM, 0)], ITEMS))
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["a clean row of that id", "clean"]
