"""Operator 3: personal data, with bootstrapped contextual extraction.

The base finds email, IP, card and phone numbers by pattern. Those are the seeds.
Lexical patterns are the words around a seed: the two words to its left, a single
word to its left that ends in a cue such as a colon, the two words to its right, and
the words on both sides. The same patterns also stand around other
text that has the shape of some kind of seed, which gives a graph between patterns
and instances: groups of digits with spaces, brackets or other separators (7 to 24
digits), groups with colons, addresses with ``@`` or with 'at' and 'dot' spelled out,
tokens with inner dots or underscores, and tokens with four digits or more. An instance
can be of the kinds that its shape allows only (``kinds_of``).

The graph is scored in rounds. A pattern's confidence for a kind is the sum of its
distinct instances' scores over their number, and its support is that sum. Patterns with
enough of both are accepted; an instance's score is 1 for seeds of the kind, else
``DECAY`` times the best confidence of its accepted patterns. So what accepted patterns
find induces further patterns in the next round, each a step less certain, until nothing
new is accepted. Accepted patterns mark their instances, as added spans ``like_<kind>``;
base spans stay.

Edge cases: null and empty texts have no spans; whole texts are read whatever their
length, in linear time; a word of more than ``LONG_WORD`` characters is no part of a
pattern; every row gives one row, also where ids repeat or are null; other columns
are not read; with no seeds there are no patterns and no added spans.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.llm.spans import Span, Taken, joined, mapper, sha256

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *(f"like_{k}" for k in BASE_KINDS))
MIN_SUPPORT = 5.0
MIN_CONFIDENCE = 0.8
DECAY = 0.95
ROUNDS = 6
LONG_WORD = 80

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit stands before a match or is given back, as the runs of digits are whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_WORD = re.compile(r"\S+")
_GROUPS = re.compile(r"(?<!\w)\+?[(\[]?[0-9]++(?:(?:\x20?[(\[]|[)\]](?:\x20?[./-]?)|\x20-\x20|[\x20./-])[0-9]++)+(?![\w@])")
_COLONS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}+)?(?:::?[0-9A-Fa-f]{1,4}+){2,}+(?![\w:])")
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9_%+-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9_%+-]++)*+\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++", re.I)
_CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9@._%+/-]|[(\[{<]\x20?(?:at|dot)\x20?[)\]}>])+", re.I)
_ADDRESS = re.compile(r"@|[(\[{<]\x20?(?:at|dot)\x20?[)\]}>]|[A-Za-z0-9][._][A-Za-z0-9]", re.I)
_OPENING = "([{<\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses that don't overlap: around each ``@``, with what stands before it since the last one."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[last:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if local else None
        if local and domain:
            found.append((at - local.end(), domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *s) for s in emails(text)]
    if not _DIGIT.search(text):
        return spans
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return spans


class Words:
    """The words of a text, by place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [s for s, _ in self.spans]

    def left(self, start: int) -> list[str]:
        """Up to two words before a place; the last may be cut off by it."""
        at = bisect.bisect_left(self.starts, start)
        return [self.text[s : min(e, start)].lower() if e - s <= LONG_WORD else "" for s, e in self.spans[max(0, at - 2) : at]]

    def right(self, end: int) -> list[str]:
        """Up to two words after a place, but for signs that follow it at once."""
        at = bisect.bisect_left(self.starts, end)
        return [self.text[s:e].lower() if e - s <= LONG_WORD else "" for s, e in self.spans[at : at + 2]]

    def patterns(self, start: int, end: int) -> list[str]:
        left, right = self.left(start), self.right(end)
        found = []
        if len(left) == 2 and all(left):
            found.append("2 " + " ".join(left))
        if left and left[-1][-1:] in (":", "=", "#"):
            found.append("1 " + left[-1])
        if len(right) == 2 and all(right):
            found.append("3 " + " ".join(right))
        if left and right and left[-1] and right[0]:
            found.append(f"4 {left[-1]} {right[0]}")
        return found


def kinds_of(value: str) -> list[str]:
    """The kinds that a shape allows: addresses have letters, numbers have none, and as many digits as their kind."""
    digits, letters = len(_DIGIT.findall(value)), bool(_LETTER.search(value))
    tests = (letters, digits > 0 and value.count(".") + value.count(":") > 1, not letters and 12 <= digits <= 24, not letters and 7 <= digits <= 15)
    return [kind for kind, test in zip(BASE_KINDS, tests, strict=True) if test]


def unseen(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Places of what has the shape of a seed but isn't one; longer shapes go first."""
    taken = Taken((start, end) for _, start, end in base)
    digits = bool(_DIGIT.search(text))
    found = []

    def keep(start: int, end: int) -> None:
        if taken.free(start, end):
            taken.add(start, end)
            found.append((start, end))

    if digits:
        for m in _GROUPS.finditer(text):
            if 7 <= len(_DIGIT.findall(m[0])) <= 24:
                keep(*m.span())
    if ":" in text:
        for m in _COLONS.finditer(text):
            if len(m[0]) >= 6 and _DIGIT.search(m[0]):
                keep(*m.span())
    lower = text.lower()
    if " at " in lower and " dot " in lower:
        for m in _SPELLED.finditer(text):
            keep(*m.span())
    for m in _CANDIDATE.finditer(text):
        value = m[0].rstrip("@._%+/-")
        if len(value) < 6 or not _ADDRESS.search(value) and (len(_DIGIT.findall(value)) < 4 or re.fullmatch("[0-9a-f]{24,}", value)):
            continue
        keep(m.start(), m.start() + len(value))
    return sorted(found)


def mentions(text: str, base: list[Span]) -> list[dict]:
    """Seeds and what looks like them, with their patterns and the kinds that they may be of."""
    others = unseen(text, base)
    if not base and not others:
        return []
    words = Words(text)
    found = [{"kind": kind, "start": start, "end": end, "value": text[start:end].lower(), "kinds": [kind], "patterns": words.patterns(start, end)} for kind, start, end in base]
    for start, end in others:
        left = start
        while left and text[left - 1] in _OPENING:
            left -= 1
        # a bracket or quote before it may be a cue's own, or may hide the cue
        patterns = list(dict.fromkeys(words.patterns(start, end) + (words.patterns(left, end) if left < start else [])))
        found.append({"kind": None, "start": start, "end": end, "value": text[start:end].lower(), "kinds": kinds_of(text[start:end]), "patterns": patterns})
    return [x for x in found if x["patterns"]]


_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("kinds", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))])
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()), ("mentions", pa.list_(_MENTION))]
)
_DDL = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "mentions array<struct<kind:string,start:bigint,end:bigint,value:string,kinds:array<string>,patterns:array<string>>>"
)


def _row(text: str) -> tuple:
    base = base_spans(text)
    counts = [sum(kind == s[0] for s in base) for kind in BASE_KINDS]
    text_of = joined(base, BASE_KINDS)
    return (*counts, sha256(text_of), text_of, mentions(text, base))


def accepted_patterns(edges: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS, decay: float = DECAY) -> DataFrame:
    """``pattern``, ``kind`` and ``confidence`` of the accepted patterns, by rounds over the graph.

    ``edges`` has one row per distinct pattern, value, seed kind (null if none) and
    ``kinds``, those that the value may be of.
    """
    seeds = stored(edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    links = stored(edges.groupBy("pattern", "value").agg(F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")), "pii-links")
    sizes = stored(links.groupBy("pattern").agg(F.count("*").alias("size")), "pii-sizes")
    scores, before = seeds, None
    for _ in range(rounds):
        totals = stored(links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("support")), "pii-totals")
        confidence = F.col("support") / F.col("size")
        accepted = totals.where(F.col("support") >= min_support - 1e-9).join(sizes, "pattern").select("pattern", "kind", confidence.alias("confidence")).where(F.col("confidence") >= min_confidence - 1e-9)
        # written before it is joined with the links again, so that a common pattern can be split
        accepted = stored(accepted, "pii-accepted")
        state = accepted.agg(F.count("*"), F.sum(F.round("confidence", 4))).first()
        if state == before:
            break
        before = state
        spread = links.join(accepted, "pattern").where("array_contains(kinds, kind)").select("value", "kind", (F.lit(decay) * F.col("confidence")).alias("score"))
        scores = stored(spread.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score")), "pii-scores")
    return accepted


def extract(docs: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: base counts and digest, and all spans.

    Texts are read once; only mentions, a few bytes a document, are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(rows.mapInArrow(mapper(_row, _SCHEMA), _DDL).withColumn("row_id", F.monotonically_increasing_id()), "pii")
    each = (
        found.where(F.size("mentions") > 0)
        .select("row_id", F.explode("mentions").alias("m"))
        .select("row_id", F.col("m.kind").alias("kind"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.xxhash64("m.value").alias("value"), F.col("m.kinds").alias("kinds"), F.explode("m.patterns").alias("pattern"))
    )
    edges = stored(each.select("pattern", "value", "kind", "kinds").distinct(), "pii-edges")
    accepted = accepted_patterns(edges, min_support, min_confidence, rounds).withColumnRenamed("kind", "like")
    added = (
        each.where("kind IS NULL")
        .join(accepted, "pattern")
        .where("array_contains(kinds, like)")
        .groupBy("row_id", "start", "end")
        .agg(F.max(F.struct("confidence", "like")).alias("best"))
        .select("row_id", F.struct("start", F.concat_ws(":", F.concat(F.lit("like_"), F.col("best.like")), "start", "end").alias("span")).alias("s"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list("s")).alias("added"))
    )
    # Base spans come as a joined text; both lists are sorted by start again, base kinds first.
    parts = F.transform(
        F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")),
        lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), F.lit(0).alias("late"), F.array_position(F.array(*map(F.lit, BASE_KINDS)), F.split(x, ":")[0]).cast("int").alias("rank"), x.alias("span")),
    )
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<start:bigint,span:string>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("late"), F.lit(0).alias("rank"), x["span"].alias("span")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(parts, more)), lambda x: x["span"]), ",")
    return found.join(added, "row_id", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))
