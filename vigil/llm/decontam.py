"""Operator 10: benchmark decontamination by template canonicalisation.

Words become symbols: numbers, capitalised names and, after numbers, units become
typed placeholders, other words their lower-case letters without outer punctuation.
A number with a unit attached to it is a number and a unit.
Each benchmark item gives the windows of five symbols of its template. Documents'
windows are hash-joined with these. Windows of placeholders alone say nothing and are
left out; a template counts if at least half of its windows have another word. Each
text has three templates: one with each run of names as one placeholder,
which finds items with names of other lengths, one with a placeholder for each word of
a name, and one with names as lower-case words, which finds items in other case.

A document holds an item as far as a chain of windows goes: each window of the item once,
in the item's order, at later and later places of the document, so that a word more or
less breaks the windows over it only. Literals must be consistent along the chain: a
literal of the item stands for the same literal of the document each time. The alignment
(constant distance of places) with most windows is settled first, each of its literals
by most windows; windows of other alignments join if they don't contradict it. A
document is contaminated if some item's longest chain has 0.8 or more of the windows of
one of its templates. Chains are looked for among pairs whose distance of places varies
by as much as the item has windows at most, so a group is bounded by the item's size.

Where the items' window hashes are at most ``BROADCAST_WINDOWS`` they travel with the
tasks, so that documents' other windows are dropped before the join; beyond that all
windows go to the join. The result is the same.

Edge cases: items with fewer than five symbols are compared literally as one window
of their length, and items without a template that counts, such as lists of numbers,
literally by windows of five; items and texts with no symbols, null ones too, match
nothing; of a run of equal windows of a document as many first and last ones are kept as
the longest item has windows, which is all that a chain can use; repeated ids have a row
each and are judged and dropped row by row; items with equal ids count as rows of their
own; other columns are not read, and ``drop_contaminated`` returns them as they are.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, mix64, passing, remove, stored, with_rows, without_rows, working

WORDS = 5
SHARE = 0.8
BROADCAST_WINDOWS = 4_000_000
BROADCAST_ROWS = 1_000_000
UNITS = frozenset(
    "nm um µm μm mm cm dm m km in ft yd mi nmi ly au micron microns micrometer micrometers micrometre micrometres nanometer nanometers nanometre nanometres "
    "millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres decimeter decimeters decimetre decimetres "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles yard yards yds foot feet inch inches furlong furlongs fathom fathoms league leagues "
    "lightyear lightyears light-year light-years parsec parsecs "
    "mcg ug µg μg mg g kg t lb lbs oz st ct kt microgram micrograms milligram milligrams gram grams gramme grammes kilo kilos kilogram kilograms kilogramme kilogrammes "
    "ton tons tonne tonnes pound pounds ounce ounces stone stones grain grains carat carats quintal quintals cwt hundredweight "
    "ul µl μl ml cl dl l hl cc gal gals pt pts qt qts tsp tbsp milliliter milliliters millilitre millilitres centiliter centiliters centilitre centilitres "
    "liter liters litre litres gallon gallons quart quarts pint pints cup cups teaspoon teaspoons tablespoon tablespoons barrel barrels bbl bushel bushels acre acres hectare hectares ha sqm sqft sqkm "
    "ns us µs μs ms s sec secs second seconds nanosecond nanoseconds microsecond microseconds millisecond milliseconds min mins minute minutes h hr hrs hour hours d day days night nights "
    "wk wks week weeks fortnight fortnights mo mos month months quarter quarters y yr yrs year years decade decades century centuries millennium millennia am pm o'clock "
    "percent pct pence penny pennies p c cent cents dollar dollars usd buck bucks euro euros eur gbp quid shilling shillings yen jpy yuan rmb cny rupee rupees inr rs peso pesos "
    "franc francs chf ruble rubles rouble roubles won krw lira liras krona kronor krone kroner real reais rand rands dinar dinars dirham dirhams shekel shekels dime dimes nickel nickels "
    "k bn thousand million millions billion billions trillion trillions dozen dozens "
    "degree degrees deg celsius fahrenheit kelvin kelvins f radian radians rad "
    "mw kw gw w v kv mv a ma ah mah j kj mj n kn pa kpa mpa psi bar bars atm wh kwh mwh gwh ev kev mev cal kcal btu hp "
    "watt watts kilowatt kilowatts megawatt megawatts gigawatt gigawatts volt volts kilovolt kilovolts amp amps ampere amperes milliamp milliamps ohm ohms joule joules kilojoule kilojoules "
    "newton newtons pascal pascals kilopascal kilopascals calorie calories kilocalorie kilocalories horsepower mole moles mol mmol lumen lumens lux farad farads tesla teslas henry db decibel decibels "
    "mph kph kmh kmph knot knots fps rpm bpm hz khz mhz ghz thz hertz kilohertz megahertz gigahertz "
    "bit bits byte bytes b kb mb gb tb pb kib mib gib tib kilobyte kilobytes megabyte megabytes gigabyte gigabytes terabyte terabytes kbps mbps gbps bps px pixel pixels dpi".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?\Z")
_ATTACHED = re.compile(r"([+-]?\d[\d.,:/]*)[-°º]*([^\W\d_].*)\Z")
_CACHE = 150_000
BATCH = 1 << 12  # words looked at together
_FILTER_BITS = 20
_FACTORS = [U64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) | 1


_NUM, _UNIT, _NAME = _hash("\0number"), _hash("\0unit"), _hash("\0name")


def _strip(word: str) -> str:
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def _is_unit(lower: str) -> bool:
    """A unit, also with a power (m2, m³), or a quotient of units (km/h)."""
    return lower in UNITS or ("/" in lower or lower[-1:] in ("2", "3", "²", "³")) and all(x.rstrip("^23²³") in UNITS for x in lower.split("/"))


class Symbols(dict):
    """Words to positions in arrays of symbols, kept up to a bound."""

    def __init__(self) -> None:
        self.symbol = np.zeros(_CACHE, U64)  # 0: nothing is left of the word
        self.literal = np.zeros(_CACHE, U64)
        self.attached = np.zeros(_CACHE, U64)  # the literal of the unit attached to the number, else 0
        self.slot = np.zeros(_CACHE, bool)
        self.name = np.zeros(_CACHE, bool)
        self.unit = np.zeros(_CACHE, bool)

    @staticmethod
    def _about(word: str) -> tuple[int, int, int, bool, bool, bool]:
        """Symbol, literal, literal of an attached unit, and whether it is a slot, a name, and a unit."""
        core = word if word.isalnum() else _strip(word)
        if not core:
            return 0, 0, 0, False, False, False
        lower = core.lower()
        if core[0].isdecimal():
            number, name, attached = bool(_NUMBER.match(core)), False, 0
            parts = None if number else _ATTACHED.match(lower)
            if parts and _is_unit(parts[2]):
                number, lower, attached = True, _strip(parts[1]), _hash(parts[2])
            literal = _hash(lower)
            return _NUM if number else literal, literal, attached, number, False, _is_unit(lower)
        literal = _hash(lower)
        name = core is not lower and core[0].isupper() and (len(core) == 1 or core[1:] != core[1:].upper())
        return _NAME if name else literal, literal, 0, name, name, _is_unit(lower)

    def _learn(self, words: list[str]) -> None:
        start = len(self)
        self.update(zip(words, range(start, start + len(words)), strict=True))
        columns = zip(*map(self._about, words), strict=True)
        for own, values in zip((self.symbol, self.literal, self.attached, self.slot, self.name, self.unit), columns, strict=True):
            own[start : start + len(words)] = np.array(values, own.dtype)

    def _places(self, words: list[str]) -> np.ndarray:
        found = list(map(self.get, words))
        if None in found:
            new = list(dict.fromkeys([w for w, k in zip(words, found, strict=True) if k is None]))
            if len(self) + len(new) > _CACHE:
                self.clear()
                new = list(dict.fromkeys(words))
            self._learn(new)
            found = list(map(self.__getitem__, words))
        return np.array(found, np.int64)

    def of_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, their literals, literals where they are slots (else 0), whether they are names, and of which text."""
        each = [(x or "").split() for x in texts]
        words = list(itertools.chain.from_iterable(each))
        doc = np.repeat(np.arange(len(each)), np.fromiter(map(len, each), np.int64, len(each)))
        parts = []
        for start in range(0, len(words), _CACHE // 2):
            at = self._places(words[start : start + _CACHE // 2])
            parts.append([x[at] for x in (self.symbol, self.literal, self.attached, self.slot, self.name, self.unit)])
        if not parts:
            return np.empty(0, U64), np.empty(0, U64), np.empty(0, U64), np.empty(0, bool), doc
        symbol, literal, attached, slot, name, unit = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        kept = symbol != 0
        if not kept.all():
            symbol, literal, attached, slot, name, unit, doc = (x[kept] for x in (symbol, literal, attached, slot, name, unit, doc))
        slots = np.where(slot, literal, U64(0))
        split = attached != 0
        if split.any():
            second = (np.arange(len(split)) + np.cumsum(split))[split]
            units, times = attached[split], 1 + split
            symbol, literal, slots, name, unit, doc = (np.repeat(x, times) for x in (symbol, literal, slots, name, unit, doc))
            symbol[second], literal[second], slots[second] = U64(_UNIT), units, units
        after = np.flatnonzero(unit[1:] & (symbol[:-1] == U64(_NUM)) & (doc[1:] == doc[:-1])) + 1
        symbol[after], slots[after] = U64(_UNIT), literal[after]
        return symbol, literal, slots, name, doc

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.of_all([text])[:4]


_SYMBOLS = Symbols()


def window_hashes(values: np.ndarray, size: int, salt: int) -> np.ndarray:
    n = len(values) - size + 1
    if n < 1:
        return np.empty(0, U64)
    total = values[:n] * _FACTORS[0]
    total += U64(salt)
    for i in range(1, size):
        total += values[i : i + n] * _FACTORS[i]
    return total


def name_runs(symbol: np.ndarray, slots: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, slots and texts with each run of names as one name, whose literal is all of the run."""
    later = np.zeros(len(name), bool)
    later[1:] = name[1:] & name[:-1] & (doc[1:] == doc[:-1])
    if not later.any():
        return symbol, slots, doc
    kept = np.flatnonzero(~later)
    at = np.arange(len(name)) - np.maximum.accumulate(np.where(later, 0, np.arange(len(name))))
    each = np.where(later, mix64(slots + at.astype(U64) * _FACTORS[0]), slots)
    return symbol[kept], np.add.reduceat(each, kept), doc[kept]


# kinds of templates: runs of names as one, each word of a name, names as lower-case words, literals
RUNS, APART, LOWER, LITERAL = 0, 3, 1, 2
Template = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def templates_of(texts: list[str | None]) -> list[Template]:
    """Kind, symbols, slots and of which text, of the three templates; then of the literals."""
    symbol, literal, slots, name, doc = _SYMBOLS.of_all(texts)
    lower = np.where(name, literal, symbol)
    none = np.zeros(len(literal), U64)
    return [(RUNS, *name_runs(symbol, slots, name, doc)), (APART, symbol, slots, doc), (LOWER, lower, np.where(name, U64(0), slots), doc), (LITERAL, literal, none, doc)]


def templates(text: str | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [t[:3] for t in templates_of([text])]


_NAMES = ["row_id", "hash", "at", "kind", "slots"]
_TYPES = "row_id long, hash long, at long, kind int, slots array<long>"


def _emit(row_ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, kind: int, slots: np.ndarray) -> pa.RecordBatch:
    """Rows of windows of one kind."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype=np.int32) * WORDS), pa.array(slots.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(row_ids.astype(np.int64)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int64)), pa.array(np.full(len(at), kind, np.int32)), lists], _NAMES)


def _slots_of(slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    return slots[at[:, None] + np.arange(WORDS)[None, :]] if len(at) else np.empty((0, WORDS), U64)


def telling(symbols: np.ndarray) -> np.ndarray:
    """Whether each window has a word that is no placeholder."""
    if len(symbols) < WORDS:
        return np.empty(0, bool)
    words = np.cumsum(np.concatenate([[False], (symbols != U64(_NUM)) & (symbols != U64(_UNIT)) & (symbols != U64(_NAME))]))
    return words[WORDS:] > words[:-WORDS]


def windows_of_item(text: str | None) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind, size, hashes, places and slots of an item's windows."""
    *full, (_, literal, _) = templates(text)
    out = []
    for kind, symbols, slots in full:
        told = telling(symbols)
        at = np.flatnonzero(told)
        if len(at) and 2 * len(at) >= len(told):
            out.append((kind, WORDS, window_hashes(symbols, WORDS, 0)[at], at, _slots_of(slots, at)))
    if not out and len(literal):
        size = min(len(literal), WORDS)
        hashes = window_hashes(literal, size, size)
        out.append((LITERAL, size, hashes, np.arange(len(hashes)), np.zeros((len(hashes), WORDS), U64)))
    return out


def item_windows(items: DataFrame) -> DataFrame:
    """``row_id``, ``hash``, ``at``, ``kind`` of template and slot literals of the items' windows. ``items``: row_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("decontam", _SYMBOLS.clear)
        for batch in batches:
            for row_id, text in zip(batch["row_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for kind, _, hashes, at, slots in windows_of_item(text):
                    yield _emit(np.full(len(at), row_id), hashes, at, kind, slots)

    return items.mapInArrow(run, _TYPES)


def _ends_of_runs(equal: np.ndarray, most: int) -> np.ndarray:
    """Which of the windows to keep, where ``equal`` says that a window is like the one before: the first and last ``most`` of a run."""
    first = np.concatenate([[True], ~equal])
    starts = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    place = np.arange(len(first)) - starts[run]
    return (place < most) | (place >= np.diff(np.append(starts, len(first)))[run] - most)


def document_windows(docs: DataFrame, sizes: list[int], known: np.ndarray | None, most: int) -> DataFrame:
    """The like for documents: of five symbols, and literal ones of the given sizes.

    ``known``: ascending hashes; windows with others are dropped. ``most``: the most
    windows of an item. ``docs`` has row_id, doc_id and text; each document also has a
    row with its ``doc_id`` and no hash.
    """
    maybe = np.zeros(1 << _FILTER_BITS, bool)  # where no known hash has these high bits none need be looked for
    high = U64(64 - _FILTER_BITS)
    if known is not None:
        maybe[known >> high] = True

    def found(row_ids: np.ndarray, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        *full, (_, literal, none, doc) = templates_of(texts)
        wanted = [(*t, WORDS, 0) for t in full] + [(LITERAL, literal, none, doc, s, s) for s in sizes]
        for kind, symbols, slots, of, size, salt in wanted:
            hashes = window_hashes(symbols, size, salt)
            if not len(hashes):
                continue
            if known is None:
                at = np.arange(len(hashes)) if kind == LITERAL else np.flatnonzero(telling(symbols))
            else:
                at = np.flatnonzero(maybe[hashes >> high])
                place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                at = at[known[place] == hashes[at]]
            at = at[of[at] == of[at + size - 1]]
            if not len(at):
                continue
            picked = np.zeros((len(at), WORDS), U64) if kind == LITERAL else _slots_of(slots, at)
            equal = (hashes[at][1:] == hashes[at][:-1]) & (np.diff(at) == 1) & (of[at][1:] == of[at][:-1]) & (picked[1:] == picked[:-1]).all(axis=1)
            if equal.any():
                kept = _ends_of_runs(equal, most)
                at, picked = at[kept], picked[kept]
            starts = np.searchsorted(of, of[at])
            yield _emit(row_ids[of[at]], hashes[at], at - starts, kind, picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("decontam", _SYMBOLS.clear)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts, row_ids = part["text"].to_pylist(), part["row_id"].to_numpy()
                ends = np.cumsum([len(x or "") for x in texts])
                # about as many words at a time, at six letters a word
                cuts = [0, *np.unique(np.searchsorted(ends, np.arange(6 * BATCH, ends[-1], 6 * BATCH), side="right")).tolist(), len(texts)]
                windows = []
                if known is None or len(known):
                    windows = [w for start, end in itertools.pairwise(cuts) for w in found(row_ids[start:end], texts[start:end])]
                if windows:
                    table = pa.Table.from_batches(windows).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in table.columns), pa.nulls(table.num_rows, pa.int64())], [*_NAMES, "doc_id"])
                nothing = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["row_id"], *nothing, part["doc_id"]], [*_NAMES, "doc_id"])

    return docs.mapInArrow(run, _TYPES + ", doc_id long")


def chain(pairs: list[dict]) -> int:
    """The windows of the longest chain of (item_at, at, slots), whose slots are (k, v): literals of the item and of the document."""
    alignments = defaultdict(list)
    for p in pairs:
        alignments[p["at"] - p["item_at"]].append(p)
    value: dict[int, int] = {}
    kept = []
    for _, group in sorted(alignments.items(), key=lambda x: (-len(x[1]), x[0])):
        votes: dict[int, Counter] = defaultdict(Counter)
        for p in group:
            for s in p["slots"]:
                votes[s["k"]][s["v"]] += 1
        own = {k: value[k] if k in value else min(v, key=lambda x: (-v[x], x)) for k, v in votes.items()}
        for p in group:
            if all(own[s["k"]] == s["v"] for s in p["slots"]):
                value.update((s["k"], s["v"]) for s in p["slots"])
                kept.append((p["item_at"], -p["at"]))
    ends: list[int] = []  # of chains by length, the least place that one ends in
    for _, minus in sorted(kept):
        i = bisect.bisect_left(ends, -minus)
        ends[i : i + 1] = [-minus]
    return len(ends)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [chain(p.as_py()) / w for p, w in zip(batch["pairs"], batch["windows"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["row_id"], batch["item"], pa.array(shares, pa.float64())], ["row_id", "item", "share"])


def matches(docs: DataFrame, items: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id) of all documents, and (row_id, item, share) of those and the items that reach the share.

    ``docs`` has row_id, doc_id and text, ``items`` row_id and text. Texts of documents are scanned once.
    """
    windows = stored(item_windows(items), "item-windows")
    totals = stored(windows.groupBy("row_id", "kind").agg(F.count("*").alias("windows")), "item-totals")
    most = totals.agg(F.max("windows")).first()[0] or 0
    sizes = sorted(r[0] for r in items.mapInArrow(_literal_sizes, "size int").distinct().collect())
    known = None
    distinct = windows.select("hash").distinct()
    if distinct.count() <= BROADCAST_WINDOWS:
        known = np.sort(distinct.toArrow()["hash"].to_numpy().view(U64))
    scanned = stored(document_windows(docs, sizes, known, most), "document-windows")
    found = scanned.where("hash IS NOT NULL")
    item_side = windows.select("hash", "kind", F.col("row_id").alias("item"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    slots = F.filter(F.arrays_zip(F.col("item_slots").alias("k"), F.col("slots").alias("v")), lambda p: p["k"] != 0)
    pairs = stored(found.join(item_side, ["hash", "kind"]).select("row_id", "item", "kind", "item_at", "at", slots.alias("slots")), "pairs")
    # a chain has no more windows than the places of the item that are met at all
    met = pairs.select("row_id", "item", "kind", "item_at").distinct().groupBy("row_id", "item", "kind").agg(F.count("*").alias("n"))
    likely = met.join(totals.withColumnRenamed("row_id", "item"), ["item", "kind"]).where(F.col("n") >= share * F.col("windows")).drop("n")
    band = F.floor((F.col("at") - F.col("item_at")) / F.col("windows"))
    banded = pairs.join(likely, ["row_id", "item", "kind"]).withColumn("band", F.explode(F.array(band - 1, band)))
    grouped = banded.groupBy("row_id", "item", "kind", "windows", "band").agg(F.collect_list(F.struct("item_at", "at", "slots")).alias("pairs"))
    chains = grouped.where(F.size("pairs") >= share * F.col("windows")).select("row_id", "item", "windows", "pairs").mapInArrow(_chains, "row_id long, item long, share double")
    shares = chains.groupBy("row_id", "item").agg(F.max("share").alias("share"))
    return scanned.where("hash IS NULL").select("row_id", "doc_id"), shares.where(F.col("share") >= share)


def _literal_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = {size for x in batch["text"].to_pylist() for kind, size, *_ in windows_of_item(x) if kind == LITERAL}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int32())], ["size"])


def _bench(items: DataFrame) -> DataFrame:
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return stored(bench.withColumn("row_id", F.monotonically_increasing_id()), "items")


def report(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Every row's ``doc_id``, whether it is contaminated, its best item and share, and how many items it holds."""
    bench = _bench(items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    ids, found = matches(rows, bench.select("row_id", "text"), share)
    named = found.join(bench.select(F.col("row_id").alias("item"), "item_id"), "item")
    best = named.groupBy("row_id").agg(F.min(F.struct((-F.col("share")).alias("less"), "item_id")).alias("best"), F.count("*").alias("n_items"))
    best = best.select("row_id", F.col("best.item_id").alias("item_id"), (-F.col("best.less")).alias("share"), "n_items")
    return ids.join(best, "row_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), "item_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    numbered, row = with_rows(docs, "uncut")
    rows = numbered.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing() as paths:
        _, found = matches(rows, _bench(items).select("row_id", "text"), share)
    out = without_rows(numbered, row, found.select("row_id"), BROADCAST_ROWS)
    remove(docs.sparkSession, paths)
    return out
