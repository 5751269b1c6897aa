"""Operator 2: near-duplicates by a chosen-path similarity join over minwise tokens.

1. Each text becomes its set of 5-word shingles, as 64-bit hashes, and a minwise
   sketch of it. Texts with equal sets, told by 128-bit digests, form one class, so
   copies cost one row. Classes are numbered.
2. Classes go down ``n_trees`` independent trees. In the first level a node is the
   minwise token of one coordinate. A node of more than ``NODE`` classes, or of more
   than ``SHINGLES`` shingles in all, branches again, each class into the children of
   ``CHILDREN`` further pairs of tokens, so that a pair of the wanted similarity keeps
   more than one common child on average.
3. A node small enough is compared exhaustively: every pair whose sizes and sketches
   leave the similarity possible joins the candidate graph of the node, and each
   component of that graph is a candidate group. Groups, not pairs, are passed on.
4. Groups meet the full shingle sets, each once; all pairs of a group that are not
   yet connected are confirmed exactly, and only a spanning forest is emitted.
5. Components of these links, then of classes, then of documents.

A node that holds more than ``SHRINK`` of its parent, or is too large at the last level,
holds sets that agree on most tokens: branching would copy it without taking it apart.
It is dealt into blocks, each with the same few pivots, so that what the pivots link
is connected across blocks. Members that are still outside the node's main component
are then compared with all of the node, block by block.

Recall: a pair of similarity J shares a first-level node of a tree with probability J
and keeps a common child at each later branching with 1 - (1 - J^2)^2. The number of trees
is set from the threshold so that a pair right at it, linked by nothing else, is missed
with odds below 1e-6 where nodes branch three times after the first level; with six further
branchings the odds are 6e-5 at 0.85 and 3e-4 at 0.8. A pair that shares a node but is missed by its sketch
has odds below 1e-6. More children than two would keep more pairs a tree, but would copy
families of like texts faster than they fall apart.

Edge cases: a null or empty text, or one of white space only, has the empty set,
which links with nothing; with fewer than five words the sequence is the sole
shingle; repeated ids keep a row each and share links by their sets; a row with a null id
takes part like others, but never names a component or is kept; a component of null
ids alone has a null name; other columns are not read; an empty table gives no
rows. ``keep_first`` decides by rows, not ids: of each component one row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, mix64, passing, remove, stored, with_rows, without_rows, working
from vigil.llm.components import connected_components

WORDS = 5
SKETCH = 128
MISS = 1e-6
BRANCHINGS = 3
CHILDREN = 2
MAX_TREES = 64
NODE = 1024
SHINGLES = 1 << 21
DEPTH = 12
SHRINK = 0.7
PIVOTS = 8
BROADCAST_IDS = 1_000_000
_FACTORS = [U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_STEPS = np.random.default_rng(20240229).integers(1, 1 << 63, SKETCH + MAX_TREES, dtype=np.int64).astype(U64) | U64(1)
_WORD_CACHE = 300_000


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased in A-Z only; bytes split at exactly the six ASCII white space characters."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    words = words_of(text)
    if not words:
        return np.empty(0, U64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))
    if len(words) < k:
        total = U64(len(words))
        with np.errstate(over="ignore"):
            for i, h in enumerate(hashes):
                total += h * _FACTORS[i % len(_FACTORS)]
        return mix64(np.array([total], U64))
    n = len(hashes) - k + 1
    total = hashes[:n] * _FACTORS[0]
    for i in range(1, k):
        total += hashes[i : i + n] * _FACTORS[i % len(_FACTORS)]
    return np.unique(mix64(total))


def n_trees(percent: int) -> int:
    """So many that an isolated pair at the threshold is missed with odds of ``MISS`` after ``BRANCHINGS`` branchings."""
    j = percent / 100
    kept = j * (1 - (1 - j**2) ** CHILDREN) ** BRANCHINGS
    return min(MAX_TREES, int(np.ceil(np.log(MISS) / np.log(1 - kept)))) if kept < 1 else 1


def minima(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` coordinates the smallest of the set's hashes under that coordinate's permutation."""
    out = np.full(size, ~U64(0))
    low = hashes ^ (hashes >> U64(29))
    for at in range(0, len(low), 1024):
        x = low[None, at : at + 1024] * _STEPS[:size, None]
        x ^= x >> U64(32)
        np.minimum(out, x.min(axis=1), out=out)
    return out


_FEATURES = "row long, doc_id long, n_shingles long, digest binary, sketch binary, tokens array<long>"


def _features(trees: int):
    names = [x.split()[0] for x in _FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("neardup", _HASHES.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, digests, sketches, tokens = [], [], [], []
                for text in part["text"].to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    if not len(s):
                        digests.append(None), sketches.append(None), tokens.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    m = mix64(minima(s, SKETCH + trees))
                    sketches.append(m[:SKETCH].astype(np.uint8).tobytes())
                    tokens.append(m[SKETCH:].view(np.int64))
                columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], *columns], names)

    return run


def least_agreement(similarity: float, size: int = SKETCH, deviations: float = 5.5) -> int:
    """Agreeing sketch coordinates below which the similarity is ruled out."""
    expected = similarity + (1 - similarity) / 256
    return int(np.floor(size * expected - deviations * np.sqrt(size * expected * (1 - expected))))


class Labels:
    """Components over positions, as an array of labels."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Join ``a`` with the others; one of them for each component that it newly met."""
        own = self.of[a]
        labels, first = np.unique(self.of[others], return_index=True)
        new = labels != own
        if new.any():
            self.of[np.isin(self.of, labels[new])] = own
        return others[first[new]]


def candidate_groups(sketches: np.ndarray, sizes: np.ndarray, percent: int, agree: int) -> list[np.ndarray]:
    """Positions of each component, of two or more, of the graph of possible pairs."""
    order = np.argsort(sizes, kind="stable")
    sizes, sketches = sizes[order], sketches[order]
    labels = Labels(len(order))
    lowest = np.searchsorted(sizes, -(-sizes * percent // 100))
    for i in range(1, len(order)):
        if lowest[i] < i:
            near = (sketches[lowest[i] : i] == sketches[i]).sum(axis=1) >= agree
            labels.join(i, lowest[i] + np.flatnonzero(near))
    by = np.argsort(labels.of, kind="stable")
    return [order[g] for g in np.split(by, np.flatnonzero(np.diff(labels.of[by])) + 1) if len(g) > 1]


def _compare_nodes(percent: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, members = [], []
            for node in batch["members"]:
                rows = node.values
                ids = rows.field("class").to_numpy()
                sizes = rows.field("n").to_numpy()
                sketches = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
                for g in candidate_groups(sketches, sizes, percent, agree):
                    who = np.sort(ids[g])
                    groups += [xxhash.xxh3_64_intdigest(who.tobytes()) - (1 << 63)] * len(who)
                    members += who.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(members, pa.int64())], ["grp", "class"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working("neardup", _HASHES.clear)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingles(x).tobytes() for x in batch.slice(at, 256)["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])


def confirmed_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose full sets reach the similarity."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    lowest = np.searchsorted(sizes, -(-sizes * percent // 100))
    labels, links = Labels(len(order)), []
    for i in range(1, len(order)):
        low = lowest[i]
        if low == i or (labels.of[low:i] == labels.of[i]).all():
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat[starts[low] : starts[i]]], starts[low:i] - starts[low])
        mark[own] = 0
        close = low + np.flatnonzero(100 * common >= percent * (sizes[low:i] + sizes[i] - common))
        links += [(int(ids[order[i]]), int(ids[order[j]])) for j in labels.join(i, close)]
    return links


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for group in batch["members"]:
                rows = group.values
                sets = [np.frombuffer(x, U64) for x in rows.field("shingles").to_pylist()]
                for a, b in confirmed_links(rows.field("class").to_numpy(), sets, percent):
                    u.append(a), v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, class) rows of nodes small enough to compare, of every level; (node, class, n, size, weight) of those that never will be.

    ``size`` is how many classes a node has, ``weight`` how many shingles they have in all.
    """
    done: list[DataFrame] = []
    stuck: list[DataFrame] = []
    level = classes.select("class", "n", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "tree", "class", "n", F.lit(None).cast("long").alias("parent"))
    for depth in range(1, DEPTH + 1):
        # what becomes of a node is told from its size alone. Sizes are written first: a join of
        # two tables, unlike one with an aggregate on its key, can split a hot node
        facts = [F.count("*").alias("size"), F.sum("n").alias("weight"), F.max("parent").alias("of")]
        sizes = stored(level.groupBy("node").agg(*facts).where("size > 1"), "sizes")
        fits = (F.col("size") <= NODE) & (F.col("weight") <= SHINGLES)
        whole = F.lit(depth == DEPTH) | F.coalesce(F.col("size") > SHRINK * F.col("of"), F.lit(False))
        done.append(level.join(sizes.where(fits).select("node"), "node").select("node", "class"))
        found = sizes.where(~fits).agg(F.count(F.when(whole, 1)).alias("whole"), F.count(F.when(~whole, 1)).alias("more")).first()
        if found["whole"]:
            stuck.append(level.join(sizes.where(~fits & whole), "node").select("node", "class", "n", "size", "weight"))
        if not found["more"]:
            break
        # further tokens of two bytes of the sketch, at places that change with tree and level
        tokens = [f"xxhash64(node, {j}, substring(sketch, int(pmod(tree * 37 + {2 * (CHILDREN * depth + j)}, {SKETCH - 1})) + 1, 2))" for j in range(CHILDREN)]
        branching = level.drop("parent").join(sizes.where(~fits & ~whole).select("node", F.col("size").alias("parent")), "node")
        level = stored(branching.join(classes.select("class", "sketch"), "class").select(F.explode(F.array(*map(F.expr, tokens))).alias("node"), "tree", "class", "n", "parent"), "nodes")
    large = stored(_union(stuck), "large") if stuck else None
    return _union(done if large is None else [*done, _blocks(large)]), large


def _parts(factor: int, size: str = "size", weight: str = "weight") -> str:
    """SQL for how many blocks of a ``factor``-th of a node's limits hold so many classes and shingles."""
    return f"CAST(ceil(greatest({size} * {factor} / {NODE}, {weight} * {factor} / {SHINGLES})) AS BIGINT)"


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _blocks(large: DataFrame) -> DataFrame:
    """Blocks of nodes that never fell apart, each with the node's pivots."""
    chosen = [F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("h"), "class")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = large.groupBy("node").agg(*chosen).select("node", F.array_distinct(F.array(*[F.col(f"p{i}.class") for i in range(PIVOTS)])).alias("pivots"))
    parts = large.select(F.col("node").alias("whole"), F.expr(f"xxhash64(node, pmod(xxhash64(class), {_parts(2)}))").alias("node"), "class")
    led = parts.select("whole", "node").distinct().join(pivots.withColumnRenamed("node", "whole"), "whole").select("node", F.explode("pivots").alias("class"))
    return parts.select("node", "class").unionByName(led).distinct()


def _links(rows: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes, confirmed on full sets: a spanning forest for each candidate group."""
    compared = (
        nodes.join(classes.select("class", "n", "sketch"), "class")
        .groupBy("node")
        .agg(F.collect_list(F.struct("class", "n", "sketch")).alias("members"))
        .select("members")
        .mapInArrow(_compare_nodes(percent, least_agreement(percent / 100)), "grp long, class long")
    )
    groups = stored(compared.distinct(), "groups")
    wanted = stored(groups.select("class").distinct().join(classes.select("class", "digest", F.col("least.doc_id").alias("rep")), "class"), "wanted")
    # the texts of few classes are wanted: their ids are broadcast up to a size, else joined by a shuffle; a null id stands for all texts without one
    reps = wanted.select("rep").distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(reps) if few else reps, rows["doc_id"].eqNullSafe(reps["rep"]), "left_semi").select("text")
    # an id may have other texts too, and a text may come several times. All is by digest, so that sets are dealt once, then to their groups
    sets = texts.mapInArrow(_sets, "digest binary, shingles binary").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    links = (
        groups.join(wanted.select("class", "digest"), "class")
        .join(sets, "digest")
        .groupBy("grp")
        .agg(F.collect_list(F.struct("class", "shingles")).alias("members"))
        .select("members")
        .mapInArrow(_confirm(percent), "u long, v long")
    )
    return stored(links, "links")


def _rest(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, class) rows that bring members outside a large node's main component to all its members, in blocks."""
    placed = large.join(roots.withColumnRenamed("node", "class"), "class", "left").select("node", "size", "weight", "class", "n", F.coalesce("root", "class").alias("root"))
    main = stored(placed.groupBy("node", "root").agg(F.count("*").alias("of")).groupBy("node").agg(F.max(F.struct("of", "root")).alias("main")), "main")
    placed = stored(placed.join(main, "node").select("node", "class", "n", (F.col("root") != F.col("main.root")).alias("out"), F.expr(_parts(4)).alias("parts")), "placed")
    queries = stored(placed.where("out").groupBy("node").agg(F.expr(_parts(4, "count(*)", "sum(n)")).alias("rounds")), "queries")
    placed = placed.join(queries, "node")
    spread = "explode(sequence(0L, {} - 1))"
    members = placed.select("node", "class", F.expr("pmod(xxhash64(class), parts)").alias("part"), F.expr(spread.format("rounds")).alias("round"))
    asked = placed.where("out").select("node", "class", F.expr(spread.format("parts")).alias("part"), F.expr("pmod(xxhash64(class, 1), rounds)").alias("round"))
    return members.unionByName(asked).select(F.xxhash64("node", "part", "round").alias("node"), "class").distinct()


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_shingles``, ``digest``, ``class_id``, ``component_id`` and ``first_row`` of rows (row, doc_id, text).

    ``class_id`` and ``component_id`` are the least ids with the same set and in the component,
    ``first_row`` is the component's row with the least id; they are null without a set.
    """
    features = stored(rows.mapInArrow(_features(n_trees(percent)), _FEATURES), "features")
    # equal sets have equal sketches, so any row of a class will do
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least")
    firsts = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("sketch", "sketch"), ("tokens", "tokens"))]
    with passing() as paths:
        classes = stored(features.where("digest IS NOT NULL").groupBy("digest").agg(least, *firsts).withColumn("class", F.monotonically_increasing_id()), "classes")
        nodes, large = _nodes(classes)
        links = _links(rows, classes, nodes, percent)
        roots = connected_components(links)
        if large is not None:
            links = stored(links.unionByName(_links(rows, classes, _rest(large, roots), percent)), "links")
            roots = connected_components(links)
        named = stored(classes.select("digest", "class", "least").join(roots, F.col("class") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "class").alias("root")), "named")
        first = stored(named.groupBy("root").agg(F.min("least").alias("first")), "least")
    named = stored(named.join(first, "root").select("digest", F.col("least.doc_id").alias("class_id"), F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")), "class-roots")
    remove(rows.sparkSession, paths)
    return features.select("row", "doc_id", "n_shingles", "digest").join(named, "digest", "left")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``class_id`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _components(rows.withColumn("row", F.monotonically_increasing_id()), percent)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the least id, with all its columns. Texts without words stay."""
    numbered, row = with_rows(docs, "all-rows")
    rows = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing() as paths:
        found = _components(rows, percent)
    out = without_rows(numbered, row, found.where("first_row IS NOT NULL AND row <> first_row").select("row"), BROADCAST_IDS)
    remove(docs.sparkSession, paths)
    return out


def oracle(percent: int = 85) -> str:
    """The query's rows, as DuckDB SQL over all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) END)) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), m AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
