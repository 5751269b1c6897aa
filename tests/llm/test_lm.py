import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vigil.llm import lm
from vigil.llm.common import stored

DOCS = "doc_id long, text string, wanted string, score int"


def brute(rows, wanted):
    """Losses by dictionaries, each document without its own counts."""
    ids = {i: lm.word_ids(t) for i, (_, t) in enumerate(rows)}
    pairs = {i: lm.bigram_ids(x) for i, x in ids.items()}

    def model(members, but):
        c, w, b = Counter(), Counter(), Counter()
        for i in members:
            if i != but:
                c.update(ids[i][:-1].tolist())
                w.update(ids[i][1:].tolist())
                b.update(pairs[i].tolist())
        return c, w, b

    out = {}
    vocabulary = len({w for x in ids.values() for w in x[1:].tolist()}) + 1
    for i, (doc_id, _) in enumerate(rows):
        losses = []
        for members in ([j for j, (d, _) in enumerate(rows) if d in wanted], range(len(rows))):
            c, w, b = model(members, i)
            total = sum(w.values()) + lm.UNIGRAM_SMOOTHING * vocabulary
            terms = [
                -math.log((b[p] + lm.BIGRAM_SMOOTHING * (w[y] + lm.UNIGRAM_SMOOTHING) / total) / (c[x] + lm.BIGRAM_SMOOTHING))
                for x, y, p in zip(ids[i][:-1].tolist(), ids[i][1:].tolist(), pairs[i].tolist(), strict=True)
            ]
            losses.append(sum(terms) / len(terms) if terms else 0.0)
        out[doc_id] = losses
    return out


def test_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = {d for d, _ in rows[::3]}
    got = lm.score(docs, spark.createDataFrame([(d,) for d in wanted], "doc_id long")).collect()
    want = brute(rows, wanted)
    for r in got:
        assert np.allclose([r.target_loss, r.background_loss], want[r.doc_id], atol=1e-9)
        assert r.score == r.target_loss - r.background_loss


def test_target_like_documents_score_lower(spark):
    rows = [(i, "the red fox runs over the hill " * 3 + f"x{i}", "", 1) for i in range(20)] + [(i, "bits and bytes in one long row " * 3 + f"x{i}", "", 1) for i in range(20, 40)]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in range(10)], "doc_id long")).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, 40))


def test_edge_rows(spark):
    rows = [(1, None, "", 1), (2, "", "", 1), (None, "a b", "", 1), (3, "a b", "", 1), (3, "a b", "", 1), (4, "w " * 100_000, "", 1)]
    got = lm.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert lm.score(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long")).count() == 0


def test_real_strings_are_counted_apart(spark, monkeypatch):
    """Against counts by strings, with more words and bigrams than a table of fixed size would tell apart."""
    monkeypatch.setattr(lm, "CHUNK", 40_000, raising=False)
    monkeypatch.setattr(lm, "SLICE", 20_000, raising=False)
    rows = [(d, " ".join(f"w{d}x{i} w{(d * 7 + i) % 900}" for i in range(3000))) for d in range(90)] + [(900, "w1x1 w8 never w1x1"), (901, "")]
    wanted = {d for d, _ in rows[::3]}
    texts = {d: ["", *t.split()] for d, t in rows}
    counts = {}
    for name, members in (("target", wanted), ("background", set(texts))):
        counts[name] = c = Counter(), Counter(), Counter()
        for d in members:
            c[0].update(texts[d][:-1])
            c[1].update(texts[d][1:])
            c[2].update(zip(texts[d], texts[d][1:], strict=False))
    vocabulary = len(counts["background"][1]) + 1
    assert vocabulary > 1 << 18
    want = {}
    for d, words in texts.items():
        for name, (c, w, b) in counts.items():
            mine = d in wanted or name == "background"
            oc, ow, ob = (Counter(x) if mine else Counter() for x in (words[:-1], words[1:], zip(words, words[1:], strict=False)))
            total = w.total() - ow.total() + lm.UNIGRAM_SMOOTHING * vocabulary
            terms = [
                -math.log((b[x, y] - ob[x, y] + lm.BIGRAM_SMOOTHING * (w[y] - ow[y] + lm.UNIGRAM_SMOOTHING) / total) / (c[x] - oc[x] + lm.BIGRAM_SMOOTHING)) for x, y in zip(words, words[1:], strict=False)
            ]
            want[d, name] = sum(terms) / len(terms) if terms else 0
    docs = spark.createDataFrame([(d, t, "", 1) for d, t in rows], DOCS).repartition(3)
    got = lm.score(docs, spark.createDataFrame([(d,) for d in wanted], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose([r.target_loss, r.background_loss], [want[r.doc_id, "target"], want[r.doc_id, "background"]], rtol=0, atol=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    words = "a b a c b a d a b".split()
    one = lm.word_ids(" ".join(words))
    distinct = sorted(set(one[1:].tolist()))
    totals, vocabulary = len(words), len(distinct) + 1
    for context in (0, *distinct):
        sums = 0.0
        for word in (*distinct, None):
            c = sum(x == context for x in one[:-1].tolist())
            b = sum(x == context and y == word for x, y in zip(one[:-1].tolist(), one[1:].tolist(), strict=True))
            w = sum(y == word for y in one[1:].tolist())
            sums += (b + lm.BIGRAM_SMOOTHING * (w + lm.UNIGRAM_SMOOTHING) / (totals + lm.UNIGRAM_SMOOTHING * vocabulary)) / (c + lm.BIGRAM_SMOOTHING)
        assert abs(sums - 1) < 1e-12


def test_what_moves_between_tasks_is_small():
    """A key with its counts takes less than its 8 bytes and a counter would, and totals come back as they went."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 50_000) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array([i % 3 == 0 for i in range(300)])], ["doc_id", "text", "wanted"])
    (chunk,) = lm._chunks(iter([batch]))
    part = chunk.to_pylist()[0]
    own = lm.Chunk(part["wanted"], part["sizes"], part["vocabulary"], part["at"])
    assert len(part["at"]) < 2 * part["words"]
    (asks,) = lm._asks(8)(iter([chunk.append_column("chunk", pa.array([0], pa.int64()))]))
    bytes_asked = sum(len(x) for name in asks.schema.names if name not in ("chunk", "slice") for x in asks[name].to_pylist())
    assert bytes_asked < 9 * len(own.keys)
    assert len(own.keys) == len({w for t in texts for w in t.split()}) + 1 + len({p for t in texts for p in zip(["", *t.split()], t.split(), strict=False)})
    (answer,) = lm._answers(iter([asks.slice(0, 1)]))
    assert sum(lm._unpack(answer["totals"][0].as_py(), *lm._COUNTS)[0]) == own.counts()[0][own.order][: len(lm._unpack(asks["keys"][0].as_py(), np.uint64)[0])].sum()


def test_written_tables_leave_no_shuffle_files(spark):
    """Disk of a shuffle is free once its table is written."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(f.getName().endswith(".data") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))
    before = count()
    rows = stored(spark.range(1000).repartitionById(3, (F.col("id") % 3).cast("int")), "rows")
    for _ in range(50):
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before and rows.count() == 1000
