import os
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from test_neardup import sets_of
from test_tokens import direct

from vigil.llm import common, decontam, mixing, neardup, quality

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{AT}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, AT).toPandas())
        out.append((name, before, docs))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns(spark, stages):
    columns = spark.read.parquet(f"{AT}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in stages[:-1])
    assert [n for n, _, _ in stages] == ["quality", "neardup", "decontam", "mixing", "token_ids"]


def test_quality_keeps_what_is_predicted(spark, stages):
    _, before, after = stages[0]
    predicted = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{AT}/labels.parquet")).collect() if r.predicted}
    assert ids(after) == predicted
    good = {r.doc_id for r in spark.read.parquet(f"{AT}/labels.parquet").where("quality = 1").collect()}
    assert len(good & predicted) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    sets = [(d, s) for d, s in sets_of([(r.doc_id, r.text) for r in before.collect()])]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    assert ids(after) == {d for d, _ in sets if find(d) == d}


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    bad = {r.doc_id for r in decontam.report(before, spark.read.parquet(f"{AT}/benchmark.parquet")).collect() if r.contaminated}
    assert ids(after) == ids(before) - bad


def test_mixing_draws(stages):
    _, before, after = stages[3]
    assert ids(after) == {r.doc_id for r in mixing.mix(before).collect() if r.sampled}


def test_last_stage_and_run(spark, stages):
    _, before, after = stages[4]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    encoded = direct(corpus_pipeline.tokenizer_path(), [t for _, t in rows])
    start, want = 0, []
    for (d, _), x in zip(rows, encoded, strict=True):
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, after.collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, AT).collect())) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row long, row_id string"


def odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    item = spark.read.parquet(f"{AT}/benchmark.parquet").where("length(text) > 120").orderBy("item_id").first().text
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (2, "another text " + text[:40], None, None), (3, "said " + item, "en", "b"), (3, "a clean row with that id", "en", "b")]
    rows += [(None, text + " more", "de", ""), (None, item, "de", "b"), (None, "a clean row without an id", "de", "b"), (5, None, None, None), (5, "", "fr", "a"), (5, "", "fr", "a"), (6, "long " * 50_000, "fr", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x") for r in rows], ODD)


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, at):
    """Nulls, empty and very long texts, ids that repeat or are null, and columns with names that operators use."""
    name, stage = corpus_pipeline.STAGES[at]
    docs = odd_rows(spark)
    before = [tuple(r) for r in docs.collect()]
    out = stage(spark, docs, AT)
    rows = out.collect()
    if name == "token_ids":
        assert len(rows) == len(before) and sum(r.doc_id is None for r in rows) == 3
    else:
        assert out.columns == docs.columns and all(tuple(r) in before for r in rows)
    texts = {(r[0], r[1]) for r in before}
    if name == "neardup":
        kept = sorted(((r.doc_id, r.text) for r in rows), key=str)
        # the second copy goes, with its id's other text left alone, as do the near-copies without an id
        item = next(x for x in texts if x[0] is None and not x[1].startswith(("word0 ", "a clean")))
        gone = texts - set(kept)
        assert gone == {x for x in texts if x[1] and x[1].startswith("word0 ") and x[0] != 1} | {item}
        assert sum(x == (5, "") for x in kept) == 2
    if name == "decontam":
        assert sorted(r.text for r in rows if r.doc_id == 3) == ["a clean row with that id"]
        assert sorted(r.text for r in rows if r.doc_id is None and "word" not in r.text) == ["a clean row without an id"]
        assert len(rows) == len(before) - 2
    assert stage(spark, docs.limit(0), AT).count() == 0


def left(spark, call):
    """Names of the tables that a call leaves in the shared folder, and what it returns."""
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(os.listdir(folder)) if folder.exists() else set()
    out = call()
    # not the folder of Spark's own checkpoints, whose name is a UUID alone
    return sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if x.count("-") < 4), out


def test_stages_leave_no_copies(spark):
    """Rows of files are numbered where they are, and tables that only decide are removed."""
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("neardup", "decontam"):
            tables, out = left(spark, lambda stage=stage: stage(spark, docs, AT))
            assert tables == ["spare"]
            assert out.columns == docs.columns and 0 < out.count() < docs.count()
        if name == "token_ids":
            tables, out = left(spark, lambda stage=stage: stage(spark, docs, AT))
            assert tables == ["token-files"] and out.count() == docs.count()


def test_rows_are_told_apart_wherever_they_come_from(spark, tmp_path):
    """Files read once or twice, several files, and rows of no file: all rows get numbers of their own, equal ones too."""
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (2, "x y z"), (3, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    one = f"{tmp_path}/with space.parquet"
    made.repartition(3).write.parquet(one)
    read = spark.read.parquet
    for docs, times in ((read(one), 1), (read(one, one), 2), (read(one).unionByName(read(one)), 2), (made, 1), (read(one).where("doc_id IS NULL OR doc_id > 0"), 1)):
        numbered, row = common.with_rows(docs, "rows")
        numbers = [r[row] for r in numbered.collect()]
        assert len(set(numbers)) == len(numbers) == times * len(rows)
    assert common._scanned(read(one)) and not common._scanned(read(one, one))
    kept = sorted(neardup.keep_first(read(one)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text) for r in kept] == [(1, "a b c d e f g h"), (2, "x y z"), (3, None)]
