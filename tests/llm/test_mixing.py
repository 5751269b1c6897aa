import duckdb
import pytest

from vigil.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight string, probability string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0, "", "") for i, t, g, s in rows], SCHEMA)


def test_matches_sql(spark, small):
    got = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(mixing.oracle()).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_marginals_meet_targets_and_budget(spark):
    rows = [(i, "w " * (5 + i % 7) + ("x | y" if i % 3 else ""), ("en", "de")[i % 4 == 0], f"s{(i * i) % 5}") for i in range(400)]
    shares = {"source": {f"s{k}": 1 / 3 for k in (0, 1, 4)}, "lang": {"en": 0.6, "de": 0.4}}
    cells = mixing.described(rows_of(spark, rows)).groupBy(*mixing.MARGINS).sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    raked = mixing.raked(cells, mixing.Targets(shares=shares), sweeps=40).collect()
    for margin, wanted in shares.items():
        for value, share in wanted.items():
            assert sum(r.weight for r in raked if r[margin] == value) == pytest.approx(share, abs=1e-4)
    got = mixing.mix(rows_of(spark, rows), mixing.Targets(shares=shares), budget=0.5).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.5 * total, rel=1e-6)
    assert max(r.probability for r in got) <= 1


def test_edge_rows(spark):
    rows = [(1, None, None, None), (None, "", "en", "a"), (2, "a b", "en", "a"), (2, "a b", "en", "a"), (3, "w " * 100_000, "de", "b")]
    got = mixing.mix(rows_of(spark, rows)).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert mixing.mix(rows_of(spark, [])).count() == 0
    assert {r.probability for r in mixing.mix(rows_of(spark, [(1, "", "a", "b"), (2, None, "a", "c")])).collect()} == {mixing.BUDGET}
    drawn = mixing.sample(rows_of(spark, rows))
    assert drawn.columns == rows_of(spark, rows).columns
    whole = mixing.sample(rows_of(spark, rows), budget=1.0)
    assert whole.count() >= 3


def test_sample_draws_what_mix_says(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert {r.doc_id for r in mixing.sample(docs).collect()} == {r.doc_id for r in mixing.mix(docs).collect() if r.sampled}
