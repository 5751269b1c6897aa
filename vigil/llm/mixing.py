"""Operator 6: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic with their tokens.
Cell weights are raked: in each sweep they are scaled so that the shares of sources,
then of languages, then of topics meet their targets. The ratio of raked to observed
tokens of a cell, times one factor, is the probability of its documents; the factor
is solved exactly so that the expected tokens meet the budget with no probability
above one. A document is drawn if a hash of its id, as a number in [0, 1), is below
its probability.

Everything is DataFrame expressions. Only cells, one row for each combination that
occurs, are raked; documents are read once for their token counts.

Topics are the first rule whose pattern the text matches; targets are given shares,
or the observed shares raised to a power below one, which favours the small.

Edge cases: a null source or language is the empty one; a null text has no tokens
and the last topic; tokens are runs of other than ASCII white space; rows with equal
ids share their draw; null ids hash as empty text; an empty table gives no rows.
With no tokens at all every probability is the budget. Other columns are not read,
and ``sample`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored

SWEEPS = 8
BUDGET = 0.8
BROADCAST_CELLS = 100_000
TOPICS = (("legal", "(?i)licen[cs]e|copyright"), ("contact", "@|[+][0-9]"), ("tabular", "[|]"))
OTHER_TOPIC = "prose"
MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"


@dataclass
class Targets:
    """For each margin either shares by value, or the power of the observed shares."""

    powers: Mapping[str, float] = field(default_factory=lambda: dict(POWERS))
    shares: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def draw_of(column: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the id as text."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def described(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """``doc_id``, margins and tokens of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic_of(text, topics).alias("topic"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("tokens"),
    )


def raked(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with ``share`` observed, and ``weight``, the share after raking."""
    everything = Window.partitionBy(F.lit(0))
    out = cells.withColumn("share", F.try_divide("tokens", F.sum("tokens").over(everything)))
    for margin in MARGINS:
        own = Window.partitionBy(margin)
        if margin in targets.shares:
            wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in targets.shares[margin].items() for x in pair]), F.col(margin)), F.lit(0.0))
            out = out.withColumn(f"_{margin}", wanted)
        else:
            out = out.withColumn("_observed", F.sum("share").over(own))
            # one row of each value stands for it in the sum of the raised shares
            once = F.when(F.row_number().over(own.orderBy(*MARGINS)) == 1, F.pow("_observed", F.lit(targets.powers[margin])))
            out = out.withColumn("_once", once).withColumn(f"_{margin}", F.try_divide(F.pow("_observed", F.lit(targets.powers[margin])), F.sum("_once").over(everything)))
            out = out.drop("_observed", "_once")
    out = out.withColumn("weight", F.col("share"))
    for _ in range(sweeps):
        for margin in MARGINS:
            total = F.sum("weight").over(Window.partitionBy(margin))
            out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"_{margin}") / total).otherwise(0.0))
    return out.select(*MARGINS, "tokens", "share", "weight")


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with ``probability``: ratio times the factor at which the expected tokens are ``budget`` of all.

    With cells by descending ratio, the first ones are capped at one; the factor is
    that of the shortest such prefix after which no ratio exceeds one.
    """
    ratio = F.when(F.col("share") > 0, F.col("weight") / F.col("share")).otherwise(0.0)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").desc(), *MARGINS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    out = (
        cells.withColumn("ratio", ratio)
        .withColumn("_capped", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum(F.col("share") * F.col("ratio")).over(after))
        .withColumn("_factor", F.when(F.col("_rest") > 0, (F.lit(budget) - F.col("_capped")) / F.col("_rest")))
    )
    fits = F.when((F.col("_factor") >= 0) & (F.col("_factor") * F.col("ratio") <= 1), F.col("_factor"))
    out = out.withColumn("_chosen", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    probability = F.when(F.col("share").isNull(), F.lit(budget)).when(F.col("_chosen").isNull(), F.when(F.col("ratio") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.col("ratio") * F.col("_chosen")))
    return out.select(*MARGINS, F.round("ratio", 9).alias("weight"), F.round(probability, 9).alias("probability"))


def mix(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, topics=TOPICS) -> DataFrame:
    """Every row's ``doc_id``, margins, tokens, weight, probability and whether it is drawn."""
    rows = stored(described(docs, topics), "described")
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    rated = stored(calibrated(raked(cells, targets or Targets(), sweeps), budget), "cells")
    rated = F.broadcast(rated) if rated.count() <= BROADCAST_CELLS else rated
    out = rows.join(rated, list(MARGINS))
    return out.select("doc_id", *MARGINS, "tokens", "weight", "probability", (draw_of("doc_id") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, topics=TOPICS) -> DataFrame:
    """The drawn rows with all their columns."""
    cells = stored(described(docs, topics).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    rated = stored(calibrated(raked(cells, targets or Targets(), sweeps), budget), "rated")
    few = rated.count() <= BROADCAST_CELLS
    rated = rated.select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINS], F.col("probability").alias("_mix_p"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), topic_of(text, topics).alias("_topic"))
    joined = keyed.join(F.broadcast(rated) if few else rated, (F.col("_source") == F.col("_mix_source")) & (F.col("_lang") == F.col("_mix_lang")) & (F.col("_topic") == F.col("_mix_topic")))
    return joined.where(draw_of("doc_id") < F.col("_mix_p")).select(*[docs[c] for c in docs.columns])


def oracle(budget: float = BUDGET, sweeps: int = SWEEPS) -> str:
    """The query's rows, as DuckDB SQL."""
    quoted = ",".join(MARGINS)
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [
        f"d AS (SELECT doc_id::BIGINT AS doc_id, coalesce(source,'') AS source, coalesce(lang,'') AS lang, CASE {cases} ELSE '{OTHER_TOPIC}' END AS topic, "
        "len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens FROM (SELECT *, coalesce(text,'') AS t FROM documents))",
        f"k AS MATERIALIZED (SELECT {quoted}, sum(tokens)::DOUBLE AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS share FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"o_{m} AS (SELECT {m}, pow(sum(share), {POWERS[m]}) AS p FROM k GROUP BY {m})")
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS target FROM o_{m})")
    steps.append("w0 AS MATERIALIZED (SELECT *, share AS weight FROM k)")
    at = 0
    for _ in range(sweeps):
        for m in MARGINS:
            steps.append(f"w{at + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN s.total > 0 THEN w.weight * t.target / s.total ELSE 0 END AS weight) FROM w{at} w JOIN (SELECT {m}, sum(weight) AS total FROM w{at} GROUP BY {m}) s USING ({m}) JOIN t_{m} t USING ({m}))")
            at += 1
    steps += [
        f"r AS (SELECT *, CASE WHEN share > 0 THEN weight / share ELSE 0 END AS ratio FROM w{at})",
        f"c AS MATERIALIZED (SELECT *, coalesce(sum(share) OVER (ORDER BY ratio DESC, {quoted} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(share * ratio) OVER (ORDER BY ratio DESC, {quoted} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r)",
        f"f AS (SELECT max(x) FILTER (WHERE n = 1) AS factor FROM (SELECT ({budget} - capped) / rest AS x, row_number() OVER (ORDER BY ratio DESC, {quoted}) AS n FROM c WHERE rest > 0 AND {budget} - capped >= 0 AND ({budget} - capped) / rest * ratio <= 1))",
        f"p AS (SELECT {quoted}, round(ratio, 9) AS weight, round(CASE WHEN factor IS NULL THEN CASE WHEN ratio > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, ratio * factor) END, 9) AS probability FROM c, f)",
    ]
    return (
        "WITH " + ", ".join(steps) + f" SELECT doc_id, {quoted}, tokens, weight, probability, "
        "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0) < probability AS sampled FROM d JOIN p USING (" + quoted + ")"
    )
