"""Queries of the chart score and of the baseline scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import scoring as G
from panelforge.plans import factor_queries as Q
from panelforge.plans import selection_queries as L
from panelforge.plans.common import Registry

register = Registry()
FACTORS = ["confirmed", "composite", "recency", "alignment", "atr_contraction", "rsi"]
PARTS = ("chart_breakouts", "bollinger", "ma_cross_recency", "wilder_rsi")


@register(f"""WITH x AS (SELECT ticker, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FACTORS)} FROM {' JOIN '.join(f'({Q.register.oracles[q]}) {q}' + (' USING (ticker)' if i else '') for i, q in enumerate(PARTS))}),
w AS (SELECT ticker, {', '.join(f'{L._wins(f)} AS w{i}' for i, f in enumerate(FACTORS))} FROM x), r AS (SELECT ticker, {', '.join(f'{Q._midrank_sql(f"w{i}")} AS r{i}' for i in range(len(FACTORS)))} FROM w)
SELECT ticker, round(({' + '.join(f'coalesce(r{i}, 50)' for i in range(len(FACTORS)))}) / {len(FACTORS)}, 6) AS score FROM r""")
def chart_score(spark, sf_dir):
    rows = None
    for name in PARTS:
        part = Q.register.queries[name](spark, sf_dir)
        rows = part if rows is None else rows.join(part, "ticker")
    scored = G.chart_scores(rows.withColumn("sel", F.lit(1)), FACTORS, "sel")
    return scored.select("ticker", F.round("score", 6).alias("score"))


@register(L.STOCKS_SQL + f""", bw AS (SELECT ticker, {L._wins('CASE WHEN liquid THEN trend_mid_1 END')} AS w0, {L._wins('CASE WHEN liquid THEN earnings END')} AS w1, failed, liquid FROM stocks),
br AS (SELECT *, {Q._midrank_sql('w0')} AS a, coalesce({Q._midrank_sql('w1')}, CASE WHEN failed THEN 5 ELSE 50 END) AS b FROM bw)
SELECT ticker, round((coalesce(a, 0) + b) / (1 + (a IS NOT NULL)::INT), 6) AS equal_score, round((0.03 * coalesce(a, 50) + 0.01 * b) / 0.04, 6) AS weighted_score FROM br WHERE liquid""")
def baseline_scores(spark, sf_dir):
    stocks = L.stocks_at(spark, sf_dir).withColumn("liquid", F.coalesce(F.col("adv60") >= L.FLOOR, F.lit(False)))
    mask = lambda c: F.when(F.col("liquid"), F.col(c))
    ranked = G.with_ranks(stocks, {"a": mask("trend_mid_1"), "b0": mask("earnings")}, "sel").withColumn("b", G.fill_missing(F.col("b0"), F.col("earnings_failed")))
    ranked = ranked.filter("liquid").withColumn("equal", G.row_mean(F.col("a"), F.col("b")))
    return G.weighted_scores(ranked, ["a", "b"], {"a": 0.03, "b": 0.01}).select("ticker", F.round("equal", 6).alias("equal_score"), F.round("score", 6).alias("weighted_score"))
