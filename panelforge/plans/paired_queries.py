"""Queries that hold selections against each other, and strict reading of extracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle
from panelforge.functions.scalar import midrank
from panelforge.operators import audits
from panelforge.operators import backtest as B
from panelforge.operators import forward as Z
from panelforge.operators import legs as G
from panelforge.operators import panel as P
from panelforge.plans import evaluation_queries as E
from panelforge.plans.common import Registry, bars_of, meta_of, rounded
from panelforge.plans.factor_queries import _midrank_sql
from panelforge.sources.tables import read_table

register = Registry()

#: Two legs: the best ten of all instruments, and of the larger half of them.
LEGS_SQL = E.PICKS_SQL + """, big AS (SELECT ticker FROM meta QUALIFY mktcap >= median(mktcap) OVER ()),
arm AS (SELECT sel_day, ticker FROM score WHERE score IS NOT NULL AND ticker IN (SELECT ticker FROM big) QUALIFY row_number() OVER (PARTITION BY sel_day ORDER BY score DESC, ticker) <= 10)"""


def legs(spark, sf_dir):
    """(score, returns, base picks, gated picks)."""
    score, returns = E.forward(spark, sf_dir)
    instruments = meta_of(spark, sf_dir)
    big = instruments.join(F.broadcast(instruments.agg(F.percentile("mktcap", 0.5).alias("m")))).filter("mktcap >= m").select("ticker")  # a single row
    return score, returns, settle(E.top_picks(score)), settle(E.top_picks(score.join(big, "ticker", "left_semi")))


@register(LEGS_SQL + """, r AS (SELECT w.sel_day, w.horizon, count(*) AS n, count(p.ticker) AS b, count(a.ticker) AS o FROM win w LEFT JOIN pick p ON p.sel_day = w.sel_day AND p.ticker = w.ticker LEFT JOIN arm a ON a.sel_day = w.sel_day AND a.ticker = w.ticker GROUP BY ALL)
SELECT horizon, count(*) AS periods, round(sum(b) / sum(n), 6) AS base_recall, round(sum(o) / sum(n), 6) AS leg_recall, round(avg(o / n - b / n), 6) AS lift, round(quantile_cont(o / n - b / n, 0.05), 6) AS low, round(quantile_cont(o / n - b / n, 0.95), 6) AS high FROM r GROUP BY horizon""")
def leg_comparison(spark, sf_dir):
    _, returns, base, gated = legs(spark, sf_dir)
    both = base.select(F.lit("base").alias("leg"), "sel_day", "ticker").union(gated.select(F.lit("gated").alias("leg"), "sel_day", "ticker"))
    out = G.paired_legs(G.pooled_recall(both, Z.winners(returns)), "base", "gated")
    return out.select("horizon", "periods", *rounded("base_recall", "leg_recall", "lift", "low", "high"))


@register(LEGS_SQL + """ SELECT w.sel_day, w.horizon, count(*) AS cut_winners, round(avg(w.ret), 6) AS mean_return FROM win w JOIN pick p ON p.sel_day = w.sel_day AND p.ticker = w.ticker
WHERE NOT EXISTS (SELECT 1 FROM arm a WHERE a.sel_day = w.sel_day AND a.ticker = w.ticker) GROUP BY ALL""")
def gate_cut_returns(spark, sf_dir):
    _, returns, base, gated = legs(spark, sf_dir)
    return G.gate_cuts(base, gated, Z.winners(returns)).groupBy("sel_day", "horizon").agg(F.count(F.lit(1)).alias("cut_winners"), F.round(F.avg("ret"), 6).alias("mean_return"))


WON_SQL = """, won AS (SELECT DISTINCT sel_day, ticker FROM win), tot AS (SELECT sel_day, count(*) AS winners FROM won GROUP BY 1), siz AS (SELECT sel_day, count(*) AS size FROM score WHERE score IS NOT NULL GROUP BY 1)"""


@register(E.PICKS_SQL + WON_SQL + """, res AS (SELECT sel_day, ticker, mktcap FROM score JOIN meta USING (ticker) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sel_day ORDER BY mktcap DESC, ticker) <= 10),
add_ AS (SELECT sel_day, ticker FROM res r WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.sel_day = r.sel_day AND p.ticker = r.ticker) QUALIFY row_number() OVER (PARTITION BY sel_day ORDER BY mktcap DESC, ticker) <= 3),
k AS (SELECT sel_day, count(*) AS k FROM add_ GROUP BY 1),
keep AS (SELECT p.sel_day, ticker FROM (SELECT *, row_number() OVER (PARTITION BY sel_day ORDER BY score, ticker) AS r FROM pick) p LEFT JOIN k USING (sel_day) WHERE r > coalesce(k, 0)),
sel AS (SELECT * FROM keep UNION ALL SELECT * FROM add_), h AS (SELECT s.sel_day, count(*) AS selected, count(w.ticker) AS hits FROM sel s LEFT JOIN won w ON w.sel_day = s.sel_day AND w.ticker = s.ticker GROUP BY 1)
SELECT sel_day, selected, round(hits / winners, 6) AS recall, round(selected / size, 6) AS random, round(hits / winners - selected / size, 6) AS lift FROM h JOIN tot USING (sel_day) JOIN siz USING (sel_day)""")
def reserve_generator(spark, sf_dir):
    score, returns = E.forward(spark, sf_dir)
    scored = score.filter("score IS NOT NULL")
    other = scored.join(meta_of(spark, sf_dir).select("ticker", "mktcap"), "ticker").select("sel_day", "ticker", F.col("mktcap").alias("score"))
    picks = G.reserve_arm(settle(E.top_picks(score)), E.top_picks(other), 3)
    return G.lift_over_random(picks, Z.winners(returns), scored).select("sel_day", "selected", *rounded("recall", "random", "lift"))


@register(E.PICKS_SQL + WON_SQL + """, sel AS (SELECT n, sel_day, ticker FROM (SELECT *, row_number() OVER (PARTITION BY sel_day ORDER BY score DESC, ticker) AS r FROM score WHERE score IS NOT NULL), (VALUES (5), (10), (20)) v(n) WHERE r <= n),
h AS (SELECT n, s.sel_day, count(*) AS selected, count(w.ticker) AS hits FROM sel s LEFT JOIN won w ON w.sel_day = s.sel_day AND w.ticker = s.ticker GROUP BY ALL)
SELECT n, count(*) AS periods, round(avg(hits / winners), 6) AS recall, round(avg(hits / winners - selected / size), 6) AS lift FROM h JOIN tot USING (sel_day) JOIN siz USING (sel_day) GROUP BY n""")
def selector_sizes(spark, sf_dir):
    score, returns = E.forward(spark, sf_dir)
    scored = score.filter("score IS NOT NULL")
    ranked = E.top_picks(score, 20).withColumn("r", F.row_number().over(Window.partitionBy("sel_day").orderBy(F.desc("score"), "ticker")))
    picks = ranked.withColumn("n", F.explode(F.array(*map(F.lit, (5, 10, 20))))).filter("r <= n")
    return G.lift_over_random(picks, Z.winners(returns), scored, "n").groupBy("n").agg(F.count(F.lit(1)).alias("periods"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("lift"), 6).alias("lift"))


@register(E.FORWARD_SQL + """, e AS (SELECT s.sel_day, s.ticker, s.score, CASE WHEN m.mktcap > 0 THEN round(m.mktcap / 500) END AS earnings FROM score s JOIN meta m USING (ticker) WHERE s.score IS NOT NULL)
SELECT sel_day, ticker, CASE WHEN avg(score) OVER (PARTITION BY sel_day) > 0 THEN round(0.5 * cume_dist() OVER (PARTITION BY sel_day ORDER BY score) * 100 + 0.5 * CASE WHEN earnings IS NULL THEN 50 ELSE cume_dist() OVER (PARTITION BY sel_day, earnings IS NULL ORDER BY earnings) * 100 END, 6)
  ELSE round(score, 6) END AS blended FROM e""")
def earnings_blend(spark, sf_dir):
    """In periods whose mean score is positive, half the share at or below a row's score and half that of its earnings, else the score."""
    _, _, score = E.base(spark, sf_dir)
    rows = score.filter("score IS NOT NULL").join(meta_of(spark, sf_dir), "ticker").withColumn("earnings", F.when(F.col("mktcap") > 0, F.round(F.col("mktcap") / 500)))
    blend = 0.5 * G.share_at_most("score", "sel_day") + 0.5 * G.share_at_most("earnings", "sel_day")
    good = F.avg("score").over(Window.partitionBy("sel_day")) > 0
    return rows.select("sel_day", "ticker", F.round(F.when(good, blend).otherwise(F.col("score")), 6).alias("blended"))


@register(E.FORWARD_SQL + """, rw AS (SELECT s.sel_day, m.market, s.score, m.mktcap FROM score s JOIN meta m USING (ticker) WHERE s.score IS NOT NULL AND m.mktcap > 0),
c AS (SELECT sel_day, coalesce(market, 'all') AS scope, round(corr(score, ln(mktcap)), 8) AS rho FROM rw GROUP BY GROUPING SETS ((sel_day), (sel_day, market)) HAVING count(*) >= 3)
SELECT scope, count(rho) AS periods, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.05), 6) AS low, round(quantile_cont(rho, 0.95), 6) AS high, coalesce(array_to_string(list(sel_day ORDER BY sel_day) FILTER (abs(rho) > 0.3), ','), '') AS failed FROM c GROUP BY scope""")
def orthogonality_report(spark, sf_dir):
    _, _, score = E.base(spark, sf_dir)
    rows = score.filter("score IS NOT NULL").join(meta_of(spark, sf_dir).filter("mktcap > 0"), "ticker")
    rho = rows.groupingSets([["sel_day"], ["sel_day", "market"]], "sel_day", "market").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("score", F.ln("mktcap")), 8).alias("rho")).filter("n >= 3")
    return G.correlation_report(rho.withColumn("scope", F.coalesce("market", F.lit("all"))), "scope", 0.3).select("scope", "periods", *rounded("mean", "low", "high"), "failed")


@register(P.PANEL_SQL + """, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close - lag(close) OVER w AS ch, close / lag(close, 20) OVER w - 1 AS m20, close / lag(close, 60) OVER w - 1 AS m60 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
f AS (SELECT *, avg(greatest(ch, 0.0)) OVER w13 AS up, avg(greatest(-ch, 0.0)) OVER w13 AS down, avg(close) OVER w19 AS mid, stddev_samp(close) OVER w19 AS sd, CASE WHEN bar >= 21 THEN stddev_samp(ret) OVER w19 ELSE 0.0 END AS vol FROM r
  WINDOW w13 AS (PARTITION BY ticker ORDER BY trade_date ROWS 13 PRECEDING), w19 AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING)),
v AS (SELECT a.ticker, a.bar, CASE WHEN count(*) >= 60 THEN (sum(CASE WHEN b.vol < a.vol THEN 1.0 WHEN b.vol = a.vol THEN 0.5 ELSE 0 END) + 0.5) / count(*) * 100 END AS pct FROM f a JOIN f b ON a.ticker = b.ticker AND b.bar BETWEEN a.bar - 251 AND a.bar GROUP BY ALL),
c AS (SELECT f.ticker, trade_date, coalesce(m20, 0) AS m20, coalesce(m60, 0) AS m60, coalesce(CASE WHEN f.bar > 14 THEN CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END END, 50) AS rsi,
  coalesce(CASE WHEN f.bar >= 20 AND sd > 0 THEN (close - (mid - 2 * sd)) / (4 * sd) END, 0.5) AS bb, coalesce(pct, 50) AS pct FROM f JOIN v ON v.ticker = f.ticker AND v.bar = f.bar)
SELECT ticker, trade_date, round((CASE WHEN m20 > 0.03 AND m60 > 0.05 THEN 0.0008 WHEN m20 > 0 AND m60 > 0 THEN 0.0004 WHEN m20 < -0.03 AND m60 < -0.05 THEN -0.0003 ELSE 0.0 END::DOUBLE + CASE WHEN rsi < 25 AND bb < 0.1 THEN 0.0010 WHEN rsi > 80 AND bb > 0.95 THEN -0.0005 ELSE 0.0 END::DOUBLE)
  * CASE WHEN pct < 30 THEN 1.3 WHEN pct > 80 THEN 0.5 ELSE 1.0 END::DOUBLE, 8) AS alpha FROM c""")
def daily_alpha(spark, sf_dir):
    return B.with_alpha(B.signal_bars(bars_of(spark, sf_dir))).select("ticker", "trade_date", F.round("alpha", 8).alias("alpha"))


@register(P.PANEL_SQL + f""", v AS (SELECT ticker, market, CASE WHEN mktcap > 0 THEN round(mktcap / 500) END AS size, length(name) AS name FROM meta),
r AS (SELECT ticker, round({_midrank_sql('size')}, 4) AS size, round({_midrank_sql('name')}, 4) AS name FROM v)
SELECT ticker, array_to_string(list_filter([CASE WHEN name IS NOT NULL THEN 'name=' || CAST(CAST(round(name * 100) AS BIGINT) AS VARCHAR) END, CASE WHEN size IS NOT NULL THEN 'size=' || CAST(CAST(round(size * 100) AS BIGINT) AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS factors FROM r""")
def factor_map(spark, sf_dir):
    """The present ranks of each instrument as a map, shown in hundredths and by name."""
    v = meta_of(spark, sf_dir).select("ticker", F.when(F.col("mktcap") > 0, F.round(F.col("mktcap") / 500)).alias("size"), F.length("name").alias("name"))
    ranks = F.create_map(*[x for c in ("name", "size") for x in (F.lit(c), F.round(midrank(F.col(c)), 4))])
    present = v.select("ticker", F.map_filter(ranks, lambda _, x: x.isNotNull()).alias("m"))
    shown = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.round(F.col("m")[k] * 100).cast("bigint").cast("string")))
    return present.select("ticker", F.array_join(shown, ",").alias("factors"))


@register("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def strict_extract(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", "props")
    return audits.strict_json(rows, "props", "k long", {"k is missing": "k IS NOT NULL", "k is negative": "k >= 0"}).select("event_id", "k")
