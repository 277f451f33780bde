"""Queries of scoring and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle
from panelforge.operators import features as X
from panelforge.operators import panel as P
from panelforge.operators import scoring as G
from panelforge.operators import selection as T
from panelforge.plans import factor_queries as Q
from panelforge.plans.common import SELECTION, Registry, bars_of, meta_of
from panelforge.sources.tables import read_table

register = Registry()
QUOTA = {"large": 4, "mid": 4, "small": 2}
FLOOR = 60000.0


def stocks_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-section that scoring reads. Earnings is the growth of traded value over half a year, quality the
    distance of the close from its yearly mean; instruments without a positive value have no data of either."""
    rows = Q.at_selection(spark, sf_dir, lambda _, asked: X.halves(asked), ("earnings", "quality"))
    rows = rows.join(meta_of(spark, sf_dir), "ticker").withColumn("sel", F.lit(SELECTION).cast("date"))
    failed = F.col("mktcap") <= 0
    for c in ("earnings", "quality"):
        rows = rows.withColumn(c, F.when(~failed, F.col(c))).withColumn(f"{c}_failed", failed)
    return rows.withColumn("flow_failed", F.lit(False))


RANK = Q._midrank_sql


def _wins(raw: str) -> str:
    """A CTE expression: the winsorized value over all rows, rounded."""
    return f"round(CASE WHEN ({raw}) IS NOT NULL THEN CASE WHEN count({raw}) OVER () >= 2 THEN greatest(quantile_cont({raw}, 0.01) OVER (), least(quantile_cont({raw}, 0.99) OVER (), {raw})) ELSE {raw} END END, 10)"


def _mean_sql(*cols: str) -> str:
    return f"({' + '.join(f'coalesce({c}, 0.0::DOUBLE)' for c in cols)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}, 0)"


STOCKS_SQL = Q.FACTOR_SQL.replace(f"\nl AS ({Q.LAST})", f"""
e AS (SELECT f.*, CASE WHEN bar >= 52 THEN sum(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 25 PRECEDING) / sum(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 51 PRECEDING AND 26 PRECEDING) - 1 END AS earnings0,
  CASE WHEN bar >= 52 THEN close / avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 51 PRECEDING) - 1 END AS quality0 FROM f),
l AS ({Q.LAST.replace('FROM f', 'FROM e')}),
stocks AS (SELECT l.*, m.sector, m.mktcap, m.mktcap <= 0 AS failed, CASE WHEN m.mktcap > 0 THEN earnings0 END AS earnings, CASE WHEN m.mktcap > 0 THEN quality0 END AS quality, coalesce(adv60 >= {FLOOR}, false) AS liquid FROM l JOIN meta m USING (ticker))""")


def scores_sql(bucket: str, issuance: bool = False) -> str:
    """CTEs that end in s_<bucket>(ticker, sector, sleeve, score, ranks ...)."""
    b = bucket
    trends = [f"trend_{b}_0", f"trend_{b}_1"] + (["high_prox"] if b == "long" else [])
    n = range(len(trends))
    bonus = "0.0" if b == "long" else "CASE WHEN rank_trend >= 50 THEN coalesce(greatest(0.0, least(10.0, (rank_volume - 50) / 50 * 10)), 0.0) ELSE 0.0 END"
    parts = ["rank_trend", "rank_flow", "rank_earnings", "rank_quality"] + (["rank_issuance"] if issuance else [])
    return f"""
w_{b} AS (SELECT *, {', '.join(f'CASE WHEN liquid THEN {c} END AS t{i}' for i, c in enumerate(trends))} FROM stocks),
x_{b} AS (SELECT *, {', '.join(f'{_wins(f"t{i}")} AS v{i}' for i in n)} FROM w_{b}),
r_{b} AS (SELECT *, {', '.join(f'{RANK(f"v{i}")} AS r{i}' for i in n)} FROM x_{b}),
t_{b} AS (SELECT *, {_mean_sql(*(f'r{i}' for i in n))} AS rank_trend FROM r_{b}),
g_{b} AS (SELECT *, liquid AND trend_{b}_1 IS NOT NULL AND rank_trend IS NOT NULL AS eligible FROM t_{b}),
m_{b} AS (SELECT *, quantile_cont(CASE WHEN eligible AND mktcap > 0 THEN mktcap END, 0.8) OVER () AS hi, quantile_cont(CASE WHEN eligible AND mktcap > 0 THEN mktcap END, 0.4) OVER () AS lo,
  CASE WHEN eligible AND adv60 > 0 THEN sign(flow60 / adv60) * ln(1 + abs(flow60 / adv60)) END AS m0, CASE WHEN eligible THEN sign(flow60) * ln(1 + abs(flow60)) END AS m1,
  CASE WHEN eligible THEN surge END AS m2, CASE WHEN eligible AND mktcap > 0 THEN adv60 / mktcap END AS m3, CASE WHEN eligible THEN net_issuance END AS m4,
  round(CASE WHEN eligible THEN earnings END, 10) AS e0, round(CASE WHEN eligible THEN quality END, 10) AS q0 FROM g_{b}),
y_{b} AS (SELECT *, {', '.join(f'{_wins(f"m{i}")} AS z{i}' for i in range(5))}, CASE WHEN eligible THEN CASE WHEN mktcap >= hi THEN 'large' WHEN mktcap >= lo THEN 'mid' ELSE 'small' END ELSE 'small' END AS sleeve FROM m_{b}),
k_{b} AS (SELECT *, {', '.join(f'{RANK(f"z{i}")} AS k{i}' for i in range(5))}, {RANK('e0', 'sector')} AS ke, {RANK('q0', 'sector')} AS kq FROM y_{b}),
o_{b} AS (SELECT *, coalesce(CASE WHEN sleeve IN ('large', 'mid') THEN {_mean_sql('k0', 'k1')} ELSE k0 END, 50) AS rank_flow,
  coalesce(ke, CASE WHEN failed THEN 5 ELSE 50 END) AS rank_earnings, coalesce(kq, CASE WHEN failed THEN 5 ELSE 50 END) AS rank_quality, k2 AS rank_volume, coalesce(k4, 50) AS rank_issuance,
  CASE WHEN k3 >= 99 THEN 5.0 ELSE 0.0 END + CASE WHEN ret5 > 0.25 THEN least(20.0, (ret5 - 0.25) * 40) ELSE 0.0 END AS penalty FROM k_{b}),
s_{b} AS (SELECT *, {bonus} AS bonus, CASE WHEN eligible THEN round({_mean_sql(*parts)} + {bonus} - penalty, 8) END AS score FROM o_{b})"""


def pick_sql(bucket: str, used: list[str], source: str | None = None, key: str = "score") -> str:
    """CTEs that end in p_<bucket>(ticker, score, sleeve, rank): quotas by sleeve, then the best leftovers."""
    b, src = bucket, source or f"s_{bucket}"
    quota = " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTA.items())
    anti = "".join(f" AND ticker NOT IN (SELECT ticker FROM p_{u})" for u in used)
    return f"""
a_{b} AS (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY {key} DESC, ticker) <= CASE sleeve {quota} ELSE 0 END AS taken FROM {src} WHERE {key} IS NOT NULL{anti}),
d_{b} AS (SELECT *, {sum(QUOTA.values())} - sum(taken::INT) OVER () AS short, row_number() OVER (PARTITION BY taken ORDER BY {key} DESC, ticker) AS l FROM a_{b}),
p_{b} AS (SELECT *, row_number() OVER (ORDER BY {key} DESC, ticker) AS rank FROM d_{b} WHERE taken OR l <= short)"""


@register(STOCKS_SQL + "," + scores_sql("short") + "," + pick_sql("short", []) + " SELECT ticker, sleeve, round(score, 6) AS score, rank FROM p_short")
def bpp_short_topk(spark, sf_dir):
    scored = G.bpp_scores(stocks_at(spark, sf_dir), "short", FLOOR)
    return T.select_sleeves(scored, QUOTA, "sel").select("ticker", "sleeve", F.round("score", 6).alias("score"), "rank")


SHOWN = "rank_trend", "rank_flow", "rank_earnings", "rank_quality", "rank_issuance", "bonus", "penalty", "score"


@register(STOCKS_SQL + "," + scores_sql("mid", True) + f" SELECT ticker, sleeve, eligible, {', '.join(f'CASE WHEN eligible THEN round({c}, 6) END AS {c}' for c in SHOWN)} FROM s_mid")
def bpp_score(spark, sf_dir):
    scored = G.bpp_scores(stocks_at(spark, sf_dir), "mid", FLOOR, with_issuance=True)
    return scored.select("ticker", "sleeve", "eligible", *[F.when(F.col("eligible"), F.round(c, 6)).alias(c) for c in SHOWN])


THREE_SQL = STOCKS_SQL + "," + ",".join(scores_sql(b) for b in T.BUCKETS)


def three_scored(spark, sf_dir) -> dict[str, DataFrame]:
    # A row for each instrument, used for each bucket and each exclusion.
    stocks = settle(stocks_at(spark, sf_dir))
    return {b: settle(G.bpp_scores(stocks, b, FLOOR)) for b in T.BUCKETS}


@register(THREE_SQL + "," + ",".join(pick_sql(b, list(T.BUCKETS[:i])) for i, b in enumerate(T.BUCKETS)) + " " + " UNION ALL ".join(f"SELECT '{b}' AS bucket, ticker, sleeve, round(score, 6) AS score, rank FROM p_{b}" for b in T.BUCKETS))
def bpp_three_bucket(spark, sf_dir):
    return T.disjoint_buckets(three_scored(spark, sf_dir), QUOTA, "sel").select("bucket", "ticker", "sleeve", F.round("score", 6).alias("score"), "rank")


LEADERS = "row_number() OVER (ORDER BY momentum DESC, sector) <= greatest(1, ceil(0.3 * count(*) OVER ()))"
TILT_SQL = STOCKS_SQL + f""", sm AS (SELECT *, lag(close, 21) OVER w / lag(close, 147) OVER w - 1 AS m FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
sl AS (SELECT * FROM sm WHERE trade_date < DATE '{SELECTION}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1),
ss AS (SELECT sector, round(avg(m), 8) AS momentum FROM sl JOIN meta USING (ticker) WHERE m IS NOT NULL GROUP BY sector HAVING count(*) >= 3),
lead AS (SELECT sector FROM ss QUALIFY {LEADERS}),""" + scores_sql("short") + ", tilted AS (SELECT *, score + CASE WHEN sector IN (SELECT sector FROM lead) THEN 8 ELSE 0 END AS tilt FROM s_short)," + pick_sql("short", [], "tilted", "tilt")


@register(TILT_SQL + " SELECT ticker, sleeve, round(score, 6) AS score, rank FROM p_short")
def cfg5_sector_tilt(spark, sf_dir):
    leading = X.sector_momentum(bars_of(spark, sf_dir), meta_of(spark, sf_dir), SELECTION).filter("leading").select("sector", F.lit(8.0).alias("bump"))
    scored = G.bpp_scores(stocks_at(spark, sf_dir), "short", FLOOR).join(leading, "sector", "left").withColumn("plain", F.col("score"))
    picked = T.select_sleeves(scored.withColumn("score", F.col("score") + F.coalesce("bump", F.lit(0.0))), QUOTA, "sel")
    return picked.select("ticker", "sleeve", F.round("plain", 6).alias("score"), "rank")


UNION_SQL = STOCKS_SQL + "," + scores_sql("short") + ", hit AS (" + " UNION ".join(
    f"SELECT ticker FROM (SELECT ticker, row_number() OVER (PARTITION BY sleeve ORDER BY {k} DESC NULLS LAST, score DESC, ticker) AS r FROM s_short WHERE score IS NOT NULL AND {k} IS NOT NULL) WHERE r <= 5" for k in ("rank_trend", "rank_flow", "rank_volume")
) + "), u AS (SELECT * FROM s_short WHERE ticker IN (SELECT ticker FROM hit))"


@register(UNION_SQL + "," + pick_sql("short", [], "u") + " SELECT ticker, sleeve, round(score, 6) AS score, rank FROM p_short")
def cfg6_union(spark, sf_dir):
    scored = settle(G.bpp_scores(stocks_at(spark, sf_dir), "short", FLOOR))
    return T.select_sleeves(T.screens_union(scored, ["rank_trend", "rank_flow", "rank_volume"], 5, "sel"), QUOTA, "sel").select("ticker", "sleeve", F.round("score", 6).alias("score"), "rank")


@register(STOCKS_SQL + "," + scores_sql("short") + ", v AS (SELECT *, round(rank_volume, 8) AS surge_rank, round(CASE WHEN eligible THEN adv60 END, 6) AS adv_key FROM s_short)," + pick_sql("short", [], "v", "surge_rank") + "," + pick_sql("mid", [], "v", "adv_key")
          + " SELECT 'surge' AS leg, ticker, sleeve, rank FROM p_short UNION ALL SELECT 'volume' AS leg, ticker, sleeve, rank FROM p_mid")
def cfg7_surge(spark, sf_dir):
    scored = settle(G.bpp_scores(stocks_at(spark, sf_dir), "short", FLOOR))
    surge = T.select_sleeves(scored.withColumn("score", F.round("rank_volume", 8)), QUOTA, "sel").select(F.lit("surge").alias("leg"), "ticker", "sleeve", "rank")
    volume = T.select_sleeves(scored.withColumn("score", F.when(F.col("eligible"), F.round("adv60", 6))), QUOTA, "sel").select(F.lit("volume").alias("leg"), "ticker", "sleeve", "rank")
    return surge.unionByName(volume)


def _z(c: str, inverted: bool = False) -> str:
    z = f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1e-9 ELSE stddev_pop({c}) OVER () END"
    return f"greatest(0.0, least(100.0, ({'-' if inverted else ''}({z}) + 3) / 6 * 100))"


def _legacy_sql(b: str) -> str:
    w = G.LEGACY_WEIGHTS[b]
    parts = {k: f"round({v} * {k}, 8)" for k, v in w.items()}
    label = " ".join(f"WHEN {p} = greatest({', '.join(parts.values())}) THEN '{k}'" for k, p in parts.items())
    return f"SELECT '{b}' AS bucket, ticker, mktcap, round({' + '.join(f'{v} * {k}' for k, v in w.items())}, 8) AS score, CASE {label} END AS label FROM n"


LEGACY_SQL = Q.LEGACY_SQL + f""", n AS (SELECT ticker, mktcap, {_z('trend_ma')} AS trend, {_z('vol_ratio')} AS volume, {_z('flow60')} AS flow, {_z('sigma59', True)} AS volatility FROM l JOIN meta USING (ticker)),
z AS ({' UNION ALL '.join(map(_legacy_sql, T.BUCKETS))})"""


@register(LEGACY_SQL + "," + ",".join(f"b_{b} AS (SELECT *, row_number() OVER (ORDER BY score DESC, mktcap DESC, ticker) AS rank FROM z WHERE bucket = '{b}'{''.join(f' AND ticker NOT IN (SELECT ticker FROM b_{u})' for u in T.BUCKETS[:i])} QUALIFY rank <= 10)" for i, b in enumerate(T.BUCKETS))
          + " " + " UNION ALL ".join(f"SELECT bucket, ticker, round(score, 6) AS score, label, rank FROM b_{b}" for b in T.BUCKETS))
def legacy_bucket_topk(spark, sf_dir):
    rows = Q.legacy_at_selection(spark, sf_dir).join(meta_of(spark, sf_dir), "ticker").withColumn("sel", F.lit(SELECTION))
    picked = T.disjoint_top(G.legacy_scores(rows), 10, [F.desc("score"), F.desc("mktcap"), F.asc("ticker")], "sel")
    return picked.select("bucket", "ticker", F.round("score", 6).alias("score"), "label", "rank")


@register(STOCKS_SQL + "," + scores_sql("short") + "," + scores_sql("mid") + "," + pick_sql("short", []) + """,
pool AS (SELECT ticker, score FROM s_mid WHERE score IS NOT NULL AND ticker NOT IN (SELECT ticker FROM p_short) QUALIFY row_number() OVER (ORDER BY score DESC, ticker) <= 3),
n AS (SELECT count(*) AS n FROM pool), worst AS (SELECT ticker, row_number() OVER (ORDER BY score, ticker DESC) AS p FROM p_short)
SELECT ticker, round(score, 6) AS score, 'kept' AS origin FROM p_short WHERE ticker NOT IN (SELECT ticker FROM worst, n WHERE p <= n)
UNION ALL SELECT ticker, round(score, 6) AS score, 'reserve' AS origin FROM pool""")
def reserve_arm(spark, sf_dir):
    scored = three_scored(spark, sf_dir)
    picked = T.select_sleeves(scored["short"], QUOTA, "sel").select("sel", "ticker", "score")
    pool = scored["mid"].filter("score IS NOT NULL").select("sel", "ticker", "score")
    return T.reserve_swap(picked, pool, 3, "sel").select("ticker", F.round("score", 6).alias("score"), "origin")


@register(THREE_SQL + """, fj AS (SELECT ticker, a.score AS short, b.score AS mid, c.score AS long FROM s_short a JOIN s_mid b USING (ticker) JOIN s_long c USING (ticker) WHERE a.score IS NOT NULL AND b.score IS NOT NULL AND c.score IS NOT NULL),
fv AS (SELECT ticker, CASE WHEN short >= mid AND short >= long THEN 'short' WHEN mid >= long THEN 'mid' ELSE 'long' END AS bucket, greatest(short, mid, long) AS score FROM fj),
fo AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ticker) AS r FROM fv), fn AS (SELECT 24 - count(*) AS missing FROM fo WHERE r <= 8),
fb AS (SELECT *, row_number() OVER (ORDER BY score DESC, ticker) AS l FROM fo WHERE r > 8)
SELECT ticker, bucket, round(score, 6) AS score, false AS filled FROM fo WHERE r <= 8 UNION ALL SELECT ticker, bucket, round(score, 6) AS score, true AS filled FROM fb, fn WHERE l <= missing""")
def favourite_bucket_fill(spark, sf_dir):
    rows = None
    for b, df in three_scored(spark, sf_dir).items():
        one = df.filter("score IS NOT NULL").select("sel", "ticker", F.col("score").alias(b))
        rows = one if rows is None else rows.join(one, ["sel", "ticker"])
    return T.backfilled_by_favourite(rows, 8, "sel").select("ticker", "bucket", F.round("score", 6).alias("score"), "filled")


@register(THREE_SQL + "," + ",".join(pick_sql(b, list(T.BUCKETS[:i])) for i, b in enumerate(T.BUCKETS)) + """,
a AS (SELECT 'short' AS bucket, ticker FROM p_short UNION ALL SELECT 'mid', ticker FROM p_mid UNION ALL SELECT 'long', ticker FROM p_long)
SELECT bucket, count(*) AS n, count(DISTINCT sector) AS sectors, sha256(string_agg(CAST(a.ticker AS VARCHAR) || chr(10), '' ORDER BY CAST(a.ticker AS VARCHAR))) AS universe_hash FROM a JOIN meta USING (ticker) GROUP BY bucket""")
def selection_composition(spark, sf_dir):
    picked = T.disjoint_buckets(three_scored(spark, sf_dir), QUOTA, "sel")
    joined = F.concat_ws("", F.transform(F.sort_array(F.collect_set(F.col("ticker").cast("string"))), lambda t: F.concat(t, F.lit("\n"))))
    return picked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sector").alias("sectors"), F.sha2(joined, 256).alias("universe_hash"))


@register(P.PANEL_SQL + """ SELECT sector, ticker, mktcap, r FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY mktcap DESC, ticker) AS r FROM meta) WHERE r BETWEEN 2 AND 3""")
def nlargest_slices(spark, sf_dir):
    w = Window.partitionBy("sector").orderBy(F.desc("mktcap"), "ticker")
    return meta_of(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r BETWEEN 2 AND 3").select("sector", "ticker", "mktcap", "r")


@register("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def paged_read(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey", "c_name", "c_acctbal")


@register("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'purchase') WHERE r <= 3")
def top_n_per_key(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return read_table(spark, sf_dir, "events").filter("event_type = 'purchase'").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id", "value")


@register("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT date_trunc('month', max(o_orderdate)) FROM orders) GROUP BY 1")
def latest_partition(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    last = orders.agg(F.date_trunc("month", F.max("o_orderdate")).alias("month"))
    rows = orders.join(F.broadcast(last), F.date_trunc("month", "o_orderdate") == F.col("month"))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
