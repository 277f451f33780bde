"""Queries of operational analytics over events, orders, documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions.ranks import global_rank
from panelforge.operators import ops as O
from panelforge.operators import panel as P
from panelforge.plans.common import Registry, bars_of, meta_of
from panelforge.sources import sinks
from panelforge.sources.tables import read_table

register = Registry()


@register(r"""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)
SELECT page_id, length(trim(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))) AS n, md5(trim(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))) AS digest FROM t""")
def html_strip(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", S.strip_html(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _rules_sql(field: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{r[0]}') THEN '{r[field]}'" for r in O.NEWS_RULES) + " END"


@register(f"SELECT doc_id, {_rules_sql(1)} AS severity, {_rules_sql(2)} AS reason FROM documents")
def news_classify(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", O.classify(F.col("text")).alias("c")).select("doc_id", "c.severity", "c.reason")


@register(f"""WITH c AS (SELECT source, {_rules_sql(1)} AS severity FROM documents)
SELECT source, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) AS n, CASE WHEN count(*) FILTER (severity = 'critical') >= 1 THEN 'critical' WHEN count(*) FILTER (severity = 'warning') >= 5 THEN 'warning' ELSE 'ok' END AS state FROM c GROUP BY source""")
def heartbeat(spark, sf_dir):
    c = read_table(spark, sf_dir, "documents").select("source", O.classify(F.col("text"))["severity"].alias("severity"))
    critical, warning = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    return c.groupBy("source").agg(critical.alias("critical"), warning.alias("warning"), F.count(F.lit(1)).alias("n"), F.when(critical >= 1, "critical").when(warning >= 5, "warning").otherwise("ok").alias("state"))


TICKS = """WITH v AS (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS vol FROM events),
ctx AS (SELECT user_id, round(avg(value), 6) AS reference, round(avg(vol), 6) AS usual FROM v WHERE ts < TIMESTAMP '2024-01-15' AND value > 0 GROUP BY user_id),
det AS (SELECT event_id, v.user_id, ts, value, CASE WHEN reference > 0 AND value / reference - 1 >= 0.05 - 1e-9 THEN 'price_spike' WHEN reference > 0 AND value / reference - 1 <= -0.05 + 1e-9 THEN 'price_drop' WHEN usual > 0 AND vol / usual >= 3 THEN 'volume_surge' END AS trigger
  FROM v JOIN ctx USING (user_id) WHERE ts >= TIMESTAMP '2024-01-15')"""


def ticks(spark, sf_dir):
    return read_table(spark, sf_dir, "events").withColumn("vol", F.get_json_object("props", "$.k").cast("double"))


def detected(spark, sf_dir):
    t = ticks(spark, sf_dir)
    split = F.lit("2024-01-15").cast("timestamp")
    context = t.filter((F.col("ts") < split) & (F.col("value") > 0)).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("reference"), F.round(F.avg("vol"), 6).alias("usual"))
    return t.filter(F.col("ts") >= split).join(context, "user_id").withColumn("trigger", O.anomaly(F.col("value"), F.col("reference"), F.col("vol"), F.col("usual")))


@register(TICKS + " SELECT event_id, user_id, trigger FROM det WHERE trigger IS NOT NULL")
def tick_anomaly(spark, sf_dir):
    return detected(spark, sf_dir).filter("trigger IS NOT NULL").select("event_id", "user_id", "trigger")


@register(TICKS + " SELECT user_id, trigger, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, count(*) AS ticks, min(event_id) AS first_id FROM det WHERE trigger IS NOT NULL GROUP BY ALL")
def anomaly_dedup(spark, sf_dir):
    d = detected(spark, sf_dir).filter("trigger IS NOT NULL").withColumn("minute", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    return d.groupBy("user_id", "trigger", "minute").agg(F.count(F.lit(1)).alias("ticks"), F.min("event_id").alias("first_id"))


@register("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n FROM events GROUP BY ALL".replace("arg_max(value, (ts, event_id))", "arg_max(value, {'a': ts, 'b': event_id})"))
def tick_latest(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("user_id", F.window("ts", "6 hours")["start"].alias("start")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count(F.lit(1)).alias("n"))


MONTHLY = "date_trunc('month', o_orderdate)"


@register(f"""WITH m AS (SELECT CAST({MONTHLY} AS DATE) AS month, split_part(o_orderpriority, '-', 2) AS purpose, o_totalprice AS cost FROM orders),
p AS (SELECT month, purpose, round(sum(cost), 2) AS cost FROM m GROUP BY ALL)
SELECT month, purpose, cost, round(cost / sum(cost) OVER (PARTITION BY month), 6) AS share, row_number() OVER (PARTITION BY month ORDER BY cost DESC, purpose) AS place, sum(cost) OVER (PARTITION BY month) >= 2500000 AS blocked FROM p""")
def cost_monthly(spark, sf_dir):
    m = read_table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("purpose")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))
    w = Window.partitionBy("month")
    return m.select("month", "purpose", "cost", F.round(F.col("cost") / F.sum("cost").over(w), 6).alias("share"), F.row_number().over(w.orderBy(F.desc("cost"), "purpose")).alias("place"), (F.sum("cost").over(w) >= 2500000).alias("blocked"))


@register("""WITH k(pipeline) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('absent')), t AS (SELECT max(ts) AS now FROM events),
r AS (SELECT event_type AS pipeline, ts, value, event_id FROM events, t WHERE ts >= now - INTERVAL 24 HOUR)
SELECT k.pipeline, count(r.event_id) AS runs, round(CASE WHEN count(r.event_id) = 0 THEN 1.0 ELSE avg(CASE WHEN r.value >= 20 THEN 1.0 WHEN r.event_id IS NOT NULL THEN 0.0 END) END, 6) AS rate, max(r.ts) AS last_run, round(avg(r.value), 6) AS latency,
 CASE WHEN count(r.event_id) = 0 THEN 'warning' WHEN avg(CASE WHEN r.value >= 20 THEN 1.0 WHEN r.event_id IS NOT NULL THEN 0.0 END) >= 0.99 THEN 'ok' WHEN avg(CASE WHEN r.value >= 20 THEN 1.0 WHEN r.event_id IS NOT NULL THEN 0.0 END) >= 0.95 THEN 'warning' ELSE 'critical' END AS severity FROM k LEFT JOIN r USING (pipeline) GROUP BY k.pipeline""")
def pipeline_health(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    known = spark.createDataFrame([(p,) for p in ("click", "error", "purchase", "signup", "view", "absent")], "pipeline string")
    now = events.agg(F.max("ts").alias("now"))
    recent = events.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS")).withColumnRenamed("event_type", "pipeline").withColumn("ok", F.when(F.col("value") >= 20, 1.0).otherwise(0.0))
    n, rate = F.count("event_id"), F.avg("ok")
    return known.join(recent, "pipeline", "left").groupBy("pipeline").agg(
        n.alias("runs"), F.round(F.when(n == 0, 1.0).otherwise(rate), 6).alias("rate"), F.max("ts").alias("last_run"), F.round(F.avg("value"), 6).alias("latency"),
        F.when(n == 0, "warning").when(rate >= 0.99, "ok").when(rate >= 0.95, "warning").otherwise("critical").alias("severity"),
    )


@register(P.PANEL_SQL + """, c AS (SELECT coalesce(nullif(trim(sector), ''), 'unclassified') AS sector, count(*) AS n FROM meta GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, sector) AS p FROM c)
SELECT CASE WHEN p <= 5 THEN sector ELSE 'other' END AS sector, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def sector_distribution(spark, sf_dir):
    name = F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("unclassified"))
    c = meta_of(spark, sf_dir).groupBy(name.alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("p", F.row_number().over(Window.orderBy(F.desc("n"), "sector")))  # a row for each sector
    return r.groupBy(F.when(F.col("p") <= 5, F.col("sector")).otherwise("other").alias("sector")).agg(F.sum("n").alias("n"))


MONTH_RET = P.PANEL_SQL + """, mc AS (SELECT ticker, date_trunc('month', trade_date) AS month, arg_max(close, trade_date) AS close FROM panel GROUP BY ALL),
mr AS (SELECT ticker, CAST(month AS DATE) AS month, close / lag(close) OVER (PARTITION BY ticker ORDER BY month) - 1 AS r0 FROM mc), rr AS (SELECT ticker, month, greatest(-0.9, least(0.9, r0 / 20)) AS r FROM mr WHERE r0 IS NOT NULL)"""


def monthly_returns(spark, sf_dir):
    """A twentieth of each ticker's monthly price change, held inside -0.9 to 0.9: a portfolio's share of it."""
    m = bars_of(spark, sf_dir).groupBy("ticker", F.date_trunc("month", "trade_date").cast("date").alias("month")).agg(F.max_by("close", "trade_date").alias("close"))
    r = m.withColumn("r0", F.col("close") / F.lag("close", 1).over(Window.partitionBy("ticker").orderBy("month")) - 1).filter("r0 IS NOT NULL")
    return r.select("ticker", "month", S.clamp(F.col("r0") / 20, -0.9, 0.9).alias("r"))


@register(MONTH_RET + """, e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY month)) AS equity FROM rr), d AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY ticker ORDER BY month)) - 1 AS drawdown FROM e)
SELECT ticker, month, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM d""")
def drawdown_curve(spark, sf_dir):
    return O.curve(monthly_returns(spark, sf_dir), "ticker", "month").select("ticker", "month", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


@register(MONTH_RET + """, e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY month)) AS equity FROM rr), d AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY ticker ORDER BY month)) - 1 AS drawdown FROM e),
a AS (SELECT ticker, arg_max(equity, month) AS last, count(*) / 12.0 AS years, min(drawdown) AS mdd, avg(r) AS mean, stddev_samp(r) AS sigma, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM d GROUP BY ticker),
s AS (SELECT *, last - 1 AS total, pow(last, 1 / years) - 1 AS cagr, CASE WHEN sigma > 0 THEN (mean - 0.035 / 12) / sigma * sqrt(12.0) ELSE 0 END AS sharpe FROM a)
SELECT ticker, round(total, 6) AS total, round(cagr, 6) AS cagr, round(mdd, 6) AS mdd, round(sharpe, 6) AS sharpe, round(CASE WHEN mdd < 0 THEN cagr / -mdd ELSE 0 END, 6) AS calmar, round(win_rate, 6) AS win_rate,
  CASE (cagr >= 0)::INT + (sharpe >= 0.5)::INT + (mdd >= -0.15)::INT WHEN 3 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'watch' END AS verdict FROM s""")
def performance_statistics(spark, sf_dir):
    s = O.statistics(O.curve(monthly_returns(spark, sf_dir), "ticker", "month"), "ticker", "month", 12.0)
    shown = [F.round(c, 6).alias(c) for c in ("total", "cagr", "mdd", "sharpe", "calmar", "win_rate")]
    return s.select("ticker", *shown, O.decision(F.col("cagr"), F.col("sharpe"), F.col("mdd")).alias("verdict"))


@register(MONTH_RET + """, i AS (SELECT *, r > 0 AS up, sum(CASE WHEN r > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY month) AS island FROM rr)
SELECT ticker, month, CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, island ORDER BY month) AS BIGINT) AS streak FROM i""")
def cap_streak(spark, sf_dir):
    rows = monthly_returns(spark, sf_dir).withColumn("up", F.col("r") > 0)
    return O.run_lengths(rows, "ticker", "month", "up").select("ticker", "month", "streak")


@register("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS admins, min(event_type) AS admin FROM events GROUP BY ALL),
f AS (SELECT *, admins = 1 AND coalesce(admin = lag(admin) OVER w AND day = lag(day) OVER w + 1, false) AS same FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS island FROM f)
SELECT user_id, day, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY day) AS BIGINT) AS streak FROM i""")
def admin_streak(spark, sf_dir):
    return one_admin_streaks(read_table(spark, sf_dir, "events"), "user_id", F.col("event_type"))


def one_admin_streaks(events, series, admin):
    d = events.groupBy(series, F.to_date("ts").alias("day")).agg(F.count_distinct(admin).alias("admins"), F.min(admin).alias("admin"))
    w = Window.partitionBy(series).orderBy("day")
    same = (F.col("admins") == 1) & F.coalesce((F.col("admin") == F.lag("admin", 1).over(w)) & (F.col("day") == F.date_add(F.lag("day", 1).over(w), 1)), F.lit(False))
    return O.run_lengths(d.withColumn("same", same), series, "day", "same").select(series, "day", "streak")


@register("""WITH p(prefix, label) AS (VALUES ('1', 'a'), ('12', 'b'), ('123', 'c'), ('4', 'd'), ('77', 'e')), c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS code FROM customer),
m AS (SELECT code, label, prefix, row_number() OVER (PARTITION BY code ORDER BY length(prefix) DESC) AS r FROM c JOIN p ON starts_with(code, prefix))
SELECT c.code, m.label, m.prefix FROM c LEFT JOIN m ON m.code = c.code AND r = 1""")
def prefix_sector(spark, sf_dir):
    prefixes = spark.createDataFrame([("1", "a"), ("12", "b"), ("123", "c"), ("4", "d"), ("77", "e")], "prefix string, label string")
    return O.longest_prefix(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code")).distinct(), prefixes, 3)


@register("""SELECT e.event_id, p.value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'purchase'""")
def asof_price(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    return O.as_of(bought, views, "user_id", "at", "ts", "value").select("event_id", "value")


@register("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, arg_max(p.value, p.ts) AS value FROM events e LEFT JOIN p ON e.user_id = p.user_id AND p.ts <= e.ts AND p.ts >= e.ts - INTERVAL 1 DAY WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def walk_back_price(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    return O.as_of(bought, views, "user_id", "at", "ts", "value", within="1 DAY").select("event_id", "value")


CARRY = "WITH t AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS month, o_custkey AS ticker, CASE o_custkey % 2 WHEN 0 THEN 'short' ELSE 'long' END AS bucket FROM orders)"


@register(CARRY + """, b AS (SELECT max(month) AS month FROM t WHERE month < TIMESTAMP '2001-07-01' AND bucket = 'short') SELECT DATE '2001-07-01' AS month, ticker, bucket FROM t JOIN b USING (month) WHERE bucket = 'short' AND ticker NOT IN (SELECT ticker FROM t WHERE month = TIMESTAMP '2001-07-01')""")
def carry_forward(spark, sf_dir):
    return carried(read_table(spark, sf_dir, "orders"))


def carried(orders):
    t = orders.select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_custkey").alias("ticker"), F.when(F.col("o_custkey") % 2 == 0, "short").otherwise("long").alias("bucket")).distinct()
    return sinks.carry_forward(t, "2001-07-01", "short")


@register("""WITH base AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), over_ AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, v, 'base' AS origin FROM base WHERE k NOT IN (SELECT k FROM over_) UNION ALL SELECT k, v, 'overlay' AS origin FROM over_""")
def upsert_overlay(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    base = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("origin", F.lit("base"))
    over = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v")).withColumn("origin", F.lit("overlay"))
    return sinks.upsert(base, over, "k")


@register("""SELECT c_mktsegment, q, k FROM (SELECT DISTINCT c_mktsegment FROM customer), (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) a(q), range(1995, 2002) b(k)
EXCEPT SELECT c_mktsegment, 'Q' || quarter(o_orderdate), year(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000""")
def backfill_required(spark, sf_dir):
    done = read_table(spark, sf_dir, "orders").filter("o_totalprice > 400000").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = done.select("c_mktsegment", F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("q"), F.year("o_orderdate").cast("long").alias("k"))
    periods = F.explode(F.array(*[F.struct(F.lit(f"Q{q}").alias("q"), F.lit(k).cast("long").alias("k")) for q in range(1, 5) for k in range(1995, 2002)]))
    needed = read_table(spark, sf_dir, "customer").select("c_mktsegment").distinct().select("c_mktsegment", periods.alias("p")).select("c_mktsegment", "p.q", "p.k")
    return needed.join(done, ["c_mktsegment", "q", "k"], "left_anti")


@register("""SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS user_turns, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS assistant_turns, count(*) AS n, CASE WHEN count(*) FILTER (role = 'user') >= count(*) // 2 + 1 THEN 'user' WHEN count(*) FILTER (role = 'assistant') >= count(*) // 2 + 1 THEN 'assistant' ELSE 'split' END AS majority, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id""")
def majority_vote(spark, sf_dir):
    user, other, n = F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant"), F.count(F.lit(1))
    half = F.floor(n / 2) + 1
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        user.alias("user_turns"), other.alias("assistant_turns"), n.alias("n"), F.when(user >= half, "user").when(other >= half, "assistant").otherwise("split").alias("majority"), F.min_by("role", "turn").alias("first_role")
    )


@register("""WITH v AS (SELECT user_id AS ticker, event_type AS persona, CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'signup' THEN 1.5 ELSE 1.0 END AS w, least(100.0, greatest(0.0, value)) AS score FROM events),
p AS (SELECT ticker, round(sum(w * score) / sum(w), 6) AS weighted, round(stddev_pop(score), 6) AS spread FROM v GROUP BY ticker), r AS (SELECT *, row_number() OVER (ORDER BY weighted DESC, ticker) AS place, row_number() OVER (ORDER BY spread DESC, ticker) <= ceil(0.2 * count(*) OVER ()) AS varied FROM p)
SELECT ticker, weighted, spread, place, place BETWEEN 6 AND 15 OR varied AS debate FROM r""")
def weighted_panel(spark, sf_dir):
    v = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.when(F.col("event_type").isin("purchase", "signup"), 1.5).otherwise(1.0).alias("w"), S.clamp(F.col("value"), 0, 100).alias("score"))
    p = v.groupBy("ticker").agg(F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6).alias("weighted"), F.round(F.stddev_pop("score"), 6).alias("spread"))
    r = global_rank(global_rank(p, "place", F.desc("weighted"), "ticker"), "nth", F.desc("spread"), "ticker")
    r = r.withColumn("varied", F.col("nth") <= F.ceil(F.lit(0.2) * F.col("n")))
    return r.select("ticker", "weighted", "spread", "place", (F.col("place").between(6, 15) | F.col("varied")).alias("debate"))


BOARD = [(m, f, round(((m * 7 + i * 3) % 5 + 1) / 10, 1)) for m in range(10) for i, f in enumerate(("close", "volume", "trdval"))]


@register(P.PANEL_SQL + f""", lst AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1), z AS (SELECT ticker, {', '.join(f'round((coalesce({c}, 0) - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 8) AS {c}' for c in ('close', 'volume', 'trdval'))} FROM lst),
u AS (SELECT ticker, unnest(['close', 'volume', 'trdval']) AS factor, unnest([close, volume, trdval]) AS value FROM z), b(member, factor, weight) AS (VALUES {', '.join(map(str, BOARD))}),
s AS (SELECT member, ticker, round(sum(weight * value), 8) AS score FROM u JOIN b USING (factor) GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY score DESC, ticker) AS r FROM s),
c AS (SELECT ticker, count(*) FILTER (r <= 10) AS votes, round(avg(score), 6) AS mean FROM v GROUP BY ticker) SELECT ticker, votes, mean FROM c WHERE votes >= 7""")
def board_vote(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    last = bars.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("trade_date")))).filter("n = 1")
    names = ("close", "volume", "trdval")
    whole = last.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("sigma", F.stddev_samp))])
    z = last.join(F.broadcast(whole)).select("ticker", *[F.round((F.col(c) - F.col(f"mean_{c}")) / F.col(f"sigma_{c}"), 8).alias(c) for c in names])  # a single row
    board = spark.createDataFrame(BOARD, "member int, factor string, weight double")
    return O.board_vote(z.unpivot("ticker", list(names), "factor", "value"), board, 10, 0.7)


@register("""WITH s AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS n, lead(v) OVER (PARTITION BY series ORDER BY day DESC) AS before FROM s),
x AS (SELECT series, day, v, round(v - before, 6) AS change, CASE WHEN v > before * 1.02 THEN 1 WHEN v < before * 0.98 THEN -1 ELSE 0 END AS signal, CASE WHEN series IN ('error', 'view') THEN 'traffic' ELSE 'sales' END AS category FROM r WHERE n = 1)
SELECT x.series, x.day, x.v, x.change, x.signal, round(50 + 50 * (SELECT avg(m) FROM (SELECT avg(signal) AS m FROM x GROUP BY category)), 6) AS verdict FROM x""")
def macro_verdict(spark, sf_dir):
    s = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    w = Window.partitionBy("series").orderBy(F.desc("day"))
    x = s.withColumn("n", F.row_number().over(w)).withColumn("before", F.lead("v", 1).over(w)).filter("n = 1")
    x = x.withColumn("signal", F.when(F.col("v") > F.col("before") * 1.02, 1).when(F.col("v") < F.col("before") * 0.98, -1).otherwise(0)).withColumn("category", F.when(F.col("series").isin("error", "view"), "traffic").otherwise("sales"))
    verdict = x.groupBy("category").agg(F.avg("signal").alias("m")).agg(F.round(50 + 50 * F.avg("m"), 6).alias("verdict"))
    return x.join(F.broadcast(verdict)).select("series", "day", "v", F.round(F.col("v") - F.col("before"), 6).alias("change"), "signal", "verdict")  # a single row


@register("""WITH q AS (SELECT c_nationkey AS corp, year(o_orderdate) AS y, quarter(o_orderdate) AS q, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT *, round(sum(revenue) OVER (PARTITION BY corp, y ORDER BY q), 2) AS cumulative FROM q), s AS (SELECT *, round(cumulative - coalesce(lag(cumulative) OVER (PARTITION BY corp, y ORDER BY q), 0), 2) AS standalone FROM c)
SELECT a.corp, a.y, a.q, a.standalone, round((a.standalone - b.standalone) / abs(nullif(b.standalone, 0)), 6) AS yoy FROM s a LEFT JOIN s b ON a.corp = b.corp AND a.y = b.y + 1 AND a.q = b.q""")
def quarter_standalone_yoy(spark, sf_dir):
    q = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = q.groupBy(F.col("c_nationkey").alias("corp"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    w = Window.partitionBy("corp", "y").orderBy("q")
    s = q.withColumn("cumulative", F.round(F.sum("revenue").over(w), 2)).withColumn("standalone", F.round(F.col("cumulative") - F.coalesce(F.lag("cumulative", 1).over(w), F.lit(0)), 2))
    prior = s.select("corp", (F.col("y") + 1).alias("y"), "q", F.col("standalone").alias("prior"))
    yoy = (F.col("standalone") - F.col("prior")) / F.abs(F.nullif("prior", F.lit(0.0)))
    return s.join(prior, ["corp", "y", "q"], "left").select("corp", "y", "q", "standalone", F.round(yoy, 6).alias("yoy"))


@register("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, CAST(date_trunc('month', d - INTERVAL 1 MONTH) AS DATE) AS previous_month, isodow(d) <= 5 AS business, strftime(d, '%G-W%V') AS week_key, strftime(d, '%Y-%m') AS month_key,
 CASE WHEN strftime(d, '%m%d') >= '1216' THEN year(d) || 'Q3' WHEN strftime(d, '%m%d') >= '0916' THEN year(d) || 'Q2' WHEN strftime(d, '%m%d') >= '0616' THEN year(d) || 'Q1' WHEN strftime(d, '%m%d') >= '0502' THEN (year(d) - 1) || 'Q4' ELSE (year(d) - 1) || 'Q3' END AS target_quarter FROM d""")
def calendar_keys(spark, sf_dir):
    d = read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    md, y = F.date_format("d", "MMdd"), F.year("d")
    quarter = F.when(md >= "1216", F.concat(y, F.lit("Q3"))).when(md >= "0916", F.concat(y, F.lit("Q2"))).when(md >= "0616", F.concat(y, F.lit("Q1"))).when(md >= "0502", F.concat(y - 1, F.lit("Q4"))).otherwise(F.concat(y - 1, F.lit("Q3")))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "d"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return d.select("d", F.trunc(F.add_months("d", -1), "month").alias("previous_month"), (F.weekday("d") < 5).alias("business"), week.alias("week_key"), F.date_format("d", "yyyy-MM").alias("month_key"), quarter.alias("target_quarter"))


@register("""WITH h AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS bucket, o_totalprice AS entry, round(o_totalprice * (0.8 + (o_orderkey % 50) / 100.0), 4) AS price, round(o_totalprice * 1.1, 4) AS peak, round(o_totalprice * 1.25, 4) AS target, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS held FROM orders)
SELECT o_orderkey, CASE WHEN price >= target THEN 'target' WHEN price <= entry * (1 - 0.15) THEN 'stop' WHEN peak > entry AND price <= peak * (1 - 0.12) THEN 'trailing' WHEN held >= CASE bucket WHEN 'short' THEN 30 WHEN 'mid' THEN 90 ELSE 365 END THEN 'time' END AS signal FROM h""")
def exit_signals(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    bucket = F.when(F.col("o_custkey") % 3 == 0, "short").when(F.col("o_custkey") % 3 == 1, "mid").otherwise("long")
    price = F.round(F.col("o_totalprice") * (F.lit(0.8) + (F.col("o_orderkey") % 50) / 100.0), 4)
    signal = O.exit_signal(bucket, F.col("o_totalprice"), price, F.round(F.col("o_totalprice") * 1.1, 4), F.round(F.col("o_totalprice") * 1.25, 4), F.date_diff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")))
    return o.select("o_orderkey", signal.alias("signal"))


@register("""WITH a AS (SELECT '(' || c_acctbal || ')' AS t, c_custkey AS k, c_acctbal AS v FROM customer) SELECT k, round(-abs(v), 2) AS amount, round(v, 2) AS plain, 0.0 AS bad FROM a""")
def numeric_parse(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").filter("c_custkey IS NOT NULL")
    shown = F.concat(F.lit("("), F.format_number(F.abs("c_acctbal"), 2), F.lit(")"))
    return c.select(F.col("c_custkey").alias("k"), F.round(S.parse_amount(shown), 2).alias("amount"), F.round(S.parse_number(F.format_number("c_acctbal", 2)), 2).alias("plain"), S.parse_number(F.lit("N/A")).alias("bad"))


@register("""SELECT coalesce(a.u, b.u) AS user_id, a.u IS NOT NULL AS before, b.u IS NOT NULL AS after FROM (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-10') a FULL JOIN (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-20') b ON a.u = b.u""")
def survivorship_sets(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").filter("event_type = 'signup'")
    old = e.filter("ts < '2024-01-10'").select("user_id").distinct().withColumn("b", F.lit(True))
    new = e.filter("ts >= '2024-01-20'").select("user_id").distinct().withColumn("a", F.lit(True))
    return old.join(new, "user_id", "full").select("user_id", F.col("b").isNotNull().alias("before"), F.col("a").isNotNull().alias("after"))


@register("""WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, source, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM x WHERE r <= 20 WINDOW w AS (PARTITION BY source ORDER BY r)""")
def bucket_neighbours(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    x = read_table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 20")
    n = Window.partitionBy("source").orderBy("r")
    return x.select("doc_id", "source", F.lag("doc_id", 1).over(n).alias("previous"), F.lead("doc_id", 1).over(n).alias("next"))


@register("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS purchases, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.sum("value"), 4).alias("total"))
