"""Queries of gates, verdicts and small rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.ranks import global_rank
from panelforge.operators import rules as R
from panelforge.plans.common import Registry, meta_of
from panelforge.operators.panel import PANEL_SQL
from panelforge.sources.tables import read_table

register = Registry()

SEGMENTS = "SELECT c_mktsegment AS arm, count(*) AS n, round(avg(c_acctbal), 6) AS lift, round(quantile_cont(c_acctbal, 0.05), 6) AS low, round(quantile_cont(c_acctbal, 0.95), 6) AS high FROM customer GROUP BY 1"


def segments(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("lift"), F.round(F.percentile("c_acctbal", 0.05), 6).alias("low"), F.round(F.percentile("c_acctbal", 0.95), 6).alias("high")
    )


@register(f"WITH s AS ({SEGMENTS}) SELECT arm, coalesce(array_to_string(list_filter([CASE WHEN NOT coalesce(n >= 10, false) THEN 'periods' END, CASE WHEN NOT coalesce(lift >= 4500, false) THEN 'lift' END, CASE WHEN NOT coalesce(low >= 0, false) THEN 'low' END], lambda x: x IS NOT NULL), ','), '') AS failed, CASE WHEN low > 0 THEN 'above' WHEN high < 0 THEN 'below' ELSE 'spans' END AS verdict FROM s")
def gate_verdicts(spark, sf_dir):
    s = segments(spark, sf_dir)
    failed = R.failures(("periods", F.col("n") >= 10), ("lift", F.col("lift") >= 4500), ("low", F.col("low") >= 0))
    return s.select("arm", F.array_join(failed, ",").alias("failed"), R.interval_verdict(F.col("low"), F.col("high")).alias("verdict"))


@register("""WITH s AS (SELECT o_custkey AS arm, CASE o_orderstatus WHEN 'P' THEN 'fail' WHEN 'O' THEN 'insufficient' ELSE 'pass' END AS state FROM orders),
p AS (SELECT *, CASE state WHEN 'fail' THEN 0 WHEN 'insufficient' THEN 1 ELSE 2 END AS k FROM s) SELECT arm, arg_min(state, k) AS state FROM p GROUP BY arm""")
def worst_of_rollup(spark, sf_dir):
    return worst_of(read_table(spark, sf_dir, "orders"), F.col("o_custkey"))


def worst_of(orders, arm):
    state = F.when(F.col("o_orderstatus") == "P", "fail").when(F.col("o_orderstatus") == "O", "insufficient").otherwise("pass")
    return R.accumulate_worst(orders.select(arm.alias("arm"), state.alias("state")), ("fail", "insufficient", "pass"), "arm")


@register(PANEL_SQL + """, r AS (SELECT ticker, row_number() OVER (ORDER BY mktcap DESC, ticker) AS a, row_number() OVER (ORDER BY name DESC) AS b, count(*) OVER () AS n FROM meta)
SELECT ticker, CASE WHEN a <= ceil(0.3 * n) AND b <= ceil(0.3 * n) THEN 'consensus' WHEN b <= ceil(0.3 * n) THEN 'panel' WHEN a <= ceil(0.3 * n) THEN 'factor' ELSE 'none' END AS badge FROM r""")
def badges(spark, sf_dir):
    r = global_rank(global_rank(meta_of(spark, sf_dir), "a", F.desc("mktcap"), "ticker"), "b", F.desc("name"))
    return r.select("ticker", R.badge(R.top_tier(F.col("a"), F.col("n")), R.top_tier(F.col("b"), F.col("n"))).alias("badge"))


@register("""WITH v AS (SELECT conv_id, count(*) FILTER (length(text) < 40) AS rejects, count(*) FILTER (length(text) >= 100) AS passes, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN rejects >= 2 THEN 'reject' WHEN passes * 2 > n THEN 'pass' ELSE 'conditional' END AS verdict, CASE WHEN passes >= 3 THEN 'act' ELSE 'watch' END AS action FROM v""")
def debate_verdicts(spark, sf_dir):
    v = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.length("text") < 40).alias("rejects"), F.count_if(F.length("text") >= 100).alias("passes"), F.count(F.lit(1)).alias("n"))
    return v.select("conv_id", R.debate_verdict(F.col("rejects"), F.col("passes"), F.col("n")).alias("verdict"), R.brake(F.lit("act"), F.col("passes"), 3).alias("action"))


@register("""WITH c AS (SELECT event_type AS factor, round(corr(value, CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS rho FROM events GROUP BY 1)
SELECT factor, rho, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN abs(rho) >= 0.01 THEN sign(rho) * 0.05 ELSE 0.0 END)), 6) AS weight FROM c""")
def funnel_reflection(spark, sf_dir):
    c = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("factor")).agg(F.round(F.corr("value", F.get_json_object("props", "$.k").cast("double")), 6).alias("rho"))
    return c.select("factor", "rho", F.round(R.nudge(F.lit(0.5), F.col("rho"), least=0.01), 6).alias("weight"))


@register("""WITH p(c_mktsegment, pp, cp) AS (VALUES ('AUTOMOBILE', 3.0, 15.0), ('BUILDING', 1.0, 5.0), ('FURNITURE', 0.5, 1.5), ('HOUSEHOLD', 2.0, 10.0), ('MACHINERY', 0.25, 1.25))
SELECT c_custkey, CASE WHEN pp IS NOT NULL THEN round((c_custkey * 100 * pp + abs(c_acctbal) * cp) / 1000000 * 1380, 4) END AS cost FROM customer LEFT JOIN p USING (c_mktsegment)""")
def token_cost(spark, sf_dir):
    prices = spark.createDataFrame([("AUTOMOBILE", 3.0, 15.0), ("BUILDING", 1.0, 5.0), ("FURNITURE", 0.5, 1.5), ("HOUSEHOLD", 2.0, 10.0), ("MACHINERY", 0.25, 1.25)], "c_mktsegment string, pp double, cp double")
    c = read_table(spark, sf_dir, "customer").join(F.broadcast(prices), "c_mktsegment", "left")  # a fixed price list
    return c.select("c_custkey", R.token_cost(F.col("c_custkey") * 100, F.abs("c_acctbal"), F.col("pp"), F.col("cp"), 1380).alias("cost"))


@register("""SELECT 'l_quantity' AS left, 'l_discount' AS right, round(corr(l_quantity, l_discount), 6) AS rho, count(*) AS n FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6), count(*) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6), count(*) FROM lineitem""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def pairwise_correlation(spark, sf_dir):
    return R.correlations(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@register("""WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type = 'error') SELECT user_id, event_id, value FROM t WHERE r <= 2 ORDER BY value DESC, event_id LIMIT 20""")
def fair_top(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", "value")
    return R.fairness(e, "user_id", 2, [F.desc("value"), F.asc("event_id")], 20)


@register("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS v FROM events GROUP BY ALL), x AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY d) AS before FROM p)
SELECT user_id, d, round(CASE WHEN abs(v / 100 - before / 100) < 0.01 THEN 0.0 WHEN v > before THEN (v / 100 - before / 100) * 0.00015 ELSE (before / 100 - v / 100) * 0.00245 END, 9) AS cost FROM x WHERE before IS NOT NULL""")
def exposure_cost(spark, sf_dir):
    p = read_table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("value").alias("v"))
    x = p.withColumn("before", F.lag("v", 1).over(Window.partitionBy("user_id").orderBy("d"))).filter("before IS NOT NULL")
    return x.select("user_id", "d", F.round(R.trade_cost(F.col("before") / 100, F.col("v") / 100), 9).alias("cost"))


@register("""SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1') OR contains(lower(lang), 'fr')""")
def search_contains(spark, sf_dir):
    has = lambda c, q: F.contains(F.lower(c), F.lit(q))
    return read_table(spark, sf_dir, "documents").filter(has("text", "license") | has("source", "src1") | has("lang", "fr")).select("doc_id", "lang", "source")


@register("""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""")
def vote_pivot(spark, sf_dir):
    langs = ["en", "de", "fr", "es"]
    p = read_table(spark, sf_dir, "documents").groupBy("source").pivot("lang", langs).count()
    return p.select("source", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in langs])


@register("""WITH u AS (SELECT n_name AS name, CASE WHEN starts_with(n_name, 'I') THEN 'a' WHEN starts_with(n_name, 'U') THEN 'b' END AS hit FROM nation), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT n_nationkey, coalesce(s.n, 0) AS suppliers, EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900) AS rich, NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < -990) AS clean, coalesce(u.hit, u.name) AS label
FROM nation n LEFT JOIN s ON s.k = n.n_nationkey JOIN u ON u.name = n.n_name""")
def exists_and_left(spark, sf_dir):
    nation, customer = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "customer")
    suppliers = read_table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    flags = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.bool_or(F.col("c_acctbal") > 9900).alias("rich"), F.bool_or(F.col("c_acctbal") < -990).alias("poor"))
    label = F.when(F.col("n_name").startswith("I"), "a").when(F.col("n_name").startswith("U"), "b").otherwise(F.col("n_name"))
    out = nation.join(suppliers, "n_nationkey", "left").join(flags, "n_nationkey", "left")
    return out.select("n_nationkey", F.coalesce("n", F.lit(0)).alias("suppliers"), F.coalesce("rich", F.lit(False)).alias("rich"), (~F.coalesce("poor", F.lit(False))).alias("clean"), label.alias("label"))
