"""Selections at every selection day: the chart composite, staged buckets, legs, and how they did against the winners.

Every table has a column sel, the selection day, and holds all of them at once;
a cross-section is the rows of one sel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import few, settle
from panelforge.functions.scalar import midrank, row_mean
from panelforge.functions.sections import Section, every, held, midranks, over_sections, quantiles
from panelforge.operators import features as X
from panelforge.operators.forward import decile_spread, information_ratio
from panelforge.operators.rules import failures
from panelforge.operators.scoring import SIZE_CUTS, fill_missing, size_tier
from panelforge.operators.selection import select_sleeves

#: Sub-indicators of the chart composite.
SUBS = ("alignment", "recency", "rsi", "macd", "composite", "donchian", "confirmed", "atr_contraction")
# Fixed values.
KILL_LIMIT, IC_LEAST, LIFT_FALLBACK = 0.5, 0.30, 0.05
PRIMARY = ("trend", "full")
SCOPES = ("overall", "large", "mid", "small")


def marked_days(bars: DataFrame, days: DataFrame, sels: DataFrame) -> DataFrame:
    """bars with day, until, the day of the ticker's next row, and asked: whether a sel_day of sels lies from the one to before the other.

    A row holds from its day until the ticker's next one. sels has a row for each
    period, days one for each day of the market.
    """
    next_sel = days.join(F.broadcast(sels), F.col("sel_day") >= F.col("day")).groupBy("trade_date").agg(F.min("sel_day").alias("__sel"))
    dated = bars.join(F.broadcast(days.join(next_sel, "trade_date", "left")), "trade_date", "left")
    until = F.coalesce(F.lead("day").over(X.by_ticker()), F.lit(2**31 - 1))
    return dated.withColumn("until", until).withColumn("asked", F.coalesce(F.col("__sel") < F.col("until"), F.lit(False))).drop("__sel")


def at_selections(bars: DataFrame, days: DataFrame, sels: DataFrame, more: Callable[[X.Bars, X.Bars], dict[str, np.ndarray]], made: tuple[str, ...]) -> DataFrame:
    """Of bars the last one of each ticker up to each sel_day of sels, as sel, with factors, sub-indicators and what more makes.

    All bars are read, but only those are computed that hold at a selection day, and
    of their columns only what factors are computed from goes along.
    """
    rows = X.factor_bars(marked_days(bars.select("ticker", "trade_date", *X.FACTOR_INPUTS), days, sels), "asked", lambda every, asked: X.chart(every, asked) | more(every, asked), (*X.CHART, *made))
    return rows.join(F.broadcast(sels), (F.col("day") <= F.col("sel_day")) & (F.col("sel_day") < F.col("until"))).drop("until", "day").withColumnRenamed("sel_day", "sel")


def with_tier(stocks: DataFrame, floor: float) -> DataFrame:
    """stocks with tier: by the cuts of their cross-section's liquid rows; those that aren't liquid are small."""
    liquid = F.coalesce(F.col("adv60") >= floor, F.lit(False))
    tier = F.when(liquid, size_tier(F.col("mktcap"), F.col("__cut0"), F.col("__cut1"))).otherwise("small")
    return _cut(stocks, F.when(liquid & (F.col("mktcap") > 0), F.col("mktcap"))).withColumn("tier", tier).drop("__cut0", "__cut1")


def _cut(stocks: DataFrame, caps: Column) -> DataFrame:
    """stocks with the cuts of size of their cross-section, __cut0 and __cut1."""
    measure = lambda s: {f"__cut{i}": every(q, len(s["__cap"])) for i, q in enumerate(quantiles(s["__cap"], *SIZE_CUTS))}
    return over_sections(stocks.withColumn("__cap", caps), ["__cap"], ["__cut0", "__cut1"], measure, "sel")


def large_and_mid(stocks: DataFrame, floor: float) -> DataFrame:
    return with_tier(stocks, floor).filter(F.col("tier").isin("large", "mid"))


def chart_universe(stocks: DataFrame) -> DataFrame:
    """sel, ticker, mktcap, sleeve, rank_<sub> for each sub-indicator, and score, their mean; warm-up counts as 50."""
    rows = stocks.select("sel", "ticker", "mktcap", F.when(F.col("mktcap") > 0, F.col("mktcap")).alias("__cap"), *[F.col(s).cast("double").alias(f"__{s}") for s in SUBS])

    def measure(s: Section) -> dict:
        cuts = {f"__cut{i}": every(q, len(s["__cap"])) for i, q in enumerate(quantiles(s["__cap"], *SIZE_CUTS))}
        return {f"rank_{c}": midranks(held(s[f"__{c}"], 0.01, 0.99)) for c in SUBS} | cuts

    ranked = over_sections(rows, ["__cap", *(f"__{s}" for s in SUBS)], [*(f"rank_{s}" for s in SUBS), "__cut0", "__cut1"], measure, "sel")
    ranked = ranked.withColumns({f"rank_{s}": fill_missing(F.col(f"rank_{s}")) for s in SUBS})
    ranked = ranked.withColumn("sleeve", size_tier(F.col("mktcap"), F.col("__cut0"), F.col("__cut1")))
    score = F.round(row_mean(*[F.col(f"rank_{s}") for s in SUBS]), 8)
    return ranked.select("sel", "ticker", "mktcap", "sleeve", *[f"rank_{s}" for s in SUBS], score.alias("score"))


def left_out(chart: DataFrame, columns: list[str]) -> DataFrame:
    """chart once for each column left out of the score, and once with all (dropped is null).

    The score without a column is the sum of all less that column, over one
    fewer: rows are ranked anew for each, indicators aren't.
    """
    ranks = [F.col(c) for c in columns]
    total = reduce(lambda a, b: a + b, ranks)
    versions = [F.struct(F.lit(None).cast("string").alias("dropped"), (total / len(columns)).alias("value"))]
    versions += [F.struct(F.lit(c).alias("dropped"), ((total - F.col(c)) / (len(columns) - 1)).alias("value")) for c in columns]
    out = chart.withColumn("__v", F.explode(F.array(*versions)))
    return out.withColumns({"dropped": F.col("__v.dropped"), "score": F.round("__v.value", 8)}).drop("__v")


def staged_buckets(scored: DataFrame, stages: DataFrame, quota: dict[str, int], *group: str) -> DataFrame:
    """The picks of scored(group, bucket, ticker, sleeve, score): what a bucket takes isn't open to those of later stages.

    stages(bucket, stage, and any of the group's columns) says in which order the
    buckets of a group take, from 1 on; the order may differ from group to group.
    """
    keys = [c for c in stages.columns if c != "stage"]
    rows = scored.join(stages, keys)
    used, out = None, None
    for stage in range(1, 4):
        open_rows = rows.filter(F.col("stage") == stage)
        if used is not None:
            open_rows = open_rows.join(used, [*group, "ticker"], "left_anti")
        picked = settle(select_sleeves(open_rows, quota, *group).drop("stage"))  # some rows a group
        taken = picked.select(*group, "ticker")
        used = taken if used is None else used.union(taken)
        out = picked if out is None else out.unionByName(picked)
    return out


def pooled_top(picked: DataFrame, sizes: tuple[int, ...], *group: str) -> DataFrame:
    """The best n of all buckets' picks by score, for each n of sizes: group, n, ticker."""
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "ticker"))
    ranked = picked.withColumn("__r", best).withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("__r") <= F.col("n"))
    return ranked.select(*group, "n", "ticker")


def correlation(a: str, b: str, least: int = 2) -> Column:
    """Pearson over rows that have both; null without spread or with fewer than least.

    The deviation doesn't tell whether there is spread: partial means are merged by a
    quotient and a product, so that of equal values in several partitions isn't always 0.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when((F.count(x) >= least) & spread, F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 8))


def rounded_as_sql(value: Column, digits: int = 4) -> Column:
    """value rounded as the SQL does: the nearest whole number of the last digit's units, halves away from 0.

    F.round takes the decimal text, where 0.75245 is a half; as a double it is a little less, and so is its product.
    """
    units = float(10**digits)
    return F.round(value * units) / units


def interval(value: str) -> list[Column]:
    """mean, low and high of the present values; the interval needs two."""
    two = F.count(value) >= 2
    return [F.avg(value).alias("mean"), F.when(two, rounded_as_sql(F.percentile(value, 0.05))).alias("low"), F.when(two, rounded_as_sql(F.percentile(value, 0.95))).alias("high")]


def overlap_samples(chart: DataFrame, scored: DataFrame) -> DataFrame:
    """sel, bucket, scope, factor, rho: how the chart's score goes with trend, the whole score and size, overall and by sleeve.

    scored: sel, bucket, ticker, eligible, rank_trend, score.
    """
    size = midrank(F.round(F.ln(F.when(F.col("mktcap") > 0, F.col("mktcap"))), 10), "sel")
    mine = chart.select("sel", "ticker", "sleeve", F.col("score").alias("chart"), size.alias("size"))
    theirs = scored.filter("eligible").select("sel", "bucket", "ticker", F.col("rank_trend").alias("trend"), F.col("score").alias("full"))
    buckets = scored.select("bucket").distinct()
    rows = mine.join(F.broadcast(buckets)).join(theirs, ["sel", "bucket", "ticker"], "left")  # a row for each of three buckets
    factors = ("trend", "full", "size")
    out = rows.groupingSets([["sel", "bucket"], ["sel", "bucket", "sleeve"]], "sel", "bucket", "sleeve").agg(*[correlation("chart", f).alias(f) for f in factors])
    return out.select("sel", "bucket", F.coalesce("sleeve", F.lit("overall")).alias("scope"), F.explode(F.map_from_arrays(F.array(*map(F.lit, factors)), F.array(*factors))).alias("factor", "rho"))


def kill_switch(samples: DataFrame) -> DataFrame:
    """scope, factor, samples, mean, low, high, state: whether the composite is only what was tested already.

    A primary factor fires in a scope where the mean correlation is at least the
    limit either way, or the interval reaches it, and is blocked where there is
    no sample. Size is reported; flow has no source here and the surge is no
    factor of the score: they never fire.
    """
    spark = samples.sparkSession
    asked = spark.createDataFrame([(s, f) for s in SCOPES for f in ("trend", "full", "size", "flow", "surge")], "scope string, factor string")
    found = samples.groupBy("scope", "factor").agg(F.count("rho").alias("samples"), *interval("rho"))
    out = F.broadcast(asked).join(found, ["scope", "factor"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    fires = (F.abs("mean") >= KILL_LIMIT) | F.coalesce(F.col("high") >= KILL_LIMIT, F.lit(False))
    primary = F.col("factor").isin(*PRIMARY)
    state = (
        F.when(F.col("factor") == "flow", "off").when(F.col("factor") == "surge", "not applicable")
        .when(~primary, "reported").when(F.col("samples") == 0, "blocked").when(fires, "fired").otherwise("quiet")
    )
    return out.select("scope", "factor", "samples", "mean", "low", "high", state.alias("state"))


def period_ic(scored: DataFrame, returns: DataFrame, horizons: dict[str, int], *by: str) -> DataFrame:
    """by, sel, ic: the mean over buckets of the rank correlation of scores and returns over the bucket's horizon; three rows at least.

    scored: by, sel, bucket, ticker, score; returns: sel_day, horizon, ticker, ret.
    """
    named = F.create_map(*[F.lit(x) for pair in horizons.items() for x in pair])
    rows = scored.filter("score IS NOT NULL").withColumn("horizon", named[F.col("bucket")])
    both = rows.join(returns.filter("ret IS NOT NULL").withColumnRenamed("sel_day", "sel"), ["sel", "horizon", "ticker"])
    group = [*by, "sel", "bucket"]
    ranks = lambda s: {"__a": midranks(s["score"]), "__b": midranks(s["ret"])}
    ranked = over_sections(both.select(*group, "score", "ret"), ["score", "ret"], ["__a", "__b"], ranks, *group)
    ics = ranked.groupBy(*group).agg(correlation("__a", "__b", 3).alias("ic"))
    return ics.groupBy(*by, "sel").agg(F.avg("ic").alias("ic"))


def recalls(picks: DataFrame, winners: DataFrame, universe: DataFrame, *by: str) -> DataFrame:
    """by, sel, selected, hits, winners, recall, random, lift of picks(by, sel, ticker) against the winners of any horizon.

    Every period with winners counts for each of the picks' legs, also where a leg
    picks nothing; periods without winners are left out. random is what picking as
    many blindly would find.
    """
    won = winners.select(F.col("sel_day").alias("sel"), "ticker").distinct()
    total = won.groupBy("sel").agg(F.count(F.lit(1)).alias("winners"))
    size = universe.groupBy("sel").agg(F.count(F.lit(1)).alias("size"))
    periods = total.join(size, "sel")
    if by:
        periods = periods.join(few(picks.select(*by).distinct()))  # a row for each leg
    hit = picks.join(won.withColumn("__hit", F.lit(1)), ["sel", "ticker"], "left").groupBy(*by, "sel").agg(F.count(F.lit(1)).alias("selected"), F.count("__hit").alias("hits"))
    out = periods.join(hit, [*by, "sel"], "left").fillna(0, ["selected", "hits"])
    recall, blind = F.col("hits") / F.col("winners"), F.col("selected") / F.col("size")
    return out.select(*by, "sel", "selected", "hits", "winners", recall.alias("recall"), blind.alias("random"), (recall - blind).alias("lift"))


def ratio(ic: str) -> Column:
    """Mean over deviation of at least two present values, which aren't all 0."""
    r = information_ratio(F.col(ic))
    return F.when((F.count(ic) >= 2) & ~((F.stddev_pop(ic) == 0) & (F.avg(ic) == 0)), r)


def gate(low: Column, mean: Column, ir: Column) -> Column:
    """Names of the failed checks: the lift's interval above 0 (without one, its mean at least the fallback), and a finite ratio of at least the least."""
    lifted = F.when(low.isNotNull(), low > 0).otherwise(mean >= LIFT_FALLBACK)
    return failures(("lift", lifted), ("ic", (ir >= IC_LEAST) & (ir < float("inf"))))


def leg_report(found: DataFrame, ics: DataFrame, *by: str) -> DataFrame:
    """by, periods, pooled recall with the interval of the periods', lift with interval, mean and ratio of ic, and the gate's failures."""
    joined = found.join(ics, [*(c for c in by if c in ics.columns), "sel"], "left")
    low, high = (F.when(F.count("lift") >= 2, rounded_as_sql(F.percentile("lift", p))) for p in (0.05, 0.95))
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), (F.sum("hits") / F.sum("winners")).alias("recall"), *[c.alias(f"recall_{n}") for c, n in zip(interval("recall")[1:], ("low", "high"))],
        F.avg("lift").alias("lift"), low.alias("lift_low"), high.alias("lift_high"), F.avg("ic").alias("ic_mean"), ratio("ic").alias("ic_ir"),
    )
    return out.withColumn("fails", F.array_join(gate(F.col("lift_low"), F.col("lift"), F.col("ic_ir")), ","))


def dropped_recall(picks: DataFrame, winners: DataFrame, universe: DataFrame) -> DataFrame:
    """dropped, recall, loss: pooled recall without each indicator, and how much less that is than with all (dropped is null)."""
    named = picks.withColumn("dropped", F.coalesce("dropped", F.lit("")))
    pooled = recalls(named, winners, universe, "dropped").groupBy("dropped").agg((F.sum("hits") / F.sum("winners")).alias("recall"))
    whole = pooled.filter("dropped = ''").select(F.col("recall").alias("whole"))  # a single row
    return pooled.filter("dropped <> ''").join(F.broadcast(whole)).select("dropped", "recall", (F.col("whole") - F.col("recall")).alias("loss"))


def verdict(switch: DataFrame, report: DataFrame) -> DataFrame:
    """decision, appendix, reasons: of the kill switch first, then of the gate of the adjudicated leg; a single row."""
    told = F.concat_ws("/", "scope", "factor")
    reasons = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == s, told))), ",")
    facts = switch.agg(F.bool_or(F.col("state") == "fired").alias("fired"), F.bool_or(F.col("state") == "blocked").alias("blocked"), reasons("fired").alias("fires"), reasons("blocked").alias("blocks"))
    both = facts.join(F.broadcast(report.select("fails")))  # a single row each
    decision = F.when(F.col("fired"), "KILLSWITCH_FIRED").when(F.col("blocked"), "KILLSWITCH_BLOCKED").when(F.col("fails") == "", "SELECTOR_GATE_PASS").otherwise("SELECTOR_GATE_FAIL")
    reason = F.when(F.col("fired"), F.col("fires")).when(F.col("blocked"), F.col("blocks")).otherwise(F.col("fails"))
    return both.select(decision.alias("decision"), (F.col("fired") | F.col("blocked")).alias("appendix"), reason.alias("reasons"))


# Marginal legs


def funnel(picks: DataFrame, winners: DataFrame, universe: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """leg, sel, and counts of each period with winners: selected, size, num and den of all winners, lm_num and lm_den of
    large and mid ones, and num_<bucket> and den_<bucket> of each horizon's winners against the picks of its bucket.

    picks: leg, sel, bucket, ticker, each ticker in one bucket; universe: sel, ticker, tier.
    """
    named = F.create_map(*[F.lit(x) for b, h in horizons.items() for x in (h, b)])
    large = F.col("tier").isin("large", "mid")
    by_bucket = winners.select(F.col("sel_day").alias("sel"), named[F.col("horizon")].alias("bucket"), "ticker")
    won = by_bucket.select("sel", "ticker").distinct().join(universe.select("sel", "ticker", "tier"), ["sel", "ticker"])
    dens = won.groupBy("sel").agg(F.count(F.lit(1)).alias("den"), F.count_if(large).alias("lm_den"))
    sizes = universe.groupBy("sel").agg(F.count(F.lit(1)).alias("size"))
    horizon_dens = by_bucket.groupBy("sel").agg(*[F.count_if(F.col("bucket") == b).alias(f"den_{b}") for b in horizons])
    own = by_bucket.withColumn("__own", F.lit(1))
    hits = (
        picks.join(won.withColumn("__won", F.lit(1)), ["sel", "ticker"], "left").join(own, ["sel", "bucket", "ticker"], "left").groupBy("leg", "sel")
        .agg(
            F.count(F.lit(1)).alias("selected"), F.count("__won").alias("num"), F.count_if(F.col("__won").isNotNull() & large).alias("lm_num"),
            *[F.count_if(F.col("__own").isNotNull() & (F.col("bucket") == b)).alias(f"num_{b}") for b in horizons],
        )
    )
    periods = dens.join(sizes, "sel").join(horizon_dens, "sel").join(few(picks.select("leg").distinct()))  # a row for each leg
    return periods.join(hits, ["leg", "sel"], "left").fillna(0, ["selected", "num", "lm_num", *[f"num_{b}" for b in horizons]])


def pooled(counts: DataFrame, ics: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """leg, periods, pooled recall overall, of large and mid, and by horizon, the random share and the ratio to it, interval of the periods' recall, mean and ratio of ic."""
    rows = counts.withColumn("recall", F.col("num") / F.col("den")).join(ics, ["leg", "sel"], "left")
    share = lambda n, d: F.try_divide(F.sum(n), F.sum(d))
    out = rows.groupBy("leg").agg(
        F.count(F.lit(1)).alias("periods"), share("num", "den").alias("overall"), share("lm_num", "lm_den").alias("largemid"), *[share(f"num_{b}", f"den_{b}").alias(b) for b in horizons], share("selected", "size").alias("random"),
        *[c.alias(f"recall_{n}") for c, n in zip(interval("recall")[1:], ("low", "high"))], F.avg("ic").alias("ic_mean"), ratio("ic").alias("ic_ir"),
    )
    return out.withColumn("random_ratio", F.try_divide("overall", "random"))


def marginal(counts: DataFrame, legs: DataFrame, base: str, other: str) -> DataFrame:
    """periods, lift with its interval over the same periods, and the other leg's pooled figures less the base's; a single row."""
    of = lambda leg: F.sum(F.when(F.col("leg") == leg, F.col("num") / F.col("den")))
    lifts = counts.groupBy("sel").agg((of(other) - of(base)).alias("lift"))
    two = F.count("lift") >= 2
    lift = lifts.agg(F.count("lift").alias("periods"), F.avg("lift").alias("lift"), F.when(two, rounded_as_sql(F.percentile("lift", 0.05))).alias("lift_low"), F.when(two, rounded_as_sql(F.percentile("lift", 0.95))).alias("lift_high"))
    figures = ("overall", "largemid", "ic_mean", "ic_ir")
    less = lambda c: F.max(F.when(F.col("leg") == other, F.round(c, 4))) - F.max(F.when(F.col("leg") == base, F.round(c, 4)))
    return lift.join(F.broadcast(legs.agg(*[F.round(less(c), 4).alias(f"d_{c}") for c in figures])))  # a single row each


def overlap_report(samples: DataFrame, factors: tuple[str, ...], limit: float = KILL_LIMIT) -> DataFrame:
    """scope, factor, samples, mean, low, high, state: orthogonal, correlated (the mean at or over the limit either way) or missing."""
    asked = samples.sparkSession.createDataFrame([(s, f) for s in SCOPES for f in factors], "scope string, factor string")
    found = samples.groupBy("scope", "factor").agg(F.count("rho").alias("samples"), *interval("rho"))
    out = F.broadcast(asked).join(found, ["scope", "factor"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return out.withColumn("state", F.when(F.col("samples") == 0, "missing").when(F.abs("mean") >= limit, "correlated").otherwise("orthogonal"))


def marginal_verdict(overlap: DataFrame, lift: DataFrame, proven: bool) -> DataFrame:
    """verdict, orthogonal, raw of a marginal lift: it needs the interval above 0, a better ratio of ic, and a factor that
    is no proxy; without proof that the data were known at the time it stays blocked. A single row."""
    fine = overlap.agg(F.bool_and(F.col("state") == "orthogonal").alias("orthogonal"))
    rows = lift.join(F.broadcast(fine))  # a single row each
    helps = F.coalesce((F.col("lift_low") > 0) & (F.col("d_ic_ir") > 0), F.lit(False)) & F.col("orthogonal")
    raw = F.when(helps, "MARGINAL_LIFT").otherwise("NO_MARGINAL_LIFT")
    verdict = F.when(F.lit(not proven), "BLOCKED").when(~F.col("orthogonal"), "NOT_ORTHOGONAL").when(helps, "EXPLORATORY_LIFT").otherwise("EXPLORATORY_NO_LIFT")
    return rows.select(verdict.alias("verdict"), "orthogonal", raw.alias("raw"))


# Generators of combined selections


#: In which order the buckets take in each regime of the market.
REGIME_ORDER = {"bear": ("short", "mid", "long"), "recovery": ("mid", "short", "long"), "bull": ("long", "mid", "short")}


def regime_stages(labels: DataFrame) -> DataFrame:
    """sel, bucket, stage of labels(sel, label): the order of buckets that the period's regime asks for."""
    table = F.create_map(*[x for label, order in REGIME_ORDER.items() for x in (F.lit(label), F.array(*map(F.lit, order)))])
    return labels.select("sel", F.posexplode(table[F.col("label")]).alias("__at", "bucket")).select("sel", "bucket", (F.col("__at") + 1).alias("stage"))


def share_below(value: str, known: str, *group: str) -> Column:
    """Percent of the group's known values that are at most the row's; 50 without one."""
    w = Window.partitionBy(*group, F.col(known).isNull()).orderBy(value)
    return F.when(F.col(value).isNull(), F.lit(50.0)).otherwise(F.cume_dist().over(w) * 100)


def earnings_blended(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """scored with, in bull periods, half the share of scores at or below a row's and half that of its earnings as the score.

    Only rows with a score are blended and make up the shares; the others stay without one.
    """
    rows = scored.join(labels, "sel").withColumn("__e", F.when(F.col("score").isNotNull(), F.col("earnings")))
    blend = 0.5 * share_below("score", "score", "sel", "bucket") + 0.5 * share_below("__e", "__e", "sel", "bucket")
    return rows.withColumn("__b", F.when(F.col("score").isNotNull() & (F.col("label") == "bull"), F.round(blend, 8))).withColumn("score", F.coalesce("__b", "score")).drop("__b", "__e", "label")


def with_reserve(base: DataFrame, reserve: DataFrame, k: int, *group: str) -> DataFrame:
    """group, ticker: the best k of reserve that base lacks take the place of as many of the worst of base; both have a score."""
    order = Window.partitionBy(*group)
    added = reserve.join(base, [*group, "ticker"], "left_anti").withColumn("__r", F.row_number().over(order.orderBy(F.desc("score"), "ticker"))).filter(F.col("__r") <= k)
    room = added.groupBy(*group).agg(F.count(F.lit(1)).alias("__k"))
    kept = base.withColumn("__r", F.row_number().over(order.orderBy("score", "ticker"))).join(room, list(group), "left").filter(F.col("__r") > F.coalesce("__k", F.lit(0)))
    return kept.select(*group, "ticker").union(added.select(*group, "ticker"))


def group_verdict(records: DataFrame, *group: str) -> DataFrame:
    """group, periods, lift with interval, ic_ir, primary, cogate, verdict of records(group, lift, ic).

    A group that passes both is still only pending: the check for neutrality of
    size, which a clean pass would need, isn't part of it.
    """
    two = F.count("lift") >= 2
    out = records.groupBy(*group).agg(
        F.count(F.lit(1)).alias("periods"), F.avg("lift").alias("lift"), F.when(two, rounded_as_sql(F.percentile("lift", 0.05))).alias("low"), F.when(two, rounded_as_sql(F.percentile("lift", 0.95))).alias("high"), ratio("ic").alias("ic_ir")
    )
    primary = F.when(F.col("low").isNotNull(), F.col("low") > 0).otherwise(F.coalesce(F.col("lift") >= LIFT_FALLBACK, F.lit(False)))
    out = out.withColumns({"primary": primary, "cogate": F.coalesce(F.col("ic_ir") >= IC_LEAST, F.lit(False))})
    return out.withColumn("verdict", F.when(F.col("primary") & F.col("cogate"), "ADJUDICATE_PENDING_SIZE_NEUTRAL").otherwise("FAIL"))


# Scoped correlations of a harvest


RANKED = ("trend", "flow", "earnings", "quality")
TERCILE_LEAST, SCOPE_LEAST = 9, 5


def harvest_blocks(scored: DataFrame, returns: DataFrame, tiers: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """sel, block, value: means over the buckets of a period.

    Blocks: ic, of all eligible rows; top_tercile, of those whose score is in the
    upper third (nine rows at least); large and mid, of the instruments' tiers, and
    trend, flow, earnings and quality, of a factor's rank in place of the score
    (five rows at least); spread, the best tenth's return less the worst's, net of
    cost. scored: sel, bucket, ticker, eligible, score and rank_<factor>.
    """
    named = F.create_map(*[F.lit(x) for pair in horizons.items() for x in pair])
    rows = scored.filter("eligible").withColumn("horizon", named[F.col("bucket")])
    both = rows.join(returns.filter("ret IS NOT NULL").withColumnRenamed("sel_day", "sel"), ["sel", "horizon", "ticker"]).join(tiers.select("sel", "ticker", "tier"), ["sel", "ticker"])
    least = {"ic": 3, "top_tercile": 3} | dict.fromkeys(("large", "mid", *RANKED), SCOPE_LEAST)
    both = both.withColumns({f"__{f}": F.round(f"rank_{f}", 8) for f in RANKED} | {f"__{t}": F.when(F.col("tier") == t, F.col("score")) for t in ("large", "mid")})

    def measure(s: Section) -> dict:
        """Of each block the ranks of its values and of the returns of the same rows."""
        score, third = s["score"], quantiles(s["score"], 2.0 / 3.0)[0]
        low = np.ma.getdata(score) < third if third is not None and len(score) >= TERCILE_LEAST else True
        values = {"ic": score, "top_tercile": np.ma.masked_where(np.ma.getmaskarray(score) | low, score)} | {b: s[f"__{b}"] for b in ("large", "mid", *RANKED)}
        return {f"a_{b}": midranks(v) for b, v in values.items()} | {f"b_{b}": midranks(np.ma.MaskedArray(np.ma.getdata(s["ret"]), np.ma.getmaskarray(v))) for b, v in values.items()}

    inputs, made = ["score", "ret", *(f"__{b}" for b in ("large", "mid", *RANKED))], [f"{x}_{b}" for b in least for x in ("a", "b")]
    ranked = over_sections(both.select("sel", "bucket", *inputs), inputs, made, measure, "sel", "bucket")
    each = F.inline(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(n).alias("least"), F.col(f"a_{b}").alias("a"), F.col(f"b_{b}").alias("b")) for b, n in least.items()]))
    ics = ranked.select("sel", "bucket", each).filter("a IS NOT NULL").groupBy("sel", "bucket", "block").agg(F.when(F.count(F.lit(1)) >= F.max("least"), correlation("a", "b", 3)).alias("value"))
    spread = decile_spread(both.select("sel", "bucket", "ticker", "score", "ret"), "sel", "bucket").select("sel", "bucket", F.lit("spread").alias("block"), F.col("spread").alias("value"))
    return ics.unionByName(spread).groupBy("sel", "block").agg(F.avg("value").alias("value")).filter("value IS NOT NULL")


def harvest_summary(blocks: DataFrame) -> DataFrame:
    """block, periods, mean, low, high, median, positive (share of periods above 0) and ratio of harvest_blocks."""
    return blocks.groupBy("block").agg(
        F.count("value").alias("periods"), *interval("value"), F.percentile("value", 0.5).alias("median"), F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("positive"), ratio("value").alias("ratio")
    )


# Shadow arms of a sector hypothesis


TILT, SHARE, LEAST_IN_SECTOR = 10.0, 0.30, 3


def leading_sectors(stocks: DataFrame) -> DataFrame:
    """sel, sector: the best share, one at least, of the sectors of three rows or more by the mean of their momentum m."""
    means = stocks.filter("m IS NOT NULL").groupBy("sel", "sector").agg(F.round(F.avg("m"), 8).alias("momentum"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_IN_SECTOR)
    w = Window.partitionBy("sel")
    place, most = F.row_number().over(w.orderBy(F.desc("momentum"), "sector")), F.greatest(F.lit(1), F.ceil(F.lit(SHARE) * F.count(F.lit(1)).over(w)))
    return means.withColumn("__lead", place <= most).filter("__lead").select("sel", "sector")


def tilted(scored: DataFrame, leading: DataFrame) -> DataFrame:
    """scored(sel, sector, score, ...) with TILT more for rows of a leading sector; without a score they stay so."""
    return scored.join(leading.withColumn("__t", F.lit(TILT)), ["sel", "sector"], "left").withColumn("score", F.col("score") + F.coalesce("__t", F.lit(0.0))).drop("__t")


def gated(stocks: DataFrame, leading: DataFrame) -> DataFrame:
    """The stocks of leading sectors; all of a cross-section that has no leading sector, as there is no hypothesis to gate by."""
    some = few(leading.select("sel").distinct())
    return stocks.join(few(leading), ["sel", "sector"], "left_semi").select(*stocks.columns).unionByName(stocks.join(some, "sel", "left_anti").select(*stocks.columns))


def arm_facts(picks: DataFrame, stocks: DataFrame, gate: DataFrame, quota: int, gate_arm: str) -> DataFrame:
    """arm, sel, selected, status, sectors, universe_size, universe_hash, gate_eligible, cut: of picks(arm, sel, ticker, sector).

    sectors are the picks' counts by sector. Size and hash are of the whole
    cross-section, so all arms of a period share them. The gate's arm alone has an
    eligible size and a number of cut rows, and is incomplete with fewer picks
    than the quotas ask for.
    """
    from panelforge.operators.rules import cover_hash

    size = stocks.groupBy("sel").agg(F.count_distinct("ticker").alias("universe_size"))
    hashes = cover_hash(stocks, "ticker", "sel").withColumnRenamed("hash", "universe_hash")
    inside = gate.groupBy("sel").agg(F.count_distinct("ticker").alias("gate_eligible"))
    by_sector = picks.groupBy("arm", "sel", "sector").agg(F.count(F.lit(1)).alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sector", "n"))), lambda x: F.concat(x["sector"], F.lit("="), x["n"].cast("string"))), ",")
    out = by_sector.groupBy("arm", "sel").agg(F.sum("n").alias("selected"), shown.alias("sectors")).join(size, "sel").join(hashes, "sel").join(inside, "sel", "left")
    own = F.col("arm") == gate_arm
    return out.select(
        "arm", "sel", "selected", F.when(own & (F.col("selected") < quota), "incomplete_run").otherwise("logged").alias("status"), "sectors", "universe_size", "universe_hash",
        F.when(own, F.col("gate_eligible")).alias("gate_eligible"), F.when(own, F.col("universe_size") - F.col("gate_eligible")).alias("cut"),
    )


def cut_winners(stocks: DataFrame, gate: DataFrame, winners: DataFrame) -> DataFrame:
    """sel, horizon, cut_winners, mean_return and listed (ticker:return, by ticker): what a gate cut that became a winner.

    An observation, no verdict on the gate. Periods and horizons without any have no row.
    """
    cut = stocks.select("sel", "ticker").join(gate.select("sel", "ticker"), ["sel", "ticker"], "left_anti")
    rows = winners.withColumnRenamed("sel_day", "sel").join(cut, ["sel", "ticker"], "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ticker", "ret"))), lambda x: F.concat(x["ticker"].cast("string"), F.lit(":"), rounded_as_sql(x["ret"]).cast("decimal(20,4)").cast("string")))  # winners of one cross-section
    return rows.groupBy("sel", "horizon").agg(F.count(F.lit(1)).alias("cut_winners"), F.avg("ret").alias("mean_return"), F.array_join(listed, ",").alias("listed"))
