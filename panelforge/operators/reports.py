"""Report blocks: ablation, recovery, adjudication, eligibility, fundamentals and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalar import row_mean


def ablation(ranks: DataFrame, factors: list[str], winners: DataFrame, n: int, *group: str) -> DataFrame:
    """group, dropped, hits: winners among the top n when one factor is left out of the mean; 'none' leaves out none."""
    legs = F.array(F.lit("none"), *map(F.lit, factors))
    rows = ranks.withColumn("dropped", F.explode(legs))
    mean = row_mean(*[F.when(F.col("dropped") != f, F.col(f)) for f in factors])
    w = Window.partitionBy(*group, "dropped").orderBy(F.desc("s"), "ticker")
    top = rows.withColumn("s", F.round(mean, 8)).filter("s IS NOT NULL").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    hit = winners.select(*group, "ticker", F.lit(1).alias("hit"))
    return top.join(hit, [*group, "ticker"], "left").groupBy(*group, "dropped").agg(F.count("hit").alias("hits"))


def recovery(missed: DataFrame, reserve: DataFrame, universe: Column, *group: str) -> DataFrame:
    """group, missed, recovered, ratio: missed winners inside the reserve against what chance would put there."""
    size = reserve.groupBy(*group).agg(F.count(F.lit(1)).alias("reserved"))
    inside = missed.join(reserve.select(*group, "ticker", F.lit(1).alias("in")), [*group, "ticker"], "left")
    out = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("missed"), F.count("in").alias("recovered")).join(size, list(group))
    expected = F.col("missed") * F.col("reserved") / universe
    return out.select(*group, "missed", "recovered", F.round(F.col("recovered") / expected, 6).alias("ratio"))


def adjudicate(cells: DataFrame, baseline: str) -> DataFrame:
    """config, wins, regimes, best, worst, adopt: cells(config, regime, value) against the baseline of the same regime.

    Adopted is what isn't below the baseline anywhere and above it somewhere.
    """
    base = cells.filter(F.col("config") == baseline).select("regime", F.col("value").alias("base"))
    lift = cells.filter(F.col("config") != baseline).join(base, "regime").withColumn("lift", F.round(F.col("value") - F.col("base"), 6))
    return lift.groupBy("config").agg(
        F.count_if(F.col("lift") > 0).alias("wins"), F.count(F.lit(1)).alias("regimes"), F.max_by("regime", F.struct("lift", "regime")).alias("best"),
        F.min_by("regime", F.struct("lift", "regime")).alias("worst"), (F.bool_and(F.col("lift") >= 0) & F.bool_or(F.col("lift") > 0)).alias("adopt"),
    )


def reason(*steps: tuple[str, Column]) -> Column:
    """The name of the first step that holds, else 'eligible'."""
    first = F.when(F.coalesce(steps[0][1], F.lit(False)), steps[0][0])
    return reduce(lambda c, s: c.when(F.coalesce(s[1], F.lit(False)), s[0]), steps[1:], first).otherwise("eligible")


def reflection(votes: DataFrame, least: float = 50.0) -> DataFrame:
    """persona, calls, hit_rate, weighted: votes(persona, conviction, ret); favoured calls are those of enough conviction."""
    favoured = F.col("conviction") >= least
    hits = F.avg(F.when(favoured, (F.col("ret") > 0).cast("double")))
    weighted = F.try_divide(F.sum(F.col("conviction") * F.col("ret")), F.sum("conviction"))
    return votes.groupBy("persona").agg(F.count_if(favoured).alias("calls"), F.round(hits, 6).alias("hit_rate"), F.round(weighted, 6).alias("weighted"))


def quality(revenue: Column, income: Column, equity: Column, debt: Column, before: Column) -> tuple[Column, Column]:
    """(mean of the metrics there are, how many there are): roe and leverage need equity over 0, growth a base over 0."""
    owned = F.when(equity > 0, equity)
    parts = [income / owned, -debt / owned, F.when(revenue > 0, income / revenue), F.when(before > 0, revenue / before - 1)]
    count = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.when(count >= 3, row_mean(*parts)).otherwise(0.0), count


def first_alias(lines: DataFrame, aliases: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One value for each key and account: of the lines whose name is an alias, the one with the least priority number.

    aliases: name, account, priority.
    """
    joined = lines.withColumnRenamed(name, "name").join(F.broadcast(aliases), "name")  # a fixed list
    return joined.groupBy(key, "account").agg(F.min_by(value, F.struct("priority", "name")).alias(value))


def snapshot_rows(positions: DataFrame) -> DataFrame:
    """date, ticker, is_cash, weight, value: each position, the portfolio (ticker null) and, if weights leave some, cash."""
    each = positions.select("date", "ticker", F.lit(False).alias("is_cash"), "weight", "value")
    total = positions.groupBy("date").agg(F.sum("weight").alias("weight"), F.sum("value").alias("value"))
    whole = total.select("date", F.lit(None).cast(dict(positions.dtypes)["ticker"]).alias("ticker"), F.lit(False).alias("is_cash"), F.lit(1.0).alias("weight"), "value")
    left = total.withColumn("weight", F.round(1 - F.col("weight"), 8)).filter("weight > 0")
    cash = left.select("date", F.lit(None).cast(dict(positions.dtypes)["ticker"]).alias("ticker"), F.lit(True).alias("is_cash"), "weight", F.lit(0.0).alias("value"))
    return each.unionByName(whole).unionByName(cash)


def fresh_and_incumbents(fresh: DataFrame, incumbents: DataFrame, key: str) -> DataFrame:
    """All fresh rows, and incumbents that aren't among them; origin tells which."""
    kept = incumbents.join(fresh.select(key), key, "left_anti")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(kept.withColumn("origin", F.lit("incumbent")))


def preferred_scope(lines: DataFrame, scopes: tuple[str, ...], *key: str) -> DataFrame:
    """Of each key's lines those of the first scope that the key has any of; keys with other scopes only have none."""
    place = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    ranked = lines.withColumn("__p", place).filter("__p > 0").withColumn("__best", F.min("__p").over(Window.partitionBy(*key)))
    return ranked.filter("__p = __best").drop("__p", "__best")


def grid_issues(cells: DataFrame, configs: DataFrame, regimes: DataFrame, rules: tuple[tuple[str, Column], ...]) -> DataFrame:
    """config, regime, issue, reasons: what the grid of configs and regimes lacks (missing), and cells that break a rule (invalid), by name."""
    from panelforge.functions.lineage import few

    grid = configs.join(few(regimes))  # a row for each regime
    broken = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])), ",")
    found = cells.withColumn("reasons", broken).select("config", "regime", "reasons")
    out = grid.join(found, ["config", "regime"], "left")
    return out.filter("reasons IS NULL OR reasons <> ''").select("config", "regime", F.when(F.col("reasons").isNull(), "missing").otherwise("invalid").alias("issue"), F.coalesce("reasons", F.lit("")).alias("reasons"))
