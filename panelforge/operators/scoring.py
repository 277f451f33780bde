"""Cross-sectional scores at a selection date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalar import clamp, midrank, row_mean, signed_log, winsorize, z_to_score
from panelforge.functions.sections import Section, every, held, midranks, over_sections, quantiles

# Fixed values.
NEUTRAL, FAILED = 50.0, 5.0
BONUS_CAP = 10.0
SIZE_CUTS = (0.8, 0.4)
LEGACY_WEIGHTS = {
    "short": {"trend": 0.35, "volume": 0.30, "flow": 0.20, "volatility": 0.15},
    "mid": {"trend": 0.35, "volume": 0.20, "flow": 0.30, "volatility": 0.15},
    "long": {"trend": 0.30, "volume": 0.10, "flow": 0.30, "volatility": 0.30},
}


def rank_of(raw: Column, *group: str) -> Column:
    """Mid-rank percentile of the winsorized value, rounded first so that ties are the same everywhere."""
    return midrank(F.round(winsorize(raw, 0.01, 0.99, *group), 10), *group)


def with_ranks(rows: DataFrame, raws: dict[str, Column], *group: str) -> DataFrame:
    """rows with rank_of each raw column, all of them from one pass over a group."""
    raw = {n: f"__raw_{n}" for n in raws}
    out = rows.withColumns({raw[n]: c.cast("double") for n, c in raws.items()})
    return over_sections(out, list(raw.values()), list(raws), lambda s: {n: midranks(held(s[c], 0.01, 0.99)) for n, c in raw.items()}, *group)


def fill_missing(rank: Column, failed: Column | None = None) -> Column:
    """Structurally missing ranks are neutral, those whose source failed are low."""
    other = F.lit(NEUTRAL) if failed is None else F.when(failed, FAILED).otherwise(NEUTRAL)
    return F.coalesce(rank, other)


def volume_bonus(volume_rank: Column, trend_rank: Column, bucket: str) -> Column:
    if bucket == "long":
        return F.lit(0.0)
    return F.when(trend_rank >= 50, F.coalesce(clamp((volume_rank - 50) / 50 * BONUS_CAP, 0, BONUS_CAP), F.lit(0.0))).otherwise(0.0)


def pump_penalty(turnover_rank: Column, ret5: Column) -> Column:
    high = F.when(turnover_rank >= 99, 5.0).otherwise(0.0)
    return high + F.when(ret5 > 0.25, F.least(F.lit(20.0), (ret5 - 0.25) * 40)).otherwise(0.0)


def size_tier(mktcap: Column, large: Column, mid: Column) -> Column:
    return F.when(mktcap >= large, "large").when(mktcap >= mid, "mid").otherwise("small")


def bpp_scores(stocks: DataFrame, bucket: str, floor: float, with_issuance: bool = False) -> DataFrame:
    """stocks with sleeve, score, rank columns, bonus and penalty for a horizon, one cross-section for each sel.

    stocks: sel, ticker, sector, mktcap, adv60, trend_<bucket>_0/1, high_prox,
    flow60, surge, ret5, earnings, quality, their *_failed flags, net_issuance.
    Trend is ranked among liquid rows; all later ranks among liquid rows that
    have a primary trend. Rows outside have a null score and sleeve small.
    """
    first, primary = (F.col(f"trend_{bucket}_{i}") for i in (0, 1))
    out = stocks.withColumn("liquid", F.coalesce(F.col("adv60") >= floor, F.lit(False)))
    # A liquid row with a primary trend has a rank of it.
    out = out.withColumn("eligible", F.col("liquid") & primary.isNotNull())
    liquid, mask = (lambda c: F.when(F.col("liquid"), c)), (lambda c: F.when(F.col("eligible"), c))
    trends = {f"__t{i}": liquid(c) for i, c in enumerate([first, primary, *([F.col("high_prox")] if bucket == "long" else [])])}
    raws = trends | {
        "__adv": mask(signed_log(F.when(F.col("adv60") > 0, F.col("flow60") / F.col("adv60")))),
        "__sponsor": mask(signed_log(F.col("flow60"))),
        "rank_volume": mask(F.col("surge")),
        "rank_turnover": mask(F.when(F.col("mktcap") > 0, F.col("adv60") / F.col("mktcap"))),
        **({"__issuance": mask(F.col("net_issuance"))} if with_issuance else {}),
    }
    ranked, inside = tuple(raws), ("earnings", "quality")  # the latter within the sector
    out = out.withColumns({f"__raw_{n}": c.cast("double") for n, c in raws.items()} | {f"__raw_{n}": F.round(mask(F.col(n)), 10) for n in inside} | {"__cap": mask(F.when(F.col("mktcap") > 0, F.col("mktcap")))})

    def measure(s: Section) -> dict:
        cuts = {f"__cut{i}": every(q, len(s["__cap"])) for i, q in enumerate(quantiles(s["__cap"], *SIZE_CUTS))}
        return {n: midranks(held(s[f"__raw_{n}"], 0.01, 0.99)) for n in ranked} | {f"__{n}": midranks(s[f"__raw_{n}"], s["sector"]) for n in inside} | cuts

    made = [*ranked, *(f"__{n}" for n in inside), "__cut0", "__cut1"]
    out = over_sections(out, [*(f"__raw_{n}" for n in (*ranked, *inside)), "__cap", "sector"], made, measure, "sel")
    out = out.withColumn("rank_trend", row_mean(*map(F.col, trends)))
    out = out.withColumn("sleeve", F.when(F.col("eligible"), size_tier(F.col("mktcap"), F.col("__cut0"), F.col("__cut1"))).otherwise("small"))
    flow = F.when(F.col("sleeve").isin("large", "mid"), row_mean(F.col("__adv"), F.col("__sponsor"))).otherwise(F.col("__adv"))
    out = out.withColumn("rank_flow", fill_missing(flow, F.col("flow_failed")))
    out = out.withColumns({f"rank_{n}": fill_missing(F.col(f"__{n}"), F.col(f"{n}_failed")) for n in inside})
    parts = ["rank_trend", "rank_flow", "rank_earnings", "rank_quality"]
    if with_issuance:
        out = out.withColumn("rank_issuance", fill_missing(F.col("__issuance")))
        parts.append("rank_issuance")
    out = out.withColumn("bonus", volume_bonus(F.col("rank_volume"), F.col("rank_trend"), bucket))
    out = out.withColumn("penalty", pump_penalty(F.col("rank_turnover"), F.col("ret5")))
    score = row_mean(*map(F.col, parts)) + clamp(F.col("bonus"), 0, BONUS_CAP) - F.greatest(F.lit(0.0), F.col("penalty"))
    return out.withColumn("score", F.when(F.col("eligible"), F.round(score, 8))).withColumn("bucket", F.lit(bucket)).drop("__cut0", "__cut1", "__adv", "__sponsor", "__issuance", "__earnings", "__quality", *trends)


def legacy_scores(stocks: DataFrame) -> DataFrame:
    """sel, bucket, ticker, mktcap, score, label: weighted z-scores; label is the largest contribution, the first of ties."""
    norm = stocks.select(
        "sel", "ticker", "mktcap",
        z_to_score(F.col("trend_ma"), "sel").alias("trend"), z_to_score(F.col("vol_ratio"), "sel").alias("volume"),
        z_to_score(F.col("flow60"), "sel").alias("flow"), z_to_score(F.col("sigma59"), "sel", inverted=True).alias("volatility"),
    )
    out = None
    for bucket, weights in LEGACY_WEIGHTS.items():
        parts = {k: w * F.col(k) for k, w in weights.items()}
        best = F.greatest(*[F.round(c, 8) for c in parts.values()])
        label = F.coalesce(*[F.when(F.round(c, 8) == best, F.lit(k)) for k, c in parts.items()])
        one = norm.select("sel", F.lit(bucket).alias("bucket"), "ticker", "mktcap", F.round(sum(parts.values(), F.lit(0.0)), 8).alias("score"), label.alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def chart_scores(rows: DataFrame, factors: list[str], *group: str) -> DataFrame:
    """rows with score: the mean of the factors' ranks, 50 where a factor is missing."""
    out = with_ranks(rows, {f"rank_{f}": F.col(f).cast("double") for f in factors}, *group)
    return out.withColumn("score", F.round(row_mean(*[fill_missing(F.col(f"rank_{f}")) for f in factors]), 8))


def weighted_scores(ranks: DataFrame, factors: list[str], priors: dict[str, float]) -> DataFrame:
    """rows with score: ranks weighted by their prior mean correlation, not under 0; equal weights if none is above 0."""
    weights = {f: max(0.0, priors.get(f, 0.0)) for f in factors}
    if not any(weights.values()):
        weights = dict.fromkeys(factors, 1.0)
    total = sum((w * F.coalesce(F.col(f), F.lit(NEUTRAL)) for f, w in weights.items()), F.lit(0.0))
    return ranks.withColumn("score", F.round(total / sum(weights.values()), 8))
