"""Panels and judges: which tickers are debated again, which go to a second judge, and whether two judges disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.ranks import global_rank

# Fixed values.
FRAMES = ("short", "mid", "long")
ACTIVE = {"short": ("short",), "midlong": ("mid", "long")}
PLACE, WINDOW, TOP_SHARE, JUDGE_WINDOW, DELTA = 10, 5, 0.2, 2, 15.0


def weighted(votes: DataFrame) -> DataFrame:
    """ticker and the weighted mean score of each timeframe of votes(ticker, persona, weight, short, mid, long); 0 without weight."""
    mean = lambda f: F.round(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col(f)), F.sum("weight")), F.lit(0.0)), 8)
    return votes.groupBy("ticker").agg(*[mean(f).alias(f) for f in FRAMES])


def best_frame(frames: tuple[str, ...], of: str = "") -> Column:
    """The name of the timeframe with the largest score; of ties the first."""
    col = lambda f: F.col(f"{of}{f}")
    best = F.greatest(*[col(f) for f in frames]) if len(frames) > 1 else col(frames[0])
    return F.coalesce(*[F.when(col(f) == best, F.lit(f)) for f in frames])


def boundary(scores: DataFrame, frames: tuple[str, ...], window: int = WINDOW, place: int = PLACE) -> DataFrame:
    """Distinct tickers of scores(ticker, <frames>) within the window around the last place that is taken, in any timeframe."""
    near = [global_rank(scores.select("ticker", f), "__place", F.desc(f), "ticker").filter(F.col("__place").between(place - window + 1, place + window)).select("ticker") for f in frames]
    return reduce(DataFrame.union, near).distinct()


def debate_targets(votes: DataFrame, track: str, window: int = WINDOW, share: float = TOP_SHARE) -> DataFrame:
    """Tickers to debate again: near the boundary of an active timeframe, or in the share that the panel differs over most.

    The spread is that of the panel's scores in the ticker's best active
    timeframe; a panel that agrees wholly has none and isn't asked again. The
    share is of all tickers that have a panel.
    """
    frames = ACTIVE[track]
    means = weighted(votes)
    favourite = means.select("ticker", best_frame(frames).alias("__f"))
    own = F.coalesce(*[F.when(F.col("__f") == f, F.col(f)) for f in frames])
    spread = votes.join(favourite, "ticker").groupBy("ticker").agg(F.round(F.stddev_pop(own), 8).alias("spread"))
    ranked = global_rank(spread, "__place", F.desc("spread"), "ticker")
    differ = ranked.filter((F.col("spread") > 0) & (F.col("__place") <= F.ceil(F.col("n") * share))).select("ticker")
    return boundary(means, frames, window).union(differ).distinct()


def disagreement(first: DataFrame, second: DataFrame, delta: float = DELTA) -> DataFrame:
    """ticker, first_frame, second_frame, gap, differ of the tickers that both judges score(ticker, short, mid, long).

    They differ if their best timeframes do, or if their scores in the first
    judge's best one are more than delta apart. The first judge's scores stand.
    """
    named = lambda d, p: d.select("ticker", *[F.col(f).alias(f"{p}{f}") for f in FRAMES])
    both = named(first, "a_").join(named(second, "b_"), "ticker").withColumns({"first_frame": best_frame(FRAMES, "a_"), "second_frame": best_frame(FRAMES, "b_")})
    gap = F.coalesce(*[F.when(F.col("first_frame") == f, F.abs(F.col(f"a_{f}") - F.col(f"b_{f}"))) for f in FRAMES])
    out = both.withColumn("gap", F.round(gap, 8))
    return out.select("ticker", "first_frame", "second_frame", "gap", ((F.col("first_frame") != F.col("second_frame")) | (F.col("gap") > delta)).alias("differ"))
