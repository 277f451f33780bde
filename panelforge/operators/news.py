"""News against a universe of instruments: whose names a text has, what a panel judges, and what follows for the run.

Nothing here asks a model: a panel's answers come as text and are read strictly;
an answer that breaks the form is no vote, but the panel keeps its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEVELS = ("low", "medium", "high")
SCOPES = ("company", "sector", "market", "unknown")
SEVERITIES = ("critical", "warning", "info")
DIRECT = ("direct", "indirect")
MOST_REMOVED, KEPT, CONCENTRATED = 3, 0.7, 10
LIST_FLOORS = {"short": 7, "midlong": 14, "full": 21}

JUDGMENT = "struct<scope:string,severity:string,confidence:string,materiality:string,directness:string,thesis_break:boolean,thesis_break_reason:string,affected_tickers:array<string>>"


def words(text: Column) -> Column:
    """The words of a text, lower-cased, each between spaces: runs of letters and digits of any script."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def mentions(news: DataFrame, names: DataFrame, id_col: str, text_col: str, small: int = 50_000) -> DataFrame:
    """(id, ticker), once each: whose names stand in a text as whole words, one after the other.

    names: ticker, name; a ticker may have several, and names may overlap. Up to
    small names become one automaton for each task; more are found by a join on
    their first words. A name without words and a null name match nothing.
    """
    named = names.select("ticker", words(F.col("name")).alias("name")).filter("trim(name) <> ''").distinct()
    rows = news.select(F.col(id_col), words(F.col(text_col)).alias("__text"))
    held = named.limit(small + 1).collect()
    return _by_automaton(rows, held, named, id_col) if len(held) <= small else by_first_word(rows, named, id_col)


def _by_automaton(rows: DataFrame, held: list, named: DataFrame, id_col: str) -> DataFrame:
    tickers = sorted({r["name"] for r in held})

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for i, name in enumerate(tickers):
            automaton.add_word(name, i)
        automaton.make_automaton()
        for part in texts:
            yield part.map(lambda t: sorted({i for _, i in automaton.iter(t)}) if tickers else [])

    places = F.pandas_udf(run, "array<int>")
    numbered = rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(tickers)], "place int, name string")
    found = rows.select(id_col, F.explode(places("__text")).alias("place"))
    # As many rows as held names.
    return found.join(F.broadcast(numbered.join(named, "name").select("place", "ticker")), "place").select(id_col, "ticker").distinct()


def by_first_word(rows: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    """(id, ticker) of rows(id, __text): distinct words of a text are joined to the first words of names; names of more words are then looked for in the text."""
    parts = named.withColumn("first", F.split(F.trim("name"), " ")[0]).withColumn("more", F.instr(F.trim("name"), " ") > 0)
    each = rows.select(id_col, F.explode(F.array_distinct(F.split(F.trim("__text"), " "))).alias("first"))
    pairs = each.join(parts, "first").select(id_col, "ticker", "name", "more")
    one = pairs.filter(~F.col("more")).select(id_col, "ticker")
    several = pairs.filter("more").join(rows, id_col).filter(F.contains("__text", F.col("name"))).select(id_col, "ticker")
    return one.union(several).distinct()


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with value computed once a row: a column that is named in many places would be computed in each."""
    return F.transform(F.array(value), made)[0]


def judgment(content: Column) -> Column:
    """The struct of an answer: its outermost braces as JSON, with every field there and of its kind; null if not.

    An answer is first read leniently, which finds all that strict reading finds.
    What lacks a known word or a field there is no judgment. What is, written again,
    the very same text was JSON with all fields, once each and of their kinds; only
    other texts (spaces, another order, more fields) are read strictly.
    """
    text = F.regexp_extract(content, r"(?s)(\{.*\})", 1)

    def checked(read: Column) -> Column:
        words = [read["scope"].isin(*SCOPES), read["severity"].isin(*SEVERITIES), read["confidence"].isin(*LEVELS), read["materiality"].isin(*LEVELS), read["directness"].isin(*DIRECT)]
        known = reduce(lambda a, b: a & b, [*words, read["thesis_break"].isNotNull(), F.forall(read["affected_tickers"], lambda x: x.isNotNull())])
        same = F.to_json(read, {"ignoreNullFields": "false"}) == text
        return F.when(known & same, read).when(known, strictly(text))

    return F.when(text != "", bound(F.from_json(text, JUDGMENT, {"allowSingleQuotes": "false"}), checked))


def strictly(text: Column) -> Column:
    """The struct of a text that is JSON with every field of its kind; null if not. Fields of words are not looked at."""

    def strict(v: Column) -> Column:
        kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        listed = F.forall(F.try_variant_get(v, "$.affected_tickers", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        return F.when((kind("thesis_break") == "BOOLEAN") & kind("thesis_break_reason").isin("STRING", "VOID") & listed, F.try_variant_get(v, "$", JUDGMENT))

    return bound(F.try_parse_json(text), strict)


def most(*found: Column) -> Column:
    """The value of structs of (count, smallest persona, value) that counts most; of ties the one of the smallest persona."""
    return F.array_min(F.array(*[F.struct((-c["n"]).alias("n"), c["first"].alias("first"), c["v"].alias("v")) for c in found]))["v"]


def assessments(answers: DataFrame, panel: int, *news: str) -> DataFrame:
    """news, ticker and the panel's assessment of answers(news, ticker, persona, content).

    A majority is of the whole panel, also of those whose answer was no judgment;
    pairs without any judgment have no row. persona orders the votes for ties.
    """
    return agreed(answers.withColumn("j", judgment(F.col("content"))), panel, *news)


def agreed(votes: DataFrame, panel: int, *news: str) -> DataFrame:
    """What assessments gives, of votes(news, ticker, persona, j): j is an answer's judgment, null if it is none."""
    j = lambda name: F.col("j")[name]
    reason = F.when(j("thesis_break") & (j("thesis_break_reason") != ""), j("thesis_break_reason"))
    met = {
        **{f"__scope_{v}": j("scope") == v for v in SCOPES}, **{f"__severity_{v}": j("severity") == v for v in SEVERITIES},
        **{f"__{c}_{least}": j(c).isin(*LEVELS[least:]) for c in ("confidence", "materiality") for least in (1, 2)},
        "__direct": j("directness") == "direct", "__breaks": j("thesis_break"), "__affected": F.array_contains(j("affected_tickers"), F.col("ticker").cast("string")),
    }
    ranked = [c for c in met if c.startswith(("__scope_", "__severity_"))]
    # Counts by reason, then of all of them: sums of numbers, which need no lists of answers.
    counts = votes.withColumn("__reason", reason).groupBy(*news, "ticker", "__reason").agg(
        F.count("j").alias("votes"), F.min(F.when(F.col("j").isNotNull(), F.col("persona"))).alias("__first"), *[F.count_if(m).alias(c) for c, m in met.items()], *[F.min(F.when(met[c], F.col("persona"))).alias(f"{c}_first") for c in ranked],
    )
    by_reason = F.when(F.col("__reason").isNotNull(), F.struct((-F.col("votes")).alias("n"), F.col("__first").alias("first"), F.col("__reason").alias("v")))
    whole = counts.groupBy(*news, "ticker").agg(F.sum("votes").alias("votes"), *[F.sum(c).alias(c) for c in met], *[F.min(f"{c}_first").alias(f"{c}_first") for c in ranked], F.min(by_reason)["v"].alias("__reason")).filter("votes > 0")
    reach = lambda c: F.col(c) >= panel // 2 + 1
    level = lambda c: F.when(reach(f"__{c}_2"), "high").when(reach(f"__{c}_1"), "medium").otherwise("low")
    modal = lambda c, values: most(*[F.struct(F.col(f"__{c}_{v}").alias("n"), F.col(f"__{c}_{v}_first").alias("first"), F.lit(v).alias("v")) for v in values])
    return whole.select(
        *news, "ticker", F.col("votes").cast("int").alias("votes"), modal("scope", SCOPES).alias("scope"), modal("severity", SEVERITIES).alias("severity"), level("confidence").alias("confidence"), level("materiality").alias("materiality"),
        F.when(reach("__direct"), "direct").otherwise("indirect").alias("directness"), reach("__breaks").alias("thesis_break"), F.when(reach("__breaks"), F.col("__reason")).alias("reason"), reach("__affected").alias("affected"),
    )


def action() -> Column:
    """auto_remove if the thesis breaks, directly, materially, surely, and for this ticker; else alert_only."""
    met = F.col("thesis_break") & (F.col("directness") == "direct") & (F.col("materiality") == "high") & (F.col("confidence") == "high") & F.col("affected")
    return F.when(met, "auto_remove").otherwise("alert_only")


def on_surfaces(assessed: DataFrame, universe: DataFrame) -> DataFrame:
    """assessed once for each surface of its ticker: universe has ticker, track (null if not listed) and held; tickers of neither are left out."""
    surfaces = F.array_compact(F.array(F.when(F.col("track").isNotNull(), F.lit("list")), F.when(F.col("held"), F.lit("portfolio"))))
    return assessed.join(universe, "ticker").withColumn("surface", F.explode(surfaces)).withColumn("track", F.when(F.col("surface") == "list", F.col("track"))).drop("held")


def brakes(rows: DataFrame, sizes: dict[str, int], portfolio: int, *run: str) -> DataFrame:
    """run, candidates and reasons: why a run holds all its removals. rows: run, ticker, surface, track, action.

    Too many tickers; a list track, or the whole list, that would fall under its
    floor; a portfolio that would keep less than its share, or, if it is small,
    would lose two. A run without candidates never brakes.
    """
    out = rows.filter("action = 'auto_remove'")
    listed = lambda *tracks: F.count_if((F.col("surface") == "list") & F.col("track").isin(*tracks))
    facts = out.groupBy(*run).agg(
        F.count_distinct("ticker").alias("candidates"), listed("short").alias("short"), listed("midlong").alias("midlong"), listed("short", "midlong").alias("full"), F.count_if(F.col("surface") == "portfolio").alias("held"),
    )
    floor = F.lit(False)
    for t, least in LIST_FLOORS.items():
        floor = floor | (F.lit(sizes[t]) - F.col(t) < least)
    thin = F.lit(portfolio) - F.col("held") < F.ceil(F.lit(KEPT * portfolio)) if portfolio >= CONCENTRATED else F.col("held") >= 2
    reasons = F.array_compact(F.array(F.when(F.col("candidates") > MOST_REMOVED, F.lit("mass_removal")), F.when(floor, F.lit("list_track_floor")), F.when(thin, F.lit("portfolio_floor"))))
    return facts.select(*run, "candidates", reasons.alias("reasons"))


def ledger(rows: DataFrame, braked: DataFrame, prices: DataFrame | None, *run: str) -> DataFrame:
    """rows with recommended, taken, price and alert: what the run does with each.

    A braked run holds all its removals. With prices (ticker, price) removals are
    carried out at a known price and stay in the shadow without one; with None
    nothing is carried out.
    """
    known = rows.withColumn("price", F.lit(None).cast("double")) if prices is None else rows.join(prices, "ticker", "left")
    out = known.join(braked.select(*run, (F.size("reasons") > 0).alias("__held")), list(run), "left")
    removal, held = F.col("action") == "auto_remove", F.coalesce("__held", F.lit(False))
    taken = F.when(removal & held, "held_by_brake").when(removal & F.col("price").isNotNull(), "removed").otherwise("shadowed")
    out = out.withColumns({"recommended": F.when(removal & held, "hold_for_review").otherwise(F.col("action")), "taken": taken})
    alert = F.when(F.col("recommended") == "auto_remove", "news_critical").when(F.col("recommended") == "alert_only", "news_warning")
    return out.withColumns({"price": F.when(F.col("taken") == "removed", F.col("price")), "alert": alert}).drop("__held")
