"""Extracts of selections: JSON documents of nested rows, read as VARIANT and held against rules before anything is made of them.

A level of the nesting is a table (``variant_explode``), so rules across rows (a
repeated arm, a count, a value that all arms share) are windows and groups. Each
rule that a row breaks gives the path of the field and what is wrong with it; the
first of a document, in reading order, is its problem. Typed rows come from
documents without any, and ``require`` ends the job at the first problem.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BASELINE, HARD_GATE = "production-snapshot", "candidate-pool-hard-gate"
ARMS = (BASELINE, "sector-soft-reserve", "regime-sector-soft-reserve", HARD_GATE)
MIRROR, MIRROR_GATE = "production-mirror", "sector-hard-gate"
MIRROR_ARMS = (MIRROR, "sector-soft-tilt", MIRROR_GATE)
BUCKETS = ("short", "mid", "long")
ACTIVE = {"short": ("short",), "midlong": ("mid", "long")}
STATUSES = ("logged", "invalid_input", "incomplete_run")
SOURCES = ("absent", "manual_pre_registered")
SECTORS = ("바이오", "반도체", "건설", "금융", "2차전지", "자동차", "IT/SW", "유통/소비재", "에너지", "엔터/미디어", "통신", "철강/소재", "운송/물류", "보험/증권")
PICKS, GATE_LEAST = 10, 150


class ExtractError(ValueError):
    """A document breaks a rule."""


@dataclass(frozen=True)
class Field:
    """kind: text, name (text that isn't empty), day (ISO date or timestamp), whole (not under 0), number, list, texts (a list of text) or object."""

    name: str
    kind: str
    null: bool = False
    among: tuple[str, ...] = ()
    like: str = ""


KINDS = {"STRING": "text", "BIGINT": "whole", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "flag", "ARRAY": "list", "OBJECT": "object", "VOID": "null"}


def kind_of(v: Column) -> Column:
    """text, whole, number, flag, list, object or null; SQL null for a value that isn't there."""
    named = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(named, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column, name: str) -> Column:
    """The value of a text; null for anything else."""
    return F.when(kind_of(at(v, name)) == "text", F.try_variant_get(v, f"$.{name}", "string"))


def number(v: Column, name: str) -> Column:
    return F.when(kind_of(at(v, name)).isin("whole", "number"), F.try_variant_get(v, f"$.{name}", "double"))


def items(v: Column, name: str) -> Column:
    """array<variant> of a list; null for anything else."""
    return F.when(kind_of(at(v, name)) == "list", F.try_variant_get(v, f"$.{name}", "array<variant>"))


def texts(v: Column, name: str) -> Column:
    """array<string> of a list; what isn't text is null."""
    return F.transform(items(v, name), lambda x: F.when(kind_of(x) == "text", F.try_variant_get(x, "$", "string")))


def day(value: Column) -> Column:
    """The date of an ISO date or timestamp; null if it is neither."""
    plain = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
    return F.coalesce(plain, F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), value.try_cast("timestamp")).cast("date"))


def first_true(flags: Column) -> Column:
    """Index, from 0, of the first true in an array; null without one."""
    place = F.array_position(flags, F.lit(True))
    return F.when(place > 0, place - 1)


Rule = tuple[Column, Column | str, Column | str]


def rule(bad: Column, path: Column | str, message: Column | str) -> Rule:
    return bad, path, message


def field_rules(v: Column, f: Field) -> list[Rule]:
    """The rules of a field of the object v, as (bad, path below v, message)."""
    value, kind, path = at(v, f.name), kind_of(at(v, f.name)), f".{f.name}"
    wanted = {"text": ["text"], "name": ["text"], "day": ["text"], "whole": ["whole"], "number": ["whole", "number"], "list": ["list"], "texts": ["list"], "object": ["object"]}[f.kind]
    out = [rule(value.isNull(), path, "is missing"), rule(~kind.isin(*wanted, *(["null"] if f.null else [])), path, F.concat(F.lit(f"must be {f.kind}, is "), kind))]
    said = text(v, f.name)
    if f.kind in ("name", "day"):
        out.append(rule(said == "", path, "must not be empty"))
    if f.kind == "day":
        out.append(rule(said.isNotNull() & day(said).isNull(), path, "must be an ISO date or timestamp"))
    if f.kind == "whole":
        out.append(rule(number(v, f.name) < 0, path, "must not be under 0"))
    if f.kind == "texts":
        wrong = first_true(F.transform(items(v, f.name), lambda x: kind_of(x) != "text"))
        out.append(rule(wrong.isNotNull(), F.concat(F.lit(f"{path}["), wrong.cast("string"), F.lit("]")), "must be text"))
    if f.among:
        out.append(rule(~said.isin(*f.among), path, F.concat(F.lit("is not known: "), said)))
    if f.like:
        out.append(rule(~said.rlike(f.like), path, F.concat(F.lit("has a bad form: "), said)))
    return out


def first_problem(path: Column | str, rules: list[Rule]) -> Column:
    """struct(path, problem) of the first rule that a row breaks, else null; unknown conditions hold."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.concat(lit(path), lit(below)).alias("path"), lit(message).alias("problem"))) for bad, below, message in rules])


def _exploded(rows: DataFrame, value: Column, at_col: str, v_col: str) -> DataFrame:
    """rows once for each element of a variant list, with its place and value."""
    spark = rows.sparkSession
    out = rows.withColumn("__list", F.when(kind_of(value) == "list", value))
    return out.lateralJoin(spark.tvf.variant_explode(F.col("__list").outer())).withColumnRenamed("pos", at_col).withColumnRenamed("value", v_col).drop("key", "__list")


def periods(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """doc, v (the parsed document; null for text that isn't JSON), p and period of each element of the document's list."""
    parsed = docs.select(F.col(id_col).alias("doc"), F.col(json_col).alias("__json"), F.try_parse_json(json_col).alias("v"))
    return _exploded(parsed, F.col("v"), "p", "period")


def _place(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


#: In reading order: (period, part of the period, row, part of the row, element).
ORDER = 5


def _found(rows: DataFrame, problem: Column, *order: Column | int) -> DataFrame:
    key = [F.lit(x) if isinstance(x, int) else F.coalesce(x, F.lit(-1)) for x in order]
    key += [F.lit(0)] * (ORDER - len(key))
    return rows.select("doc", F.array(*[k.cast("int") for k in key]).alias("order"), problem.alias("r")).filter("r IS NOT NULL").select("doc", "order", "r.*")


def _document_rules(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    parsed = docs.select(F.col(id_col).alias("doc"), F.try_parse_json(json_col).alias("v"))
    rules = [rule(F.col("v").isNull(), "", "is not JSON"), rule(kind_of(F.col("v")) != "list", "", F.concat(F.lit("must be list, is "), kind_of(F.col("v"))))]
    return _found(parsed, first_problem("$", rules), -2)


def _first(problems: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, problems)
    return every.groupBy("doc").agg(F.min(F.struct("order", "path", "problem")).alias("f")).select("doc", "f.path", "f.problem")


# Arm extracts


ARM_KEY = r"^(s:\d{4}-\d{2}-\d{2}|m:\d{4}-\d{2})$"


def track_of(key: Column) -> Column:
    return F.when(key.startswith("s:"), "short").when(key.startswith("m:"), "midlong")


@dataclass(frozen=True)
class Levels:
    """Tables of a set of documents, one for each level, and the first problem of each document that has one."""

    tables: dict[str, DataFrame]
    problems: DataFrame


def arm_extracts(docs: DataFrame, id_col: str = "doc", json_col: str = "json", picks: int = PICKS, sectors: tuple[str, ...] = SECTORS, settle: Callable[[DataFrame], DataFrame] = lambda d: d) -> Levels:
    """Documents that list periods of arms of picks: tables ``periods``, ``arms`` and ``picks`` of those without a problem.

    periods: doc, period_key, track, selection_date, sector_source, leading,
    sector_as_of, regime_source, regime_stage, regime_as_of, run_dates. arms: doc,
    period_key, arm, status, cut. picks: doc, period_key, arm, timeframe, place,
    ticker, weighted_score, sector, assigned_by. An empty list has no rows.
    ``settle`` may cut the lineage of the exploded levels.
    """
    at_period = _place("$[", F.col("p"), "]")
    per = settle(periods(docs, id_col, json_col).filter("p IS NOT NULL").withColumn("period_key", text(F.col("period"), "period_key")))
    again = F.row_number().over(Window.partitionBy("doc", "period_key").orderBy("p"))
    per = per.withColumn("track", track_of(F.col("period_key"))).withColumn("again", F.when(F.col("period_key").isNotNull(), again))
    v = F.col("period")
    rules = [rule(kind_of(v) != "object", "", F.concat(F.lit("must be object, is "), kind_of(v))), *field_rules(v, Field("period_key", "text", like=ARM_KEY)), *field_rules(v, Field("arms", "list")), rule(F.col("again") > 1, ".period_key", "is repeated")]
    problems = [_document_rules(docs, id_col, json_col), _found(per, first_problem(at_period, rules), F.col("p"), -1)]

    arms = _exploded(per.drop("again", "v", "__json"), at(v, "arms"), "a", "row").filter("a IS NOT NULL")
    r = F.col("row")
    sv, rc = at(r, "sector_view"), at(r, "regime_context")
    arms = settle(arms.withColumns({"arm": text(r, "arm"), "status": text(r, "status"), "sector_source": text(sv, "source"), "leading": texts(sv, "leadingSectors"), "sector_as_of": day(text(sv, "asOf")), "cut": texts(r, "counterfactual_cut"), "regime_source": text(rc, "source"), "regime_stage": text(rc, "stage"), "regime_as_of": day(text(rc, "asOf"))}))
    arms = arms.withColumn("again", F.when(F.col("arm").isNotNull(), F.row_number().over(Window.partitionBy("doc", "p", "arm").orderBy("a"))))
    manual = F.col("sector_source") == "manual_pre_registered"
    regime_manual = F.col("regime_source") == "manual_pre_registered"
    at_arm = F.concat(at_period, _place(".arms[", F.col("a"), "]"))

    # Picks of all arms, and how many each timeframe of an arm has.
    pick = settle(_exploded(arms.select("doc", "p", "a", "period_key", "track", "arm", "status", "row"), at(r, "selected"), "i", "pick").filter("i IS NOT NULL").drop("row"))
    k = F.col("pick")
    pick = pick.withColumns({"ticker": text(k, "ticker"), "timeframe": text(k, "assigned_timeframe"), "weighted_score": number(k, "weighted_score"), "sector": text(k, "sector"), "assigned_by": text(k, "assigned_by")})
    pick = pick.withColumn("again", F.when(F.col("ticker").isNotNull(), F.row_number().over(Window.partitionBy("doc", "p", "a", "ticker").orderBy("i"))))
    active = reduce(lambda c, x: c.when(F.col("track") == x[0], F.col("timeframe").isin(*x[1])), ACTIVE.items(), F.when(F.lit(False), True))
    pick_rules = [
        rule(kind_of(k) != "object", "", F.concat(F.lit("must be object, is "), kind_of(k))), *field_rules(k, Field("ticker", "text", like=r"^\d{6}$")), *field_rules(k, Field("assigned_timeframe", "text", among=BUCKETS)),
        rule(~active, ".assigned_timeframe", F.concat(F.col("timeframe"), F.lit(" is not active in "), F.col("track"))),
        *field_rules(k, Field("assigned_by", "text", among=("primary", "backfill", "reserve"))), *field_rules(k, Field("weighted_score", "number")),
        *field_rules(k, Field("sector", "text", null=True, among=sectors)), rule(F.col("again") > 1, ".ticker", F.concat(F.lit("is repeated: "), F.col("ticker"))),
    ]
    problems.append(_found(pick, first_problem(F.concat(at_arm, _place(".selected[", F.col("i"), "]")), pick_rules), F.col("p"), 0, F.col("a"), 1, F.col("i")))
    counts = pick.groupBy("doc", "p", "a").agg(*[F.count_if(F.col("timeframe") == b).alias(f"n_{b}") for b in BUCKETS])
    arms = arms.join(counts, ["doc", "p", "a"], "left").fillna(0, [f"n_{b}" for b in BUCKETS])
    head = [
        rule(kind_of(r) != "object", "", F.concat(F.lit("must be object, is "), kind_of(r))), *field_rules(r, Field("arm", "text", among=ARMS)), rule(F.col("again") > 1, ".arm", F.concat(F.lit("is repeated: "), F.col("arm"))),
        *field_rules(r, Field("track", "text")), rule(text(r, "track") != F.col("track"), ".track", F.concat(text(r, "track"), F.lit(" is not the period's: "), F.col("track"))), *field_rules(r, Field("status", "text", among=STATUSES)),
        *field_rules(r, Field("selected", "list")),
    ]
    short = [
        rule((F.col("status") == "logged") & (F.col("track") == t) & (F.col(f"n_{b}") != picks), ".selected", F.concat(F.lit(f"{b} has "), F.col(f"n_{b}").cast("string"), F.lit(f" picks, expected {picks}")))
        for t, active_in in ACTIVE.items() for b in active_in
    ]
    under = lambda path, rules: [(bad, F.concat(F.lit(path), F.lit(p) if isinstance(p, str) else p), m) for bad, p, m in rules]
    unknown = first_true(F.transform("leading", lambda x: ~x.isin(*sectors)))
    bad_cut, twice = first_true(F.transform("cut", lambda x: ~x.rlike(r"^\d{6}$"))), first_true(F.transform("cut", lambda x, i: F.array_contains(F.slice("cut", 1, i), x)))
    tail = [
        *field_rules(r, Field("sector_view", "object")), *under(".sector_view", field_rules(sv, Field("source", "text", among=SOURCES))), *under(".sector_view", field_rules(sv, Field("leadingSectors", "texts"))),
        rule(unknown.isNotNull(), _place(".sector_view.leadingSectors[", unknown, "]"), "is not known"),
        *under(".sector_view", [(at(sv, "asOf").isNotNull() & bad, p, m) for bad, p, m in field_rules(sv, Field("asOf", "day", null=True))]),
        rule((F.col("sector_source") == "absent") & (F.size("leading") > 0), ".sector_view.leadingSectors", "must be empty without a source"),
        rule(manual & (F.size("leading") == 0), ".sector_view.leadingSectors", "must not be empty with a source"), rule(manual & F.col("sector_as_of").isNull(), ".sector_view.asOf", "is missing"),
        *field_rules(r, Field("counterfactual_cut", "texts", null=True)), rule(bad_cut.isNotNull(), _place(".counterfactual_cut[", bad_cut, "]"), "has a bad form"),
        rule(twice.isNotNull(), _place(".counterfactual_cut[", twice, "]"), "is repeated"), rule((F.size("cut") > 0) & (F.col("arm") != HARD_GATE), ".counterfactual_cut", "is only for the hard gate"),
        *[(rc.isNotNull() & bad, p, m) for bad, p, m in field_rules(r, Field("regime_context", "object", null=True))],
        *[((kind_of(rc) == "object") & bad, p, m) for bad, p, m in under(".regime_context", field_rules(rc, Field("source", "text", among=SOURCES)))],
        *[(regime_manual & bad, p, m) for bad, p, m in under(".regime_context", field_rules(rc, Field("stage", "text", among=("bear", "sideways", "bull"))) + field_rules(rc, Field("asOf", "day")))],
        *[((F.col("status") == "logged") & bad, p, m) for bad, p, m in field_rules(r, Field("run_date", "day"))],
    ]
    problems += [_found(arms, first_problem(at_arm, rules), F.col("p"), 0, F.col("a"), step) for step, rules in ((0, head), (2, short), (3, tail))]

    # What all arms of a period share.
    run_day = F.when(F.col("status") == "logged", day(text(r, "run_date")))
    shared = arms.groupBy("doc", "p", "period_key", "track").agg(
        F.collect_set(F.when(manual, F.struct("leading", "sector_as_of"))).alias("views"), F.collect_set(F.when(regime_manual, F.struct("regime_stage", "regime_as_of"))).alias("regimes"), F.array_sort(F.collect_set(run_day)).alias("run_dates"),
    )
    across = [rule(F.size("views") > 1, ".arms", "sector_view differs between arms"), rule(F.size("regimes") > 1, ".arms", "regime_context differs between arms")]
    problems.append(_found(shared, first_problem(at_period, across), F.col("p"), 1))
    first = settle(_first(problems))

    clean = lambda d: d.join(first.select("doc"), "doc", "left_anti")
    every = per.select("doc", "p", "period_key", "track").join(shared.drop("period_key", "track"), ["doc", "p"], "left")
    source = lambda c: F.when(F.size(c) > 0, "manual_pre_registered").otherwise("absent")
    anchor = F.when(F.col("track") == "short", F.substring("period_key", 3, 10)).otherwise(F.concat(F.substring("period_key", 3, 7), F.lit("-01"))).try_cast("date")
    tables = {
        "periods": clean(every).select(
            "doc", "period_key", "track", anchor.alias("selection_date"), source("views").alias("sector_source"), F.get("views", F.lit(0))["leading"].alias("leading"), F.get("views", F.lit(0))["sector_as_of"].alias("sector_as_of"),
            source("regimes").alias("regime_source"), F.get("regimes", F.lit(0))["regime_stage"].alias("regime_stage"), F.get("regimes", F.lit(0))["regime_as_of"].alias("regime_as_of"), "run_dates",
        ),
        "arms": clean(arms).select("doc", "period_key", "arm", "status", "sector_source", F.coalesce("cut", F.array().cast("array<string>")).alias("cut")),
        "picks": clean(pick).select("doc", "period_key", "arm", "timeframe", F.col("i").alias("place"), "ticker", "weighted_score", "sector", "assigned_by"),
    }
    return Levels(tables, first)


# Mirror extracts


MIRROR_KEY = r"^(\d{4}-\d{2}|\d{4}-W\d{2})$"


def mirror_extracts(docs: DataFrame, id_col: str = "doc", json_col: str = "json", settle: Callable[[DataFrame], DataFrame] = lambda d: d) -> Levels:
    """Documents that list periods with candidates of arms, the snapshot and the hypothesis: tables ``periods``, ``arms`` and ``scores`` of those without a problem.

    periods: doc, period_key, run_id, run_date, universe_size, universe_hash,
    source, as_of, selection_as_of. arms: doc, period_key, arm, bucket, ticker of
    logged candidates. scores: doc, period_key, bucket, ticker, score of the snapshot.
    """
    at_period = _place("$[", F.col("p"), "]")
    per = settle(periods(docs, id_col, json_col).filter("p IS NOT NULL").withColumns({"period_key": text(F.col("period"), "period_key"), "run_id": text(F.col("period"), "run_id")}))
    per = per.withColumn("again", F.when(F.col("period_key").isNotNull(), F.row_number().over(Window.partitionBy("doc", "period_key").orderBy("p"))))
    v, runs = F.col("period"), number(F.col("period"), "run_id_count")
    rules = [
        rule(kind_of(v) != "object", "", F.concat(F.lit("must be object, is "), kind_of(v))), *field_rules(v, Field("period_key", "text", like=MIRROR_KEY)), *field_rules(v, Field("run_id", "name", null=True)), *field_rules(v, Field("run_id_count", "whole", null=True)),
        rule((kind_of(at(v, "run_id")) == "null") & (runs > 0), ".run_id_count", "counts runs without a run_id"), rule(F.col("run_id").isNotNull() & ~F.coalesce(runs == 1, F.lit(False)), ".run_id_count", "must be 1"),
        *[x for n in ("candidates", "snapshot", "hypothesis") for x in field_rules(v, Field(n, "list"))], rule(F.col("again") > 1, ".period_key", "is repeated"),
    ]
    problems = [_document_rules(docs, id_col, json_col), _found(per, first_problem(at_period, rules), F.col("p"), -1)]
    keys = per.select("doc", "p", "period_key", "run_id", "period")
    r = F.col("row")

    def level(name: str, step: int, made: dict[str, Column], rules: list[Rule]) -> DataFrame:
        rows = settle(_exploded(keys, at(F.col("period"), name), "i", "row").filter("i IS NOT NULL").drop("period").withColumns(made))
        checks = [rule(kind_of(r) != "object", "", F.concat(F.lit("must be object, is "), kind_of(r))), *rules]
        problems.append(_found(rows, first_problem(F.concat(at_period, _place(f".{name}[", F.col("i"), "]")), checks), F.col("p"), step, F.col("i")))
        return rows

    of = lambda *fields: [x for f in fields for x in field_rules(r, f)]
    same_run = rule(~F.col("row_run").eqNullSafe(F.col("run_id")), ".run_id", "is not the period's")
    kept = {"ticker": text(r, "ticker"), "bucket": text(r, "bucket"), "row_run": text(r, "run_id"), "hash": text(r, "universe_hash"), "size": number(r, "universe_size").cast("long"), "score": number(r, "tier0_score")}
    common = [Field("universe_hash", "text"), Field("universe_size", "whole"), Field("tier0_score", "number", null=True)]
    snaps = level("snapshot", 0, kept | {"run_date": day(text(r, "run_date"))}, [*of(Field("ticker", "text"), Field("bucket", "text", among=BUCKETS), Field("run_id", "text")), same_run, *of(*common, Field("run_date", "day"))])
    sv, gate = at(r, "sector_view"), number(r, "gate_eligible_size")
    below = [(bad, F.concat(F.lit(".sector_view"), F.lit(p) if isinstance(p, str) else p), m) for bad, p, m in field_rules(sv, Field("source", "text"))]
    cands = level("candidates", 1, kept | {"arm": text(r, "arm"), "status": text(r, "status"), "source": text(sv, "source")}, [
        *of(Field("arm", "text", among=MIRROR_ARMS), Field("status", "text", among=STATUSES), Field("ticker", "text"), Field("bucket", "text", among=BUCKETS), Field("run_id", "text")), same_run,
        *of(Field("rank", "whole"), *common, Field("gate_eligible_size", "whole", null=True), Field("sector_view", "object")), *below, *of(Field("counterfactual_cut", "texts", null=True)),
        rule((F.col("arm") == MIRROR_GATE) & (F.col("status") == "logged") & ~F.coalesce(gate >= GATE_LEAST, F.lit(False)), ".gate_eligible_size", f"must be at least {GATE_LEAST}"),
    ])
    made = {"source": text(r, "source"), "sectors": texts(r, "leading_sectors"), "as_of": day(text(r, "as_of")), "selection_as_of": day(text(r, "selection_as_of")), "hypothesis_hash": text(r, "hypothesis_hash")}
    hyps = level("hypothesis", 2, made, of(Field("source", "name"), Field("leading_sectors", "texts"), Field("as_of", "day"), Field("selection_as_of", "day"), Field("hypothesis_hash", "name")))

    # What rows of an arm, and arms of a period, share.
    in_arm = cands.groupBy("doc", "p", "arm").agg(F.count_distinct("hash", "size").alias("universes"), F.count_distinct("source").alias("sources"))
    arm_rules = [rule(F.col("universes") > 1, ".candidates", F.concat(F.lit("universe differs within "), F.col("arm"))), rule(F.col("sources") > 1, ".candidates", F.concat(F.lit("sector_view.source differs within "), F.col("arm")))]
    problems.append(_found(in_arm, first_problem(at_period, arm_rules), F.col("p"), 3))
    hashes = cands.select("doc", "p", "hash").union(snaps.select("doc", "p", "hash")).groupBy("doc", "p").agg(F.count_distinct("hash").alias("hashes"))
    snap = snaps.groupBy("doc", "p").agg(F.count_distinct("size").alias("sizes"), F.count_distinct("run_date").alias("dates"), F.max("size").alias("snap_size"), F.min("hash").alias("snap_hash"), F.min("run_date").alias("run_date"))
    mirror = cands.filter(F.col("arm") == MIRROR).groupBy("doc", "p").agg(F.min("size").alias("mirror_size"), F.min("hash").alias("mirror_hash"))
    hyp = hyps.groupBy("doc", "p").agg(F.collect_set(F.struct(*made)).alias("hypotheses"))
    whole = reduce(lambda a, b: a.join(b, ["doc", "p"], "left"), (hashes, snap, mirror, hyp), per.select("doc", "p", "period_key", "run_id"))
    across = [
        rule(F.size("hypotheses") > 1, ".hypothesis", "rows differ"), rule(F.col("hashes") > 1, "", "universe_hash differs between arms"),
        rule(F.col("sizes") > 1, ".snapshot", "universe_size differs"), rule(F.col("dates") > 1, ".snapshot", "run_date differs"),
    ]
    problems.append(_found(whole, first_problem(at_period, across), F.col("p"), 4))
    first = settle(_first(problems))
    clean = lambda d: d.join(first.select("doc"), "doc", "left_anti")
    h = F.get("hypotheses", F.lit(0))
    tables = {
        "periods": clean(whole).select(
            "doc", "period_key", "run_id", "run_date", F.coalesce("mirror_size", "snap_size", F.lit(0)).alias("universe_size"), F.coalesce("mirror_hash", "snap_hash", F.lit("")).alias("universe_hash"),
            h["source"].alias("source"), h["as_of"].alias("as_of"), h["selection_as_of"].alias("selection_as_of"),
        ),
        "arms": clean(cands).filter("status = 'logged'").select("doc", "period_key", "arm", "bucket", "ticker").distinct(),
        "scores": clean(snaps).filter("score IS NOT NULL").select("doc", "period_key", "bucket", "ticker", "score"),
    }
    return Levels(tables, first)


def require(levels: Levels) -> dict[str, DataFrame]:
    """The tables, if no document has a problem; else an ExtractError with the first document's path."""
    found = levels.problems.orderBy("doc").first()
    if found is not None:
        raise ExtractError(f"{found.doc}: {found.path} {found.problem}")
    return levels.tables
