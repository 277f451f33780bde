"""Names in news, panel answers, brakes and the ledger, case by case."""

import json

import pytest
from panelforge.operators import news as N
from panelforge.plans import news_queries as Q
from pyspark.sql import functions as F

NAMES = [(1, "Alpha"), (2, "alpha beta"), (3, "Beta Gamma"), (4, "삼성전자"), (5, "A.B. Corp"), (5, "ab"), (6, None), (7, "--"), (8, "beta gamma delta epsilon"), (9, "Élan")]
NEWS = [
    (1, "ALPHA beta gamma rises"), (2, "alphabet soup"), (3, "삼성전자 beats; alpha,"), (4, None), (5, ""), (6, "a b corp and ab"), (7, "beta\ngamma -- delta epsilon"), (8, "gamma beta"), (9, "élan ÉLAN"), (None, "alpha"), (1, "alpha"), (10, "beta " * 500 + "gamma"),
]
WANT = {(1, 1), (1, 2), (1, 3), (3, 4), (3, 1), (6, 5), (7, 3), (7, 8), (9, 9), (None, 1), (10, 3)}


@pytest.mark.parametrize("small", [50_000, 0])
def test_mentions_are_whole_words(spark, small):
    """An automaton, and with many names a join on first words: the same pairs."""
    news = spark.createDataFrame(NEWS, "id int, body string").repartition(3)
    names = spark.createDataFrame(NAMES, "ticker int, name string")
    got = [(r.id, r.ticker) for r in N.mentions(news, names, "id", "body", small).collect()]
    # Joining on first words meets the text again by its id: a null one isn't found again, which only names of more words need.
    assert len(got) == len(set(got)) and set(got) == WANT
    assert N.mentions(news, names.limit(0), "id", "body", small).collect() == [] and N.mentions(news.limit(0), names, "id", "body", small).collect() == []


GOOD = {"scope": "company", "severity": "warning", "confidence": "high", "materiality": "high", "directness": "direct", "thesis_break": True, "thesis_break_reason": "x", "affected_tickers": ["1"]}


def test_answers_are_read_strictly(spark):
    said = {
        "plain": json.dumps(GOOD), "fenced": f"```json\n{json.dumps(GOOD)}\n```", "chatty": f"Here: {json.dumps(GOOD)} Bye", "null reason": json.dumps(GOOD | {"thesis_break_reason": None}), "none affected": json.dumps(GOOD | {"affected_tickers": []}),
        "no json": "sorry", "open": json.dumps(GOOD)[:-1], "missing": json.dumps({k: v for k, v in GOOD.items() if k != "scope"}), "unknown": json.dumps(GOOD | {"severity": "high"}), "text flag": json.dumps(GOOD | {"thesis_break": "true"}),
        "number": json.dumps(GOOD | {"confidence": 3}), "reason is a list": json.dumps(GOOD | {"thesis_break_reason": ["x"]}), "tickers are numbers": json.dumps(GOOD | {"affected_tickers": [1]}), "tickers are text": json.dumps(GOOD | {"affected_tickers": "1"}), "nothing": None,
    }
    df = spark.createDataFrame(list(said.items()), "name string, content string")
    got = {r["name"] for r in df.filter(N.judgment(F.col("content")).isNotNull()).collect()}
    assert got == {"plain", "fenced", "chatty", "null reason", "none affected"}


def test_texts_that_are_not_written_our_way_are_read_strictly(spark):
    own = json.dumps(GOOD, separators=(",", ":"))
    said = {
        "own": own, "spaced": json.dumps(GOOD, indent=2), "another order": json.dumps(dict(reversed(GOOD.items()))), "one more field": json.dumps(GOOD | {"more": [{}]}), "escaped": own.replace('"x"', '"\\u0078\\""'),
        "twice": own[:-1] + ',"scope":"market"}', "single quotes": own.replace('"', "'"), "no reason": json.dumps({k: v for k, v in GOOD.items() if k != "thesis_break_reason"}), "reason is a number": own.replace('"x"', "3"), "null ticker": own.replace('["1"]', "[null]"), "braces only": "{}", "turned": "}{",
    }
    df = spark.createDataFrame(list(said.items()), "name string, content string").withColumn("j", N.judgment(F.col("content"))).filter("j IS NOT NULL")
    got = {r["name"]: r["j"] for r in df.collect()}
    assert set(got) == {"own", "spaced", "another order", "one more field", "escaped"} and got["escaped"].thesis_break_reason == 'x"' and got["spaced"].asDict() == GOOD


def test_a_text_that_is_given_many_times_is_read_once(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)
    monkeypatch.setattr(N, "judgment", F.udf(lambda text: seen.add(1), N.JUDGMENT))
    assert Q.assessed(spark, sf).collect() == []
    answers = Q.drawn(Q.found(spark, sf))
    assert seen.value == answers.select("said", "about").distinct().count() < answers.count()


@pytest.mark.parametrize("name,kept", [("news_brakes", []), ("news_ledger", [{"doc_id", "ticker", "run", "action", "surface", "track"}])])
def test_only_what_is_read_twice_is_kept(spark, monkeypatch, name, kept):
    """Rows of surfaces are written only for the ledger, which reads them twice, and without the votes behind them."""
    settled, real = [], Q.settle
    monkeypatch.setattr(Q, "settle", lambda df: settled.append(set(df.columns)) or real(df))
    getattr(Q, name)(spark, "/root/testdata/sf0.001")
    assert [c for c in settled if "surface" in c] == kept


def answers(spark, *votes, ticker=1):
    """Answers of a panel: changes of GOOD, or None for an answer that is no judgment."""
    rows = [("n", ticker, i, "?" if v is None else json.dumps(GOOD | v)) for i, v in enumerate(votes)]
    return spark.createDataFrame(rows, "news string, ticker int, persona int, content string")


def one(spark, *votes, panel=5):
    rows = N.assessments(answers(spark, *votes), panel, "news").withColumn("action", N.action()).collect()
    return rows[0] if rows else None


def test_majorities_are_of_the_whole_panel(spark):
    assert one(spark, {}, {}, {}, {}, {}).action == "auto_remove"
    kept = one(spark, {}, {}, {}, None, None)
    assert (kept.votes, kept.action, kept.thesis_break) == (3, "auto_remove", True)
    lost = one(spark, {}, {}, None, None, None)
    assert (lost.action, lost.thesis_break, lost.confidence, lost.directness, lost.reason, lost.affected) == ("alert_only", False, "low", "indirect", None, False)
    assert one(spark, None, None, None, None, None) is None


def test_each_condition_is_needed(spark):
    three = lambda **c: one(spark, c, c, c, {}, {}).action
    assert three(scope="market") == "auto_remove"
    for c in ({"thesis_break": False}, {"directness": "indirect"}, {"materiality": "medium"}, {"confidence": "low"}, {"affected_tickers": ["2"]}):
        assert three(**c) == "alert_only"


def test_levels_and_most_frequent_values(spark):
    r = one(spark, {"confidence": "high", "scope": "market"}, {"confidence": "high", "scope": "sector"}, {"confidence": "medium", "scope": "sector"}, {"confidence": "low", "scope": "market"}, {"confidence": "low", "scope": "unknown"})
    assert (r.confidence, r.scope) == ("medium", "market")  # three reach medium; of ties the first persona's
    r = one(spark, {"thesis_break_reason": "a", "thesis_break": False}, {"thesis_break_reason": "b"}, {"thesis_break_reason": "c"}, {"thesis_break_reason": "c"}, {"thesis_break_reason": ""})
    assert r.reason == "c"


def rows_of(spark, *rows):
    return spark.createDataFrame([("r", *r) for r in rows], "run string, ticker int, surface string, track string, action string")


FULL = {"short": 10, "midlong": 20, "full": 30}


@pytest.mark.parametrize(
    "rows,portfolio,want",
    [
        ([(1, "list", "short", "auto_remove"), (2, "list", "short", "alert_only")], 20, []),
        ([(i, "list", "midlong", "auto_remove") for i in range(4)], 20, ["mass_removal"]),
        ([(1, "list", "short", "auto_remove")] * 4, 20, ["list_track_floor"]),
        ([(1, "portfolio", None, "auto_remove")], 9, []),
        ([(1, "portfolio", None, "auto_remove"), (2, "portfolio", None, "auto_remove")], 9, ["portfolio_floor"]),
        ([(1, "portfolio", None, "auto_remove"), (2, "portfolio", None, "auto_remove"), (3, "portfolio", None, "auto_remove")], 10, []),
        ([(i, "portfolio", None, "auto_remove") for i in range(4)], 10, ["mass_removal", "portfolio_floor"]),
        ([(1, "list", "midlong", "auto_remove"), (1, "portfolio", None, "auto_remove")], 20, []),
    ],
)
def test_brakes(spark, rows, portfolio, want):
    (r,) = N.brakes(rows_of(spark, *rows), FULL, portfolio, "run").collect()
    assert r.reasons == want


def test_a_run_without_candidates_has_no_brake(spark):
    assert N.brakes(rows_of(spark, (1, "list", "short", "alert_only")), FULL, 1, "run").collect() == []


def test_surfaces(spark):
    universe = spark.createDataFrame([(1, "short", True), (2, None, True), (3, "midlong", False), (4, None, False)], "ticker int, track string, held boolean")
    assessed = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "ticker int")
    got = sorted((r.ticker, r.surface, r.track) for r in N.on_surfaces(assessed, universe).collect())
    assert got == [(1, "list", "short"), (1, "portfolio", None), (2, "portfolio", None), (3, "list", "midlong")]


def test_ledger(spark):
    rows = spark.createDataFrame([("a", 1, "auto_remove"), ("a", 2, "auto_remove"), ("a", 1, "alert_only"), ("b", 1, "auto_remove"), ("b", 1, "alert_only")], "run string, ticker int, action string")
    braked = spark.createDataFrame([("a", []), ("b", ["mass_removal"])], "run string, reasons array<string>")
    prices = spark.createDataFrame([(1, 10.0)], "ticker int, price double")
    of = lambda p: sorted((r.run, r.ticker, r.recommended, r.taken, r.price or 0.0, r.alert or "") for r in N.ledger(rows, braked, p, "run").collect())
    calm = [("a", 1, "alert_only", "shadowed", 0.0, "news_warning"), ("b", 1, "alert_only", "shadowed", 0.0, "news_warning"), ("b", 1, "hold_for_review", "held_by_brake", 0.0, "")]
    assert of(prices) == sorted([*calm, ("a", 1, "auto_remove", "removed", 10.0, "news_critical"), ("a", 2, "auto_remove", "shadowed", 0.0, "news_critical")])
    assert of(None) == sorted([*calm, ("a", 1, "auto_remove", "shadowed", 0.0, "news_critical"), ("a", 2, "auto_remove", "shadowed", 0.0, "news_critical")])


def test_an_answer_is_parsed_once(spark):
    """A column named in many places is computed in each: parsing is most of the work."""
    plan = N.assessments(answers(spark, {}, None), 5, "news")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_mentions_are_dealt_by_their_number(spark, monkeypatch):
    """Few bytes, many answers: partitions of size would leave them to one task."""
    monkeypatch.setattr(Q, "MENTIONS_A_TASK", 10)
    mentions = spark.range(1000).selectExpr("id AS doc_id", "id % 7 AS ticker").coalesce(1)
    got = Q.dealt(mentions)
    assert got.rdd.getNumPartitions() == 100 and got.count() == 1000
