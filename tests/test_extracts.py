"""Extracts: each rule has a document that breaks it, and its path is told; clean documents become typed rows."""

import copy
import datetime
import json

import pytest
from panelforge.operators import extracts as E

SEMI, BANK = "반도체", "금융"


def picks(first, timeframe, n=10, sector=SEMI):
    return [{"ticker": f"{first + i:06d}", "assigned_timeframe": timeframe, "assigned_by": "primary", "weighted_score": 50 + i if i else 50.5, "sector": sector} for i in range(n)]


def arm_doc(key="s:2026-06-01"):
    track = "short" if key[0] == "s" else "midlong"
    selected = picks(1, "short") if track == "short" else picks(1, "mid") + picks(11, "long")
    arms = [{"arm": a, "track": track, "status": "logged", "run_date": "2026-05-30T01:02:03Z", "selected": copy.deepcopy(selected), "counterfactual_cut": None, "regime_context": None,
             "sector_view": {"source": "manual_pre_registered", "leadingSectors": [SEMI], "asOf": "2026-05-25"}} for a in E.ARMS]
    return {"period_key": key, "arms": arms}


def arm(i, **change):
    return lambda d: d[0]["arms"][i].update(change)


def sel(**change):
    return lambda d: d[0]["arms"][1]["selected"][0].update(change)


def view(**change):
    return lambda d: d[0]["arms"][1]["sector_view"].update(change)


def drop(d, *path):
    for k in path[:-1]:
        d = d[k]
    del d[path[-1]]


def regime(i, **c):
    return arm(i, regime_context={"source": "manual_pre_registered", "stage": "bull", "asOf": "2026-05-25"} | c)


def both(*changes):
    return lambda d: [c(d) for c in changes]


A = "$[0].arms[1]"
#: name: (change, path of the problem)
ARM_CASES = {
    "not a list": (lambda d: d.__setitem__(slice(None), [7]), "$[0]"),
    "no key": (lambda d: drop(d, 0, "period_key"), "$[0].period_key"),
    "key of no track": (lambda d: d[0].update(period_key="q:2026-06"), "$[0].period_key"),
    "key is a number": (lambda d: d[0].update(period_key=5), "$[0].period_key"),
    "arms is no list": (lambda d: d[0].update(arms={}), "$[0].arms"),
    "repeated period": (lambda d: d.append(copy.deepcopy(d[0])), "$[1].period_key"),
    "arm is no object": (lambda d: d[0]["arms"].__setitem__(1, "x"), A),
    "unknown arm": (arm(1, arm="x"), f"{A}.arm"),
    "repeated arm": (arm(1, arm=E.BASELINE), f"{A}.arm"),
    "track of another period": (arm(1, track="midlong"), f"{A}.track"),
    "no track": (lambda d: drop(d, 0, "arms", 1, "track"), f"{A}.track"),
    "unknown status": (arm(1, status="done"), f"{A}.status"),
    "selected is no list": (arm(1, selected="x"), f"{A}.selected"),
    "pick is no object": (lambda d: d[0]["arms"][1]["selected"].__setitem__(0, 3), f"{A}.selected[0]"),
    "ticker is a number": (sel(ticker=1), f"{A}.selected[0].ticker"),
    "ticker of five digits": (sel(ticker="12345"), f"{A}.selected[0].ticker"),
    "unknown timeframe": (sel(assigned_timeframe="day"), f"{A}.selected[0].assigned_timeframe"),
    "timeframe of the other track": (sel(assigned_timeframe="mid"), f"{A}.selected[0].assigned_timeframe"),
    "unknown assigner": (sel(assigned_by="x"), f"{A}.selected[0].assigned_by"),
    "score is text": (sel(weighted_score="50"), f"{A}.selected[0].weighted_score"),
    "score is a flag": (sel(weighted_score=True), f"{A}.selected[0].weighted_score"),
    "score is null": (sel(weighted_score=None), f"{A}.selected[0].weighted_score"),
    "unknown sector": (sel(sector="기타"), f"{A}.selected[0].sector"),
    "no sector": (lambda d: drop(d, 0, "arms", 1, "selected", 0, "sector"), f"{A}.selected[0].sector"),
    "nine picks": (lambda d: d[0]["arms"][1]["selected"].pop(), f"{A}.selected"),
    "repeated ticker": (lambda d: d[0]["arms"][1]["selected"][4].update(ticker="000001"), f"{A}.selected[4].ticker"),
    "view is no object": (arm(1, sector_view="absent"), f"{A}.sector_view"),
    "unknown source": (view(source="x"), f"{A}.sector_view.source"),
    "leading is text": (view(leadingSectors=SEMI), f"{A}.sector_view.leadingSectors"),
    "leading holds a number": (view(leadingSectors=[SEMI, 1]), f"{A}.sector_view.leadingSectors[1]"),
    "leading is unknown": (view(leadingSectors=["기타"]), f"{A}.sector_view.leadingSectors[0]"),
    "absent but leading": (view(source="absent"), f"{A}.sector_view.leadingSectors"),
    "manual without leading": (view(leadingSectors=[]), f"{A}.sector_view.leadingSectors"),
    "manual without a date": (lambda d: drop(d, 0, "arms", 1, "sector_view", "asOf"), f"{A}.sector_view.asOf"),
    "date is empty": (view(asOf=""), f"{A}.sector_view.asOf"),
    "date is none": (view(asOf="2026-13-01"), f"{A}.sector_view.asOf"),
    "views differ": (lambda d: d[0]["arms"][2]["sector_view"].update(leadingSectors=[BANK]), "$[0].arms"),
    "cut of another arm": (arm(1, counterfactual_cut=["000001"]), f"{A}.counterfactual_cut"),
    "cut holds a number": (arm(3, counterfactual_cut=[123]), "$[0].arms[3].counterfactual_cut[0]"),
    "cut of a bad form": (arm(3, counterfactual_cut=["000001", "12ABCD"]), "$[0].arms[3].counterfactual_cut[1]"),
    "cut repeats": (arm(3, counterfactual_cut=["000099", "000098", "000099"]), "$[0].arms[3].counterfactual_cut[2]"),
    "cut is text": (arm(3, counterfactual_cut="x"), "$[0].arms[3].counterfactual_cut"),
    "regime is text": (arm(1, regime_context="bull"), f"{A}.regime_context"),
    "regime of no source": (regime(1, source="x"), f"{A}.regime_context.source"),
    "unknown stage": (regime(1, stage="boom"), f"{A}.regime_context.stage"),
    "regime without a date": (regime(1, asOf=None), f"{A}.regime_context.asOf"),
    "regimes differ": (both(regime(1), regime(2, stage="bear")), "$[0].arms"),
    "no run date": (lambda d: drop(d, 0, "arms", 1, "run_date"), f"{A}.run_date"),
    "run date is no day": (arm(1, run_date="yesterday"), f"{A}.run_date"),
    # The first in reading order is told.
    "two problems": (both(arm(2, status="x"), sel(ticker="x")), f"{A}.selected[0].ticker"),
}
CLEAN = {
    "plain": (lambda d: None, "s:2026-06-01"),
    "midlong": (lambda d: None, "m:2026-06"),
    "null sectors": (lambda d: [s.update(sector=None) for s in d[0]["arms"][1]["selected"]], "s:2026-06-01"),
    "unfinished arm": (arm(3, status="incomplete_run", selected=picks(1, "short", 7), run_date=None, counterfactual_cut=["000099"]), "s:2026-06-01"),
    "absent": (lambda d: [a.update(sector_view={"source": "absent", "leadingSectors": []}) for a in d[0]["arms"]], "s:2026-06-01"),
    "regime": (both(regime(1), regime(2)), "s:2026-06-01"),
    "no arms": (lambda d: d[0].update(arms=[]), "s:2026-06-01"),
    "no periods": (lambda d: d.clear(), "s:2026-06-01"),
}


def documents(spark, cases, base):
    rows = []
    for name, (change, *key) in cases.items():
        doc = [base(*(k for k in key if k[1:2] == ":"))]
        change(doc)
        rows.append((name, json.dumps(doc, ensure_ascii=False)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc string, json string").repartition(3)


def test_every_arm_rule_tells_its_path(spark):
    rows = documents(spark, ARM_CASES, arm_doc) + [("no json", "[{"), ("a number", "5"), ("nothing", None)]
    levels = E.arm_extracts(frame(spark, rows))
    got = {r.doc: r.path for r in levels.problems.collect()}
    assert got == {n: path for n, (_, path) in ARM_CASES.items()} | {"no json": "$", "a number": "$", "nothing": "$"}
    assert all(t.count() == 0 for t in levels.tables.values())
    with pytest.raises(E.ExtractError, match=r"a number: \$ must be list, is whole"):
        E.require(levels)


def test_clean_arm_extracts(spark):
    levels = E.arm_extracts(frame(spark, documents(spark, CLEAN, arm_doc)))
    assert levels.problems.collect() == []
    tables = E.require(levels)
    periods = {r.doc: r for r in tables["periods"].collect()}
    assert set(periods) == set(CLEAN) - {"no periods"}
    p = periods["plain"]
    assert (p.track, p.selection_date, p.sector_source, p.leading, p.sector_as_of, p.run_dates) == ("short", datetime.date(2026, 6, 1), "manual_pre_registered", [SEMI], datetime.date(2026, 5, 25), [datetime.date(2026, 5, 30)])
    assert periods["midlong"].track == "midlong" and periods["midlong"].selection_date == datetime.date(2026, 6, 1)
    assert (periods["absent"].sector_source, periods["absent"].leading) == ("absent", None) and (periods["regime"].regime_source, periods["regime"].regime_stage) == ("manual_pre_registered", "bull")
    assert periods["no arms"].sector_source == "absent"
    arms = {(r.doc, r.arm): r for r in tables["arms"].collect()}
    assert arms["unfinished arm", E.HARD_GATE].status == "incomplete_run" and arms["unfinished arm", E.HARD_GATE].cut == ["000099"] and arms["plain", E.BASELINE].cut == []
    found = [r for r in tables["picks"].collect() if r.doc == "midlong" and r.arm == E.BASELINE]
    assert sorted((r.place, r.ticker, r.timeframe, r.weighted_score) for r in found) == [(i, f"{1 + i:06d}", "mid" if i < 10 else "long", 50.5 if i % 10 == 0 else 50.0 + i % 10) for i in range(20)]


def mirror_doc():
    row = {"run_id": "r1", "universe_hash": "h", "universe_size": 200, "tier0_score": 1.5}
    snapshot = [row | {"ticker": f"t{i}", "bucket": b, "run_date": "2026-06-01"} for i, b in enumerate(E.BUCKETS)]
    candidates = [row | {"arm": a, "status": "logged", "ticker": f"t{i}", "bucket": "short", "rank": i, "gate_eligible_size": 150, "sector_view": {"source": "absent"}, "counterfactual_cut": ["t9"]} for a in E.MIRROR_ARMS for i in range(2)]
    hypothesis = [{"source": "manual", "leading_sectors": [SEMI], "as_of": "2026-05-25", "selection_as_of": "2026-06-01", "hypothesis_hash": "x"} for _ in range(2)]
    return {"period_key": "2026-06", "run_id": "r1", "run_id_count": 1, "candidates": candidates, "snapshot": snapshot, "hypothesis": hypothesis}


def cand(i=0, **c):
    return lambda d: d[0]["candidates"][i].update(c)


def snap(**c):
    return lambda d: d[0]["snapshot"][1].update(c)


def hyp(**c):
    return lambda d: d[0]["hypothesis"][1].update(c)


C, S, Y = "$[0].candidates[0]", "$[0].snapshot[1]", "$[0].hypothesis[1]"
MIRROR_CASES = {
    "bad key": (lambda d: d[0].update(period_key="2026-6"), "$[0].period_key"),
    "runs without an id": (lambda d: d[0].update(run_id=None), "$[0].run_id_count"),
    "two runs": (lambda d: d[0].update(run_id_count=2), "$[0].run_id_count"),
    "empty id": (lambda d: d[0].update(run_id=""), "$[0].run_id"),
    "half a run": (lambda d: d[0].update(run_id_count=0.5), "$[0].run_id_count"),
    "no candidates": (lambda d: drop(d, 0, "candidates"), "$[0].candidates"),
    "snapshot is text": (lambda d: d[0].update(snapshot="x"), "$[0].snapshot"),
    "repeated": (lambda d: d.append(copy.deepcopy(d[0])), "$[1].period_key"),
    "unknown bucket": (snap(bucket="day"), f"{S}.bucket"),
    "snapshot of another run": (snap(run_id="r2"), f"{S}.run_id"),
    "score is text": (snap(tier0_score="1"), f"{S}.tier0_score"),
    "size under 0": (snap(universe_size=-1), f"{S}.universe_size"),
    "no date": (snap(run_date="x"), f"{S}.run_date"),
    "dates differ": (snap(run_date="2026-06-02"), "$[0].snapshot"),
    "sizes differ": (snap(universe_size=201), "$[0].snapshot"),
    "hash differs": (snap(universe_hash="g"), "$[0]"),
    "unknown arm": (cand(arm="x"), f"{C}.arm"),
    "unknown status": (cand(status="x"), f"{C}.status"),
    "candidate of another run": (cand(run_id="r2"), f"{C}.run_id"),
    "rank is text": (cand(rank="1"), f"{C}.rank"),
    "gate too small": (cand(4, gate_eligible_size=149), "$[0].candidates[4].gate_eligible_size"),
    "gate not told": (cand(4, gate_eligible_size=None), "$[0].candidates[4].gate_eligible_size"),
    "view is text": (cand(sector_view="x"), f"{C}.sector_view"),
    "view without source": (cand(sector_view={}), f"{C}.sector_view.source"),
    "cut holds a number": (cand(counterfactual_cut=["a", 1]), f"{C}.counterfactual_cut[1]"),
    "sources differ": (cand(sector_view={"source": "manual"}), "$[0].candidates"),
    "universes differ": (cand(universe_size=199), "$[0].candidates"),
    "hypotheses differ": (hyp(hypothesis_hash="y"), "$[0].hypothesis"),
    "no source": (hyp(source=""), f"{Y}.source"),
    "sectors are text": (hyp(leading_sectors="x"), f"{Y}.leading_sectors"),
    "no day": (hyp(as_of="soon"), f"{Y}.as_of"),
}


def test_every_mirror_rule_tells_its_path(spark):
    levels = E.mirror_extracts(frame(spark, documents(spark, MIRROR_CASES, mirror_doc)))
    assert {r.doc: r.path for r in levels.problems.collect()} == {n: path for n, (_, path) in MIRROR_CASES.items()}


def test_clean_mirror_extracts(spark):
    cases = {
        "plain": (lambda d: None,), "week": (lambda d: d[0].update(period_key="2026-W23"),), "unlogged": (cand(4, status="invalid_input", gate_eligible_size=None),),
        "no mirror": (lambda d: d[0].update(run_id=None, run_id_count=0, candidates=[], snapshot=[], hypothesis=[]),), "empty": (lambda d: d[0].update(candidates=[], hypothesis=[]),), "null score": (snap(tier0_score=None),),
    }
    levels = E.mirror_extracts(frame(spark, documents(spark, cases, mirror_doc)))
    assert levels.problems.collect() == []
    periods = {r.doc: r for r in levels.tables["periods"].collect()}
    p = periods["plain"]
    assert (p.run_id, p.run_date, p.universe_size, p.universe_hash, p.source, p.as_of) == ("r1", datetime.date(2026, 6, 1), 200, "h", "manual", datetime.date(2026, 5, 25))
    assert (periods["no mirror"].universe_size, periods["no mirror"].run_date, periods["empty"].universe_hash) == (0, None, "h")
    arms = levels.tables["arms"].groupBy("doc").count().collect()
    assert {r.doc: r["count"] for r in arms} == {"plain": 6, "week": 6, "unlogged": 5, "null score": 6}
    assert levels.tables["scores"].filter("doc = 'null score'").count() == 2
