import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.plans import claims as C
from vigil.plans import evidence as E
from vigil.plans import incidents as I
from vigil.plans import scoring as R
from vigil.plans import silent_delivery as S
from vigil.sources.seal import TRUTH, NotConfigured, Seal
from vigil.sources.store import Store

NOW = datetime(2026, 10, 8, 12, tzinfo=UTC)
START = datetime(2026, 10, 7, 14, 46, tzinfo=UTC)
END = START + timedelta(seconds=22)
RUNS = "item_name string, run_id string, status string, start_time timestamp, end_time timestamp, duration_seconds double"
COMMITS = "workspace_name string, table_name string, timestamp timestamp, rows_added bigint"
LANDING = "source_name string, exists boolean, size_bytes bigint, data_rows bigint, modified_at timestamp, collected_at timestamp"
H = timedelta(hours=1)


def now():
    return F.lit(NOW.isoformat()).cast("timestamp")


def estate(spark):
    runs = [("load", f"r{i}", "Completed", START - i * H, START - i * H + timedelta(seconds=19 + i), 19.0 + i) for i in range(5)]
    runs[0] = ("load", "r0", "Completed", START, END, 22.0)
    runs[3] = ("load", "r3", None, START - 3 * H, START - 3 * H + timedelta(seconds=19), 19.0)
    runs += [("other", "o1", "Completed", START - timedelta(minutes=1), START, 60.0)]
    commits = [("w", "ledger", START - k * H, n) for k, n in ((5, 5000), (4, 5000), (3, 5000), (2, 0), (1, None))] + [("w", "ledger", START + timedelta(seconds=5), 0), ("w", "else", START, 9)]
    landing = [("src", True, 9000, 5000, START - 3 * H, START - 2 * H), ("src", True, 9000, 5000, START - 3 * H, START - H), ("src", True, 312, 0, START - timedelta(minutes=6), START - timedelta(minutes=5)), ("src", True, 9, 9, NOW, NOW)]
    return spark.createDataFrame(runs, RUNS), spark.createDataFrame(commits, COMMITS), spark.createDataFrame(landing, LANDING)


def found(spark, runs, commits):
    return S.detect(runs.where("run_id = 'r0'"), commits, S.expectations(spark, [S.WriteExpectation("load", "ledger", "w")]), now(), now())


def test_evidence(spark):
    runs, commits, landing = estate(spark)
    wide = E.facts(found(spark, runs, commits), runs, commits, landing, now())
    got = {r.key: r.value for r in E.pack(wide).collect()}
    want = {
        "run.id": "r0", "run.rows_delivered": "0", "run.duration_seconds": "22.0", "expectation.target_table": "ledger", "expectation.minimum_rows": "1", "pipeline.runs_observed": "5", "pipeline.duration_median_seconds": "21.0", "pipeline.duration_min_seconds": "19.0",
        "pipeline.duration_max_seconds": "23.0", "pipeline.failed_runs": "1", "table.commits_observed": "6", "table.typical_delivery_rows": "5000", "table.deliveries_observed": "3", "table.zero_row_commits": "2", "table.uncounted_commits": "1",
        "table.hours_since_last_delivery": "24.2", "coverage.source_measured": "True", "coverage.source_samples": "3", "source.data_rows": "0", "source.size_bytes": "312", "source.exists": "True", "source.hours_old_at_run": "0.1", "estate.concurrent_runs": "1",
        "source.name": "src", "run.started": START.isoformat(), "source.sampled_at": (START - timedelta(minutes=5)).isoformat(), "table.last_delivery_at": (START - 3 * H).isoformat(), "run.status": "Completed", "run.ended": END.isoformat(), "source.modified_at": (START - timedelta(minutes=6)).isoformat(),
    }
    assert got == want and set(got) == {k for k, _, _ in E.FACTS}
    prompt = E.prompts(E.pack(wide)).first().prompt.split("\n")
    assert prompt[0] == "run.id = r0   (id of the flagged run)" and len(prompt) == 30
    by = E.facts(found(spark, runs, commits), runs, commits, landing, now(), {"load": "another"})
    assert by.select("`coverage.source_samples`").first()[0] == 0


def test_evidence_of_nothing(spark):
    runs, commits, _ = estate(spark)
    one = found(spark, runs, commits)
    wide = E.facts(one, runs.limit(0), commits.limit(0), None, now())
    got = {r.key: r.value for r in E.pack(wide).collect()}
    assert got["pipeline.runs_observed"] == "0" and got["table.commits_observed"] == "0" and got["coverage.source_measured"] == "False" and got["estate.concurrent_runs"] == "0"
    assert not any(k.startswith("source.") for k in got) and "pipeline.failed_runs" not in got
    assert "unknown" not in E.prompts(E.pack(wide)).first().prompt


REPLY = {"cause": "the source was empty", "reasoning": "because", "confidence": "high", "evidence_cited": ["source.data_rows"], "recommended_action": "look"}


@pytest.mark.parametrize(
    "reply, source, reason",
    [
        (f"Sure:\n```json\n{json.dumps(REPLY)}\n```", "model", ""),
        (json.dumps({**REPLY, "confidence": "certain"}), "model", ""),
        (json.dumps({**REPLY, "evidence_cited": ["made.up"]}), "fallback", "does not exist: made.up"),
        (json.dumps({**REPLY, "evidence_cited": []}), "fallback", "cites no evidence"),
        (json.dumps({**REPLY, "evidence_cited": "source.data_rows"}), "fallback", "not a list"),
        (json.dumps({**REPLY, "cause": ""}), "fallback", "no 'cause'"),
        ("no braces", "fallback", "no JSON object"),
        ("{broken", "fallback", "no JSON object"),
        ("{'single': 1,}", "fallback", "malformed JSON"),
        (json.dumps({"cause": "undetermined", "reasoning": "unclear"}), "abstention", ""),
        (None, "fallback", "model unavailable"),
    ],
)
def test_diagnoses(spark, reply, source, reason):
    runs, commits, landing = estate(spark)
    wide = E.facts(found(spark, runs, commits), runs, commits, landing, now())
    [r] = C.diagnoses(wide.withColumns({"reply": F.lit(reply), "unavailable": F.lit("down")}), "m", now()).collect()
    assert r.diagnosis_source == source and reason in r.fallback_reason and bool(r.fallback_reason) == (source == "fallback")
    if source == "model":
        assert (r.diagnosis_cause, r.diagnosis_confidence, json.loads(r.diagnosis_cited_json)) == ("the source was empty", "high" if "certain" not in reply else "low", ["source.data_rows"])
    elif source == "fallback":
        assert r.diagnosis_model == C.TEMPLATE_MODEL and len(json.loads(r.diagnosis_cited_json)) == 5
        assert r.diagnosis_reasoning == "The run ended as a success with 0 rows in ledger. Its length was 22.0 s; the median of the pipeline is 21.0 s. Commits with rows add 5,000 at the median. The last one was 24.2 hours ago."
    else:
        assert (r.diagnosis_cause, r.diagnosis_reasoning, r.diagnosis_confidence) == ("undetermined", "unclear", "low")


def test_model_is_called_in_batches_and_may_fail(spark):
    runs, commits, landing = estate(spark)
    incidents = found(spark, runs, commits)
    wide = E.facts(incidents, runs, commits, landing, now())
    prompts = E.prompts(E.pack(wide))
    reply = json.dumps(REPLY)
    d = C.diagnose(incidents, wide, prompts, lambda ps: [reply if "Incident INC-" in p else None for p in ps], "m", now())
    assert d.first().diagnosis_source == "model"
    fix = {"target": "pipeline", "summary": "guard", "change": "check rows", "rationale": "r", "prevents": "p", "risks": "none", "confidence": "medium", "evidence_cited": ["run.id"]}
    for change, want in (({}, ("pipeline", "model")), ({"target": "magic"}, ("none", "fallback")), ({"change": " "}, ("none", "fallback")), ({"target": "none", "evidence_cited": []}, ("none", "abstention"))):
        text = json.dumps({**fix, **change})
        [p] = C.propose(d, wide, prompts, lambda ps, text=text: [text for _ in ps], "m", now()).collect()
        assert (p.proposal_target, p.proposal_source) == want

    def down(prompts):
        raise TimeoutError("slow")

    f = C.diagnose(incidents, wide, prompts, down, "m", now())
    assert "TimeoutError: slow" in f.first().fallback_reason
    [p] = C.propose(f, wide, prompts, None, "m", now()).collect()
    assert (p.proposal_target, p.proposal_source, p.proposal_rationale) == ("none", "abstention", C.NO_DIAGNOSIS)


def test_incident_store(spark, tmp_path):
    runs, commits, landing = estate(spark)
    incidents = found(spark, runs, commits)
    key = incidents.first().incident_id
    s = Store(spark, f"file://{tmp_path}")
    empty = I.summary(I.load(s)).collect()
    assert {r.metric: r.value for r in empty}["incidents"] == 0
    wide = E.facts(incidents, runs, commits, landing, now())
    d = C.diagnoses(wide.withColumns({"reply": F.lit(json.dumps(REPLY)), "unavailable": F.lit(None).cast("string")}), "m", now())
    t = lambda k: NOW + timedelta(minutes=k)
    assert I.record(s, incidents, d, None, t(0)) == 1
    for bad, error in ((("nope", "approved"), KeyError), ((key, "maybe"), ValueError)):
        with pytest.raises(error):
            I.decide(s, *bad, "me", "", t(1))
    with pytest.raises(ValueError):
        I.judge(s, key, "wrong word", "me", "", t(1))
    with pytest.raises(KeyError):
        I.link_to_fault(s, "nope", "f", t(1))
    assert s.read("incidents").count() == 1 and I.pending(I.load(s)).count() == 1
    I.decide(s, key, "pending", "me", "", t(2))
    assert I.pending(I.load(s)).count() == 1
    I.decide(s, key, "approved", "me", "first", t(3))
    I.judge(s, key, "correct", "me", "named it", t(3))
    I.record(s, incidents, None, None, t(4))
    I.decide(s, key, "superseded", "me", "second", t(5))
    I.link_to_fault(s, key, "f1", t(6))
    [r] = I.load(s).collect()
    assert (r.decision, r.reviewer_note, r.verdict, r.diagnosis_cause, r.benchmark_ref) == ("superseded", "second", "correct", "the source was empty", "f1")
    assert s.read("incidents").count() == 7
    assert {m.metric: m.value for m in I.summary(I.load(s)).collect()} == {"incidents": 1, "diagnosed": 1, "by_model": 1, "abstained": 0, "by_fallback": 0, "proposed": 0, "no_change_warranted": 0, "pending": 0}
    wide_m = I.measured(I.load(s))
    assert wide_m.first().rows_delivered == "0" and "measured_json" not in wide_m.columns and wide_m.first().run_id == "r0"
    assert key in I.as_text(I.load(s), ["incident_id", "nope"])
    with pytest.raises(KeyError):
        I.get(I.load(s), "nope")


T = datetime(2026, 10, 20, 18, tzinfo=UTC)


def scored(spark, rows, reverted=T - 2 * H):
    cols = "incident_id string, item_name string, measured_json string, diagnosis_cause string, diagnosis_source string, verdict string, decision string, proposal_target string"
    incidents = spark.createDataFrame([(i, item, json.dumps({"run_started": at.isoformat()} if at else {}), *more) for i, item, at, *more in rows], cols)
    truth = spark.createDataFrame([("f1", "c", "w", "load", "m", "s", T - 6 * H, reverted, 1, {}, [])], TRUTH)
    return incidents, truth


NONE = (None, None, None, None, None)


def test_matching(spark):
    rows = [("in1", "load", T - 5 * H, *NONE), ("edge", "load", T - 6 * H, *NONE), ("end", "load", T - 2 * H, *NONE), ("before", "load", T - 7 * H, *NONE), ("after", "load", T - H, *NONE), ("other", "else", T - 5 * H, *NONE), ("norun", "load", None, *NONE)]
    incidents, truth = scored(spark, rows)
    at = F.lit(T.isoformat()).cast("timestamp")
    assert R.match(incidents, truth, at).first().incident_ids == ["edge", "end", "in1"]
    assert {r.incident_id for r in R.unmatched(incidents, truth, at).collect()} == {"before", "after", "other", "norun"}
    assert tuple(R.latency(incidents, truth, at).first())[1:] == (3, 0.0)
    live, open_truth = scored(spark, rows, None)
    assert "after" in R.match(live, open_truth, at).first().incident_ids
    none, _ = scored(spark, rows[3:4])
    assert tuple(R.latency(none, truth, at).first())[1:] == (0, None) and R.table(none, truth, at).first().latency_h == "—"
    assert tuple(R.table(incidents, truth, at).first()) == ("f1", 3, "0.00", "20 Oct 12:00 to 20 Oct 16:00")


def test_results(spark, tmp_path):
    rows = [("a", "load", T - 5 * H, "c", "model", "correct", "approved", "pipeline"), ("b", "load", T - 5.5 * H, "c", "model", None, None, "none"), ("x", "load", T - 9 * H, "c", "fallback", "restatement", None, None), ("y", "load", T - 9 * H, *NONE)]
    incidents, truth = scored(spark, rows)
    at = F.lit(T.isoformat()).cast("timestamp")
    got = {r.metric: r.value for r in R.results(incidents, truth, at).collect()}
    assert got == {
        "faults_sealed": 1, "faults_detected": 1, "faults_missed": 0, "incidents_matched": 2, "latency_hours_median": 0.5, "latency_hours_worst": 0.5, "faults_still_live": 0, "incidents_total": 4, "incidents_unmatched": 2, "judged_against_seal": 1, "judged_without_seal": 1,
        "diagnosed_awaiting_verdict": 1, "undiagnosed": 1, "diagnosis_model": 2, "diagnosis_fallback": 1, "verdict_correct": 1, "unsealed_verdict_restatement": 1, "decision_approved": 1, "proposal_pipeline": 1, "proposal_none": 1,
    }
    seal = Seal(spark, f"file://{tmp_path}/s")
    with pytest.raises(NotConfigured):
        R.report(seal, incidents, at, "parquet")
    seal.store(truth)
    assert {r.seal_path for r in R.report(seal, incidents, at, "parquet").collect()} == {seal.path}
