"""Cases, evidence, acceptance, guardrails, circumplex and placement on small tables with known outcomes."""

import datetime as dt
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwise import adapter, catalog
from pathwise.functions import tables
from pathwise.operators import cases, metrics, resample, reviewed
from pathwise.plans import complete
from pathwise.schema import DIMS
from pathwise.sources import readers
from pathwise.streaming import live


def _tokens(spark, rows):
    return spark.createDataFrame(rows, "repeat int, persona_id string, dimension string, t_index long, token string, label boolean")


def test_runs_differ_in_tokens_or_spans(spark):
    rows = [(r, "p", d, t, "conflict", True) for r in (1, 2, 3) for d in ("same", "spans") for t in (0, 1)]
    rows += [(r, "p", "token", 0, "abstain" if r == 2 else "invalid", None) for r in (1, 2, 3)]
    rows = [r if (r[0], r[2]) != (3, "spans") else (*r[:4], "conflict", None) for r in rows]
    df = _tokens(spark, rows)
    got = {r["dimension"]: (r["by_token"], r["by_spans"]) for r in cases.run_disagreement(df, cases.run_spans(df)).collect()}
    assert got == {"spans": (False, True), "token": (True, False)}


def test_windows_of_prompts(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("p", 0, day(1), "a"), ("p", 1, day(3), "b"), ("p", 2, day(9), "c"), ("p", 3, day(16), "d")], "persona_id string, t_index long, d date, text_hash string")
    kind = "persona_id string, week_start date, week_end date, visible array<long>, current array<long>, cutoff long, shown map<bigint,string>"
    text = {0: "a", 1: "b", 2: "c", 3: "d"}
    good = [("p", day(1), day(7), [0, 1], [0, 1], 1, {k: text[k] for k in (0, 1)}), ("p", day(8), day(14), [0, 1, 2], [2], 2, {k: text[k] for k in (0, 1, 2)}), ("p", day(15), day(21), [0, 1, 2, 3], [3], 3, text)]
    found, lost = cases.window_problems(spark.createDataFrame(good, kind), entries)
    assert found.count() == 0 == lost.count()
    bad = [("p", day(1), day(7), [0, 2], [0], 0, {0: "x", 2: "c"}), good[1], good[1]]
    found, lost = cases.window_problems(spark.createDataFrame(bad, kind), entries)
    assert sorted((r["week_start"].day, r["problem"]) for r in found.collect()) == [(1, "current-week boundary"), (1, "history boundary"), (1, "history text"), (8, "duplicate prompt"), (8, "duplicate prompt")]
    assert {(r["t_index"], r["n_windows"]) for r in lost.collect()} == {(1, 0), (2, 2), (3, 0)}


def test_evidence_of_weeks_and_states(spark):
    rows = [("p", 1, t, m, a, b) for t, (m, a, b) in enumerate([(0.1, 0.2, 0.9), (0.0, -0.5, 0.1), (0.3, -0.1, 0.8), (0.2, 0.0, 0.9)])] + [("q", 1, 0, 0.0, 0.4, None)]
    df = spark.createDataFrame(rows, "persona_id string, week int, t_index long, m double, tension double, strength double")
    got = {(r["persona_id"], r["t_index"], r["direction"], r["primary"]) for r in cases.evidence_picks(df).collect()}
    assert got == {("p", 1, "misaligned", True), ("p", 2, "misaligned", True), ("p", 3, "aligned", True), ("q", 0, "misaligned", False)}
    d = spark.createDataFrame([("p", c, t, dt.date(2024, 1, 1 + t)) for c in ("in", "open", "old") for t in range(8)], "persona_id string, dimension string, t_index long, d date")
    d = d.withColumn("d", F.when(F.col("dimension") == "in", F.col("d")).otherwise(F.date_add("d", 60)))
    states = spark.createDataFrame([("p", "in", "no_active_drift", 0), ("p", "open", "active_drift", 2), ("p", "old", "insufficient_evidence", 0)], "persona_id string, dimension string, state string, run_length long")
    got = {}
    for r in cases.state_evidence(d, states, F.lit("2024-01-02").cast("date"), F.lit("2024-01-05").cast("date")).collect():
        got.setdefault((r["dimension"], r["why"]), []).append(r["t_index"])
    assert {k: sorted(v) for k, v in got.items()} == {("in", "window"): [2, 3, 4], ("open", "open drift"): [6, 7], ("old", "latest"): [5, 6, 7]}


def test_pairs_need_all_ten_conditions(spark):
    entries = [(p, f"{p}{k}", a, a) for p in "abcdefg" for k, a in enumerate((-1, 1))] + [("h", "h0", -1, 1), ("h", "h1", 1, 1), ("i", "i0", 0, 0), ("i", "i1", 1, 1)]
    fine = ("yes", "yes", "yes", [])
    reviews = [(p, r, *fine) for p in "ahi" for r in "xy"]
    reviews += [(p, "x", *fine) for p in "bcdef"] + [("b", "y", "no", "yes", "yes", []), ("c", "y", "yes", "no", "yes", []), ("d", "y", "yes", "yes", None, []), ("e", "y", "yes", "yes", "yes", ["odd"]), ("g", "x", *fine)]
    out = cases.accepted_pairs(spark.createDataFrame(entries, "pair_id string, entry_id string, label_a int, label_b int"), spark.createDataFrame(reviews, "pair_id string, reviewer string, comparable string, realistic string, accept string, issues array<string>"))
    got = {r["pair_id"]: (r["label_agreement"], r["opposite"], r["accepted"]) for r in out.collect()}
    assert got == {"a": (True, True, True), **{p: (True, True, False) for p in "bcdefg"}, "h": (False, False, False), "i": (True, False, False)}


def test_responses_are_complete_and_consistent(spark):
    expected = spark.createDataFrame([(c, k) for c in "abcd" for k in range(3)], "case_id string, position long")
    say = lambda c, *ds: [(c, k, d, cases.YES_REASON) for k, d in enumerate(ds)]
    rows = say("a", "yes", "yes", "no") + say("b", "no", "uncertain", "no") + say("c", "yes", "no", "perhaps")[:3] + say("d", "no", "no")
    told = [("a", "no", "why"), ("b", "uncertain", "why"), ("c", "no", ""), ("e", "no", "why")]
    out = cases.response_problems(expected, spark.createDataFrame(rows, "case_id string, position long, decision string, reason string"), spark.createDataFrame(told, "case_id string, sustained string, rationale string"))
    assert {(r["case_id"], r["problem"]) for r in out.collect()} == {("a", "sustained"), ("c", "decision"), ("c", "rationale"), ("d", "entry coverage"), ("d", "missing case"), ("e", "unknown case")}


def test_trajectories_inventory_and_counts(spark):
    e = spark.createDataFrame([("a", 0, "x"), ("a", 1, " y "), ("b", 0, "x"), ("b", 2, "x"), ("c", 0, " ")], "persona_id string, t_index long, text string")
    assert {r["persona_id"]: r["problem"] for r in cases.trajectory_problems(e).collect()} == {"a": None, "b": "non-contiguous positions", "c": "missing text at 0"}
    full = cases.full_cases(e, spark.createDataFrame([("a", "power"), ("b", "power")], "persona_id string, dimension string"), "train").collect()
    assert [(r["case_id"], [x["text"] for x in r["entries"]]) for r in full] == [("train:a:power", ["x", "y"])]
    rows = spark.createDataFrame([("p", "d", t, a, b) for t, (a, b) in enumerate([(1, 0), (1, 0), (0, 1), (1, None)])], "persona_id string, dimension string, t_index long, a int, b int")
    r = cases.inventory(rows, {"one": F.col("a") == 1, "two": F.col("b") == 1}).first()
    assert (r["length"], r["one_runs"], r["one_windows"], r["one_candidate"], r["two_runs"], r["two_candidate"], r["sources"]) == (4, 2, 1, True, 1, False, "one")
    counts = rows.agg(F.count(F.lit(1)).alias("rows"))
    assert cases.assert_counts(counts, {"rows": 4}).count() == 1
    for wrong in ({"rows": 5}, {}):
        with pytest.raises(ValueError, match="rows"):
            cases.assert_counts(counts, wrong)


def test_guardrails_rank_by_floors_first(spark):
    kind = "run string, qwk_mean double, recall_minus1 double, minority_recall_mean double, calibration_global double, hedging_mean double, hard_x double, hard_y double"
    rows = [("base", 0.5, 0.4, 0.5, 0.8, 0.5, 0.3, 0.3), ("gain", 0.4, 0.4, 0.5, 0.8, 0.5, 0.36, 0.29), ("loss", 0.9, 0.4, 0.5, 0.8, 0.5, 0.6, 0.1), ("low", 0.1, 0.4, 0.5, 0.8, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, kind)
    out = {r["run"]: r for r in cases.guardrails(df, df.where("run = 'base'"), ["hard_x", "hard_y"]).collect()}
    assert [n for n, _ in sorted(out.items(), key=lambda x: x[1]["rank"])] == ["gain", "base", "loss", "low"]
    assert (out["gain"]["no_material_loss"], out["gain"]["required_gain"], out["loss"]["no_material_loss"], out["low"]["n_floors"]) == (True, True, False, 3)


def test_circumplex_against_numpy(spark):
    rng = np.random.default_rng(1)
    scores = rng.uniform(-1, 1, (7, 10))
    rows = [(k, d, float(scores[k, j]), float(abs(scores[k, j])) / 2, float(abs(scores[k, j])) / 4) for k in range(7) for j, d in enumerate(DIMS)] + [(9, "power", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "item int, dimension string, s double, p double, m double")
    at = {d: j for j, d in enumerate(DIMS)}
    for r in metrics.circumplex(df, "item", score="s").collect():
        a, b = scores[:, at[r["left"]]], scores[:, at[r["right"]]]
        assert r["score"] == pytest.approx(np.mean(np.maximum(a, 0) * np.maximum(b, 0)) if r["relation"] == "adjacent" else np.mean(np.maximum(a * b, 0)))
    got = metrics.circumplex(df, "item", plus="p", minus="m").collect()
    assert len(got) == 24 and len({r["mean"] for r in got}) == 2
    for r in got:
        product = np.mean(np.abs(scores[:, at[r["left"]]] * scores[:, at[r["right"]]]))
        assert r["score"] == pytest.approx(product / 4 if r["relation"] == "adjacent" else product * (1 / 4 + 1 / 16))


def test_placement_and_bootstrap(spark):
    weeks = [(p, w, c) for p in range(6) for w in range(8) for c in (3, 9)]
    chances = spark.createDataFrame(weeks, "persona_id long, week long, cutoff long")
    references = spark.createDataFrame([(p, 0, 5) for p in range(6)], "persona_id long, week long, confirmation long")
    sure = resample.placement_test(chances, spark.createDataFrame([(p, 0, 9) for p in range(6)], "persona_id long, week long, cutoff long"), references, ["persona_id", "week"], 50).first()
    assert (sure["observed_rate"], sure["n_weeks"], sure["n_triggers"], sure["percentile"]) == (1.0, 48, 6, 1.0) and sure["p"] < 0.1
    never = resample.placement_test(chances, spark.createDataFrame([(p, 1, 9) for p in range(6)], "persona_id long, week long, cutoff long"), references, ["persona_id", "week"], 50).first()
    assert (never["observed_rate"], never["p"]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        resample.placement_test(chances.limit(1), chances, references, ["persona_id", "week"], 5)
    rng = random.Random(4)
    rows = [(k, rng.choice("xy"), rng.randrange(5), 5) for k in range(80)] + [(None, "x", 1, None)]
    df = spark.createDataFrame(rows, "c long, g string, top long, bottom long")
    got = {(r["g"], r["replicate"]): r["value"] for r in resample.cluster_bootstrap(df.repartition(6), "c", "top", "bottom", 30, 7, ("g",)).collect()}
    steps = np.array(resample.poisson_steps())
    for (g, k), value in got.items():
        weight = [np.searchsorted(steps, resample._draws(r[0], 30, 7)[k], "right") for r in rows]
        top, bottom = (sum(w * (r[j] or 0) for w, r in zip(weight, rows, strict=True) if r[1] == g) for j in (2, 3))
        assert value == pytest.approx(top / bottom)
    assert "Generate" not in resample.cluster_bootstrap(df, "c", "top", "bottom", 30)._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1]


def test_dimension_traces_and_recovery(spark):
    one = {"minus1": 0.1, "zero": 0.2, "plus1": 0.3}
    epochs = spark.createDataFrame([(1, [float(k) for k in range(10)], [one] * 10, True)], "epoch int, w array<double>, recall array<struct<minus1:double,zero:double,plus1:double>>, eligible boolean")
    out = cases.dimension_trace(epochs, ["w"], DIMS, 1)
    assert out.count() == 10 and out.where("dimension = 'stimulation'").first()["w"] == 1.0 and out.where("selected").count() == 10
    empty = cases.dimension_trace(epochs.limit(0), ["w"], DIMS)
    assert empty.count() == 0 and empty.schema == out.schema
    with pytest.raises(Exception, match="lacks dimensions"):
        cases.dimension_trace(epochs.withColumn("w", F.slice("w", 1, 9)), ["w"], DIMS).collect()
    rows = spark.createDataFrame([("invalid", "conflict", "b c", "a b c"), ("invalid", "conflict", " ", "a b"), ("invalid", "conflict", None, "a"), ("invalid", "abstain", None, None), ("error", "conflict", "a", "a"), ("invalid", "maybe", "a", "a")], "status string, verdict string, quote string, text string")
    assert [r["status"] for r in cases.recovered(rows, F.lit(True)).collect()] == ["ok", "invalid", "invalid", "ok", "error", "invalid"]


def test_lifecycle_of_events(spark):
    kind = "event_id long, status string, started_at string, completed_at string, duration_ms int, error string, valid boolean"
    rows = [(1, "complete", "1", "2", 5, None, None), (2, "invalid", "1", "2", 5, "e", False), (3, "running", "1", None, None, None, None), (4, "invalid", "1", "2", 5, "e", None), (5, "queued", "1", "2", None, None, None), (6, "failed", "3", "2", None, None, None), (7, "reused", "1", "2", 1, "e", None), (8, None, "1", None, None, None, None)]
    got = {}
    for r in live.lifecycle_problems(spark.createDataFrame(rows, kind)).collect():
        got.setdefault(r["event_id"], set()).add(r["problem"])
    assert got == {4: {"no failed validation"}, 5: {"complete before the end"}, 6: {"no completion timing", "completion precedes start", "no error"}, 7: {"error of a success"}, 8: {"unknown status"}}


def test_table_functions_agree_with_readers(spark):
    text = "# Persona\n## Entry 1 - 2024-01-02\r\nFirst.\n\n## Entry none\nMore.\n## Entry 2 - 2024-01-03\n"
    df = spark.createDataFrame([("p_12345678.md", text), ("p_00000001.md", ""), ("p_00000002.md", None)], "file string, content string")
    tables.register(spark)
    df.createOrReplaceTempView("journals")
    got = {(r["file"], r["nth"], r["head"], r["date"], r["body"]) for r in spark.sql("SELECT file, s.* FROM journals, LATERAL journal_sections(content) s").collect()}
    own = readers._entry_lines(df.where("content is not null")).select("file", "nth", "head", F.array_join("lines", "\n").alias("body"))
    assert {(f, n, h, b) for f, n, h, _, b in got} == {(r["file"], r["nth"], r["head"], r["body"]) for r in own.collect()}
    assert {(n, d) for _, n, _, d, _ in got} == {(1, "2024-01-02"), (2, "2024-01-03")}


def test_windows_are_not_dealt_with_their_whole_maps(spark):
    import re

    entries = spark.sql("select 1L as persona_id, id as t_index, date'2025-01-06' as d, 'h' as text_hash from range(8)")
    windows = spark.sql("select 1L as persona_id, date'2025-01-06' as week_start, date'2025-01-12' as week_end, sequence(0L, 7L) as visible, sequence(0L, 7L) as current, 7L as cutoff, map_from_arrays(sequence(0L, 7L), array_repeat('h', 8)) as shown")
    found, lost = cases.window_problems(windows, entries)
    assert found.count() == 0 and lost.count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(plan) if "Join LeftOuter" in line and "t_index" in line)
    assert "t_index" in plan[join + 1] and not re.search(r"[\[ ](shown|current)#\d+[,\]]", plan[join + 1])


def test_runs_profiles_and_queues(spark):
    """Each of nine queues by a case of its own; a case that no run has, and one without a persona, are in none."""
    kind = "repeat int, persona_id string, dimension string, t_index long, verdict string, ok boolean"
    rows = [(r, "p", d, t, v, True) for r in (1, 2) for d, vs in {"plain": "nnn", "drift": "ccncc", "open": "nnac", "gap": "ccc"}.items() for t, v in enumerate(vs)]
    rows = [x if x[2] != "gap" or x[3] < 2 else (*x[:3], 5, *x[4:]) for x in rows] + [(r, "p", "bad", 0, "c", r == 1) for r in (1, 2)] + [(1, None, "plain", 0, "n", True)]
    said = F.expr("case verdict when 'c' then 'conflict' when 'n' then 'not_conflict' else 'abstain' end")
    tokens = spark.createDataFrame(rows, kind).withColumn("verdict", said).withColumn("label", F.expr("case when ok and verdict <> 'abstain' then verdict = 'conflict' end"))
    profiles = cases.run_profiles(tokens)
    got = {(r["repeat"], r["dimension"]): (r["invalid"], r["unresolved"], [tuple(s) for s in r["spans"]]) for r in profiles.where("persona_id is not null").collect()}
    one = {"plain": (False, False, []), "drift": (False, False, [(0, 1), (3, 4)]), "open": (False, True, []), "gap": (False, False, [(0, 1)])}
    assert got == {(r, d): v for r in (1, 2) for d, v in one.items()} | {(1, "bad"): (False, False, []), (2, "bad"): (True, False, [])}

    spans = profiles.select("repeat", *cases.CASE, F.inline("spans"))
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, cases.run_spans(tokens).select("repeat", *cases.CASE, "onset", "end").collect()))
    predicted = spans.select("repeat", *cases.CASE, F.col("onset").cast("string").alias("episode_id"), F.col("onset").alias("onset_t_index"), (F.col("onset") + 1).alias("confirmation_t_index"), F.lit("drift").alias("delivery_state"))
    reference = spark.createDataFrame([("p", "drift", "a", 0, 1, 1, "x"), ("p", "plain", "b", 1, 2, 2, "x"), ("q", "plain", "c", 0, 1, 1, "x")], "persona_id string, dimension string, episode_id string, onset_t_index long, confirmation_t_index long, end_t_index long, delivery_state string")
    errors = reviewed.case_errors(profiles, reference, predicted)
    assert {(r["repeat"], r["dimension"]): (r["missed"], r["false_alerts"]) for r in errors.collect()} == {(r, d): v for r in (1, 2) for d, v in {"drift": (0, 1), "plain": (1, 0), "gap": (0, 1)}.items()}

    case = lambda *ds: spark.createDataFrame([("p", d) for d in ds], "persona_id string, dimension string")
    labels = case("open", "none").withColumn("score", F.lit(None).cast("int")).unionByName(case("plain").withColumn("score", F.lit(0)))
    out = cases.review_queues(profiles, reference, labels, case("gap", "none"), cases.run_disagreement(tokens.withColumn("token", F.when(F.col("ok"), F.col("verdict")).otherwise("invalid")), spans, runs=2), errors)
    want = {"All persona/Core Value cases": "bad drift gap open plain", "Reference Drift": "drift plain", "Uncertain LLM-Judge Conflict Label": "open", "Model disagreement": "gap", "Run disagreement": "bad",
            "Invalid response": "bad", "Unresolved because of Abstain": "open", "Missed Drift": "plain", "False Drift alert": "drift gap"}
    assert sorted(map(tuple, out.collect())) == sorted(("p", d, queue) for queue, ds in want.items() for d in ds.split())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables here")
def test_queues_make_each_view_once(spark):
    """Of the events' views only those that a queue needs, and one of each: the plan reads the events four times at most."""
    plan = complete.plans.queries["x17_review_queues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 4


def test_hashes_of_passes_are_summed_beyond_a_long(spark):
    """The digests of 8.5 million rows, whose first 40 bits are near 2^40, add up to more than 2^63."""
    rows, item = 8_500_000, 2555
    scores = F.create_map(F.lit("security"), F.lit(1))
    results = spark.range(rows).select(F.lit(1).alias("pass"), F.lit(item).alias("event_id"), scores.alias("scores"), F.create_map(F.lit("security"), F.lit("why")).alias("rationales"))
    digest = hashlib.md5(f"{item}|x,x,x,x,x,1,x,x,x,x".encode()).hexdigest()
    sums = [rows * int(digest[k : k + 10], 16) for k in (0, 10, 20)]
    assert sums[0] > 2**63
    assert [tuple(r) for r in reviewed.provenance(results).collect()] == [(1, rows, "-".join(map(str, sums)), rows, rows)]


def test_provenance_counts_what_has_a_rationale(spark):
    rows = [(1, 1, {"security": 1, "power": -1, "other": 1}, {"security": "why", "power": " ", "tradition": "why"}), (1, 2, {"security": 0, "power": None}, {"security": "why"}), (1, 3, {"power": 1}, None), (1, 4, {"power": 1}, {"power": None})]
    out = reviewed.provenance(spark.createDataFrame(rows, "pass int, event_id long, scores map<string,int>, rationales map<string,string>")).first()
    assert (out["n_rows"], out["n_scores"], out["n_rationales"]) == (4, 5, 1)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables here")
def test_passes_are_made_of_entries_and_not_gathered_from_votes(spark):
    sf = "/root/testdata/sf0.001"
    rows = adapter.pass_scores(spark, sf).select("persona_id", "event_id", "t_index", "d", "pass", F.explode("scores").alias("dimension", "score"))
    votes = adapter.vote(spark, sf).select(*rows.columns)
    assert rows.count() == votes.count() and rows.exceptAll(votes).isEmpty()
    gathered = lambda name: catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("collect_list")
    assert [gathered(x) for x in ("v13_pass_provenance", "v13_pass_similarity", "j16_pass_pairs")] == [0, 1, 1]  # an item's passes alone
