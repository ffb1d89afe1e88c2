"""Trajectory rules on small literals and against plain Python twins on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from pathwise.operators import detectors as det
from pathwise.operators import episodes as epi
from pathwise.operators import sequence as seq

LABELS = "persona_id long, dimension string, t_index long, d date, score int, confidence string, agreement double"
DECISIONS = "persona_id long, dimension string, t_index long, d date, verdict string, review_status string"


def labels(spark, scores, tiers=None, t=None, dim="security"):
    import datetime as dt

    t = t or range(len(scores))
    return spark.createDataFrame([(1, dim, i, dt.date(2025, 1, 1), s, (tiers or {}).get(i, "high"), 1.0) for i, s in zip(t, scores, strict=True)], LABELS)


def decisions(spark, verdicts, t=None, dim="a"):
    import datetime as dt

    t = t or range(len(verdicts))
    return spark.createDataFrame([(1, dim, i, dt.date(2025, 1, 1), "abstain" if v == "refusal" else v, v if v == "refusal" else "ok") for i, v in zip(t, verdicts, strict=True)], DECISIONS)


@pytest.mark.parametrize(("scores", "tiers", "want"), [
    ([-1, -1, -1], {}, [(0, 1, 2, 3, True, "active")]),
    ([-1, -1, 0, -1, -1], {}, [(0, 1, 1, 2, False, "recovered"), (3, 4, 4, 2, True, "active")]),
    ([-1, -1, 0, -1], {2: "no_majority"}, [(0, 1, 1, 2, False, "uncertain")]),
    ([-1, -1, None], {}, [(0, 1, 1, 2, False, "uncertain")]),
    ([-1, None, -1], {}, []),
])
def test_reference_episodes(spark, scores, tiers, want):
    rows = seq.reference_episodes(labels(spark, scores, tiers)).orderBy("onset_t_index").collect()
    assert [(r.onset_t_index, r.confirmation_t_index, r.end_t_index, r.length, r.open_at_cutoff, r.delivery_state) for r in rows] == want


def test_gaps_break_runs(spark):
    assert seq.reference_episodes(labels(spark, [-1, -1], t=[0, 2])).count() == 0
    by_position = seq.flagged_runs(labels(spark, [-1, -1], t=[0, 2]), F.col("score") == -1, by_position=True)
    assert {r.run for r in by_position.collect()} == {0}


def machine(rows):
    """The rules as a loop."""
    out, state, run, open_, last, before = [], "no_active_drift", 0, False, None, None
    for t, verdict, status in rows:
        gap = before is not None and t != before + 1
        if gap:
            if run or state != "no_active_drift":
                open_, state = True, "insufficient_evidence"
            run, last = 0, None
        live = run > 0 or state != "no_active_drift"
        if status != "ok":
            state, open_, run, effect = "insufficient_evidence", True, 0, "insufficient"
        elif verdict == "not_conflict":
            state, open_, run, effect = "no_active_drift", False, 0, "end" if live else "reset"
        elif verdict == "abstain":
            state, open_, run, effect = ("insufficient_evidence", True, 0, "insufficient") if live else ("no_active_drift", False, 0, "reset")
        else:
            run = run + 1 if last == "conflict" else 1
            if run >= 2:
                state, open_, effect = "active_drift", False, "confirm" if run == 2 else "extend"
            else:
                state, effect = ("insufficient_evidence" if open_ else "no_active_drift"), "start"
        out.append((t, state, run, gap, effect))
        before, last = t, verdict
    return out


def test_state_machine_against_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for p in range(400):
        t, mine = 0, []
        for _ in range(rng.randrange(1, 12)):
            t += 1 + (rng.random() < 0.2)
            verdict, status = rng.choice([("conflict", "ok"), ("conflict", "ok"), ("not_conflict", "ok"), ("abstain", "ok"), ("abstain", "refusal")])
            mine.append((t, verdict, status))
        want[p] = machine(mine)
        rows += [(p, "a", t, None, v, s) for t, v, s in mine]
    got = {}
    for r in epi.transitions(spark.createDataFrame(rows, DECISIONS)).orderBy("persona_id", "t_index").collect():
        got.setdefault(r.persona_id, []).append((r.t_index, r.state, r.run_length, r.gap_before, r.effect))
    assert got == want


@pytest.mark.parametrize(("verdicts", "t", "state"), [
    (["conflict"] * 3, None, "active_drift"), (["conflict"] * 3 + ["not_conflict"], None, "no_active_drift"), (["conflict", "conflict", "abstain"], None, "insufficient_evidence"),
    (["abstain"], None, "no_active_drift"), (["refusal"], None, "insufficient_evidence"), (["conflict", "conflict"], [0, 2], "insufficient_evidence"),
    (["conflict", "conflict", "abstain", "not_conflict"], None, "no_active_drift"),
])
def test_delivery(spark, verdicts, t, state):
    assert epi.delivery(decisions(spark, verdicts, t)).first()["delivery_state"] == state


def test_delivery_takes_the_gravest_value(spark):
    both = decisions(spark, ["conflict", "conflict"]).unionByName(decisions(spark, ["conflict", "abstain"], dim="b"))
    assert epi.delivery(both).first()["delivery_state"] == "active_drift"


def test_historical_drifts(spark):
    row = seq.historical_drifts(decisions(spark, ["conflict"] * 3 + ["not_conflict"])).first()
    assert (row.onset, row.end, row.termination_reason, row.termination_t_index) == (0, 2, "not_conflict", 3)
    assert seq.historical_drifts(decisions(spark, ["conflict"] * 2 + ["conflict"], t=[0, 1, 5])).first().termination_reason == "gap"
    assert seq.historical_drifts(decisions(spark, ["conflict"] * 2)).first().termination_reason is None


def evidence(spark, p, u, t=None):
    t = t or range(len(p))
    rows = [("s", 1, "a", i, None, x, y, None if x is None else (-1 if x >= 0.5 else 0)) for i, x, y in zip(t, p, u, strict=True)]
    return spark.createDataFrame(rows, "source string, persona_id long, dimension string, t_index long, d date, p_minus1 double, uncertainty double, predicted_class int")


def test_pair_gates_are_inclusive(spark):
    row = seq.detection_decisions(evidence(spark, [0.5, 0.7], [0.3, 0.2]), 0.6, 0.3).first()
    assert (round(row.mean_probability, 9), row.max_uncertainty, row.alert) == (0.6, 0.3, True)
    why = lambda p, u: seq.detection_decisions(evidence(spark, p, u), 0.6, 0.3).first().reason
    assert why([None, 0.9], [0.1, 0.1]) == "missing_probability" and why([0.1, 0.1], [None, 0.1]) == "low_probability"
    assert why([0.9, 0.9], [None, 0.1]) == "missing_uncertainty" and why([0.9, 0.9], [0.9, 0.1]) == "high_uncertainty"
    assert seq.detection_decisions(evidence(spark, [0.9, 0.9], [0.1, 0.1], t=[0, 2]), 0.6, 0.3).count() == 0


def test_predicted_episodes_end_states(spark):
    state = lambda p, u: [(r.onset_t_index, r.end_t_index, r.delivery_state) for r in seq.predicted_episodes(evidence(spark, p, u), 0.6, 0.3).orderBy("onset_t_index").collect()]
    assert state([0.9, 0.9, 0.1], [0.1] * 3) == [(0, 1, "recovered")]
    assert state([0.9, 0.9, 0.25], [0.1, 0.1, 0.5]) == [(0, 1, "uncertain")]
    assert state([0.9, 0.9, None], [0.1] * 3) == [(0, 1, "uncertain")]
    assert state([0.9, 0.9, 0.9], [0.1] * 3) == [(0, 2, "active")]


def greedy(refs, preds, lag):
    used, out = set(), []
    for r in sorted(refs, key=lambda r: r[2]):
        free = [p for p in preds if p[0] not in used and r[1] <= p[2] <= r[3] + lag]
        if free:
            best = min(free, key=lambda p: (p[2], p[0]))
            used.add(best[0])
            out.append((r[0], best[0]))
    return sorted(out)


def test_matching_against_loop(spark):
    rng, refs, preds, want = random.Random(5), [], [], []
    for persona in range(60):
        at, mine = 0, []
        for k in range(rng.randrange(0, 6)):
            at += rng.randrange(1, 6)
            end = at + rng.randrange(1, 4)
            mine.append((f"r{persona}-{k}", at, at + 1, end))
            at = end + 1
        his = [(f"p{persona}-{k}", c - 1, c, c) for k, c in enumerate(sorted(rng.sample(range(1, 40), rng.randrange(0, 8))))]
        want += greedy(mine, his, 2)
        refs += [(persona, "a", *x, "active") for x in mine]
        preds += [(persona, "a", *x, "active") for x in his]
    schema = "persona_id long, dimension string, episode_id string, onset_t_index long, confirmation_t_index long, end_t_index long, delivery_state string"
    got = epi.match_episodes(spark.createDataFrame(refs, schema), spark.createDataFrame(preds, schema)).collect()
    assert sorted((r.reference_episode_id, r.predicted_episode_id) for r in got) == sorted(want)


def test_episode_metrics(spark):
    truth = seq.reference_episodes(labels(spark, [-1, -1, 0], dim="a").unionByName(labels(spark, [0, 0, 0], dim="b")))
    soft = evidence(spark, [0.1, 0.8, 0.8], [0.1] * 3).unionByName(evidence(spark, [0.8, 0.8, 0.1], [0.1] * 3).withColumn("dimension", F.lit("b")))
    predicted, pairs = seq.predicted_episodes(soft, 0.7, 0.3), seq.detection_decisions(soft, 0.7, 0.3)
    row = epi.episode_metrics(truth, predicted, soft.groupBy("persona_id", "dimension").agg(F.count(F.lit(1)).alias("n_entries")), pairs).first()
    assert (row.true_positive, row.precision, row.recall, row.trajectory_false_alarm_rate, row.mean_latency, row.recovery_accuracy) == (1, 0.5, 1.0, 1.0, 1.0, 0.0)
    assert row.false_positive_rate == pytest.approx(2 / 3)


def merged(spans):
    kept = []
    for s in sorted(spans):
        hit = next((k for k in kept if s[1] <= k[2] and s[2] >= k[1]), None)
        if hit:
            hit[2] = max(hit[2], s[2])
        else:
            kept.append(list(s))
    return sorted(map(tuple, kept))


def test_overlap_merge_against_loop(spark):
    rng, rows, want = random.Random(9), [], []
    for case in range(80):
        spans = []
        for _ in range(rng.randrange(1, 9)):
            a = rng.randrange(30)
            spans.append((rng.randrange(10**6), a, a + rng.randrange(6)))
        want += [(case, *s) for s in merged(spans)]
        rows += [(case, *s) for s in spans]
    got = epi.merge_overlaps(spark.createDataFrame(rows, "case_id long, alert long, onset long, end long")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_detectors_against_loops(spark):
    rng, rows, ema, cusum, rut = random.Random(2), [], set(), set(), set()
    for p in range(20):
        e, s, low, prev = 0.0, 0.0, 0, None
        for t in range(150):
            x = round(rng.uniform(-1, 1), 3)
            rows.append((p, "a", t, x, 0.5))
            short = 0.5 * max(0.0, -x)
            e, s = 0.3 * short + 0.7 * e, max(0.0, s + short - 0.12)
            low = low + 1 if x < -0.4 and t else 0
            if e > 0.10:
                ema.add((p, t))
            if s > 0.5:
                cusum.add((p, t))
            if low == 3 or (prev is not None and prev >= 0 > x):
                rut.add((p, t))
            prev = x
    df = det.positions(spark.createDataFrame(rows, "persona_id long, dimension string, t_index long, score double, weight double"))
    found = lambda d: {(r.persona_id, r.t_index) for r in d.collect()}
    assert found(det.ema(df)) == ema and found(det.crash_or_rut(df)) == rut
    assert len(found(det.cusum(df, 0.12, 0.5)) ^ cusum) <= 1  # sums in another order


def test_change_points_against_all_segmentations(spark):
    """The posterior of a run beginning at t, summed over every way to cut the rows up to t."""
    from itertools import product

    from pathwise.operators import change_points as cps

    scores, h = [0, 0, 1, 1, -1, 1, 1], 0.1

    def likelihood(part):
        p, n = 1.0, {-1: 1.0, 0: 1.0, 1: 1.0}
        for s in part:
            p *= n[s] / sum(n.values())
            n[s] += 1
        return p

    want = []
    for t in range(1, len(scores) + 1):
        mass = {True: 0.0, False: 0.0}
        for cuts in product([False, True], repeat=t):  # cuts[k]: a run begins at k; with none at 0 the first run began before
            p, begin = 1.0, 0
            for k, cut in enumerate(cuts):
                p *= h if cut else 1 - h
                if cut and k > begin:
                    p *= likelihood(scores[begin:k])
                    begin = k
            mass[cuts[-1]] += p * likelihood(scores[begin:t])
        want.append(mass[True] / sum(mass.values()))
    df = spark.createDataFrame([(1, "a", k, s) for k, s in enumerate(scores)], "persona_id long, dimension string, t_index long, score int")
    got = [r.p_change for r in cps.change_points(df).orderBy("t_index").collect()]
    assert got == pytest.approx(want)


def test_empty_tables(spark):
    no_labels, no_decisions, no_evidence = labels(spark, []), decisions(spark, []), evidence(spark, [], [])
    assert seq.reference_episodes(no_labels).count() == 0 == epi.transitions(no_decisions).count() == seq.predicted_episodes(no_evidence, 0.5, None).count()
    assert seq.coverage(no_decisions.withColumn("label", F.lit(None).cast("boolean"))).count() == 0


def test_control_chart_takes_a_score_on_its_limit_as_on_it(spark):
    """Warm-ups p, p, q, q end at (3q - p) / 2, which is their limit however its digits are rounded."""
    rows = []
    for a in range(0, 60):
        for b in range(0, a, 2):
            p, q = a / 50, b / 50
            rows += [(a * 100 + b, "x", t, score, 0.5) for t, score in enumerate([p, p, q, q] + [3.0] * 8 + [(3 * b - a) / 100, (3 * b - a) / 100 - 1e-6])]
    df = det.positions(spark.createDataFrame(rows, "persona_id long, dimension string, t_index long, score double, weight double"))
    found = {r["t_index"]: r["count"] for r in det.control_chart(df).groupBy("t_index").count().collect()}
    assert found == {13: len(rows) // 14}
