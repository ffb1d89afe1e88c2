"""Sessions on typed state: stream, restarted stream and replay agree; corrections equal a recomputation; judges fail closed."""

import datetime as dt
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pathwise.operators import episodes, judges
from pathwise.streaming import live

NAMES = [c.split()[0] for c in live.REQUEST.split(", ")]


def _hash(*x):
    return zlib.crc32("|".join(map(str, x)).encode())


def _nudge(entry):
    k = _hash("n", entry["session_id"], entry["entry_id"], entry["body"]) % 10
    return {"status": "refusal" if k == 0 else "ok", "display": k in (1, 2)}


def _review(request):
    verdicts = {(e["t_index"], v): ("conflict", "not_conflict", "abstain", "conflict")[_hash(e["entry_id"], v, e["body"]) % 4] for e in request["entries"] for v in request["values"]}
    return {"status": "error" if _hash("r", request["session_id"], request["week_start"]) % 8 == 0 else "ok", "verdicts": verdicts}


JUDGES = live.Judges(("a", "b"), _nudge, _review, lambda r: {"status": "ok"})


def _request(**values):
    return dict.fromkeys(NAMES) | {"session_id": "s"} | values


def _traffic(sessions: int, steps: int) -> list[dict]:
    """Entries with fitting and stale revisions, answers, removals and repeats, as clients that know their session send them."""
    rng, out = random.Random(2), []
    for s in range(sessions):
        session, day, own, ids = live.Session(f"s{s}", live.Maps(), JUDGES), dt.date(2024, 1, 1), [], []
        for t in range(steps):
            head, x = session.state.get("head") or {"revision": 0}, rng.random()
            if x < 0.7 or not ids:
                day += dt.timedelta(days=rng.choice([0, 1, 2, 3]))
                ids.append(f"e{t}")
                request = _request(session_id=f"s{s}", kind="entry", key=f"k{t}", revision=head["revision"] - (rng.random() < 0.1), entry_id=ids[-1], t_index=t, date=day.isoformat(), body="text")
            elif x < 0.9:
                request = _request(session_id=f"s{s}", kind=rng.choice(["answer", "skip", "remove"]), key=f"k{t}", entry_id=rng.choice(ids), body="yes")
            else:
                request = dict(rng.choice(own)) | ({"body": "other"} if rng.random() < 0.3 else {})
            own.append(request | {"seq_in": t})
            session.handle(own[-1])
        out += own
    return out


def _table(spark, requests):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in requests], live.REQUEST)


def _rows(df):
    return sorted((tuple(r) for r in df.select(*live.COLUMNS).collect()), key=lambda r: r[:2])


def test_replay_of_one_kind_of_row_and_of_large_positions(spark):
    """The rows of one kind are those of the whole log; a position beyond 2^53 stays what it is beside nulls."""
    requests, far = _traffic(3, 24), 2**53 + 1
    entry = _request(session_id="far", kind="entry", key="k", revision=0, entry_id="e", t_index=far, date="2024-01-01", seq_in=0)
    table = _table(spark, [*requests, entry, _request(session_id="far", kind="remove", key="r", entry_id="e", seq_in=1)]).coalesce(1)
    whole = _rows(live.replay(table, JUDGES))
    assert {r[live.COLUMNS.index("t_index")] for r in whole if r[0] == "far"} == {far, None}
    for kind in ("answer", "event", "decision"):
        rows = _rows(live.replay(table, JUDGES, kind))
        assert rows and rows == [r for r in whole if r[2] == kind]
    dealt = live.replay(table, JUDGES, parts=7)
    assert dealt.rdd.getNumPartitions() == 7 and _rows(dealt) == whole


def test_stream_restart_replay_and_fold(spark, tmp_path):
    requests = _traffic(4, 36)
    expected = _rows(live.replay(_table(spark, requests).repartition(3), JUDGES))
    kinds = {(r[2], r[7]) for r in expected}
    assert {("answer", x) for x in ("accepted", "rejected", "replayed", "conflict")} <= kinds
    for key, value in live.SESSION_CONF.items():
        spark.conf.set(key, value)
    try:
        source, folder, point = (str(tmp_path / x) for x in ("in", "out", "point"))
        by_arrival = sorted(requests, key=lambda r: r["seq_in"])
        for k in range(3):
            _table(spark, by_arrival[k * 48 : (k + 1) * 48][::-1]).coalesce(1).write.mode("append").parquet(source)
            if k != 1:  # the query ends and starts again from its checkpoint
                stream = live.ingest(spark.readStream.schema(live.REQUEST).option("maxFilesPerTrigger", 1).parquet(source), JUDGES)
                query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", point).trigger(availableNow=True).start()
                query.awaitTermination(300)
                assert query.exception() is None
        log = spark.read.parquet(folder)
        assert _rows(log) == expected
        changes = live.changes(log)
        for k in range(2):
            changes.where((F.col("seq") > 120) == F.lit(bool(k))).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        stream = live.drift_states(spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes")))
        query = stream.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "fold")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        folded = spark.table("folded").groupBy("session_id", "value").agg(F.max_by(F.struct("state", "run_length", "t_index"), "seq").alias("x")).select("session_id", "value", "x.*").where("state is not null")
        standing = live.standing_changes(changes).withColumn("d", F.col("week_start"))
        current = episodes.current_states(standing, ("session_id", "value")).select("session_id", "value", "state", "run_length", "t_index")
        assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, current.collect()))
    finally:
        for key in live.SESSION_CONF:
            spark.conf.unset(key)


def test_corrections_equal_a_recomputation():
    """What stands after a removal is what a session without that entry's text would have decided."""
    requests = [_request(kind="entry", key=f"k{t}", revision=t, entry_id=f"e{t}", t_index=t, date=(dt.date(2024, 1, 1) + dt.timedelta(days=2 * t)).isoformat(), body="") for t in range(20)]
    quiet = live.Judges(("a", "b"), lambda e: {"status": "ok"}, _review, lambda r: {"status": "ok"})
    session = live.Session("s", live.Maps(), quiet)
    log = [row for r in requests for row in session.handle(r)]
    log += session.handle(_request(kind="remove", key="gone", entry_id="e5"))
    other = live.Session("s", live.Maps(), quiet)
    fresh = []
    for n, r in enumerate(x for x in requests if x["entry_id"] != "e5"):
        fresh += other.handle(r | {"revision": n})
    standing = lambda rows: sorted((r["week_start"], r["t_index"], r["value"], r["verdict"], r["status"]) for r in rows if r["row"] == "decision" and r["change"] > 0 and (r["week_start"], r["t_index"], r["value"]) in session.state.held["decisions"] and r["t_index"] != 5)
    assert sorted(session.state.held["decisions"].items()) == sorted(other.state.held["decisions"].items())
    assert set(standing(log)) == set(standing(fresh))
    net = {}
    for r in log:
        if r["row"] == "decision":
            k = (r["week_start"], r["t_index"], r["value"], r["verdict"])
            net[k] = net.get(k, 0) + r["change"]
    assert set(net.values()) <= {0, 1} and sum(net.values()) == len(session.state.held["decisions"])
    again = [r["week_start"] for r in log[[r["event_type"] for r in log].index("journal_entry_removed") :] if r["event_type"] == "weekly_review_requested"]
    assert again == sorted(again) and again[0] == "2024-01-08"


def test_events_are_linked_and_rules_hold():
    session = live.Session("s", live.Maps(), live.Judges(("a",), lambda e: {"status": "error"} if e["entry_id"] == "e1" and not e["decided"] else {"status": "ok", "display": e["entry_id"] == "e0"}, _review, lambda r: {"status": "invalid"}))
    types = lambda rows: [r["event_type"] or r["status"] for r in rows]
    assert types(session.handle(_request(kind="start", key="a", date="2024-01-05"))) == ["profile_confirmed", "accepted"]
    assert types(session.handle(_request(kind="start", key="b"))) == ["rejected"]
    entry = _request(kind="entry", key="c", revision=0, entry_id="e0", t_index=0, date="2024-01-05")
    rows = session.handle(entry)
    assert types(rows) == ["journal_entry_submitted", "nudge_suppression_checked", "nudge_decided", "nudge_generated", "accepted"]
    assert [r["parent_id"] for r in rows[:4]] == ["s:1", *(r["event_id"] for r in rows[:3])]
    assert session.handle(entry)[0]["status"] == "replayed" and session.handle(entry | {"body": "x"})[0]["status"] == "conflict"
    rows = session.handle(_request(kind="entry", key="d", revision=1, entry_id="e1", t_index=0, date="2024-01-05"))
    assert (rows[-1]["status"], rows[-1]["reason"]) == ("rejected", "position is taken")
    assert session.handle(_request(kind="entry", key="e", revision=1, entry_id="e1", t_index=1, date="2024-01-06"))[-1]["reason"] == "not the current date"
    failed = _request(kind="entry", key="f", revision=1, entry_id="e1", t_index=1, date="2024-01-05")
    assert types(session.handle(failed))[-2:] == ["nudge_decided", "accepted"]
    assert types(session.handle(_request(kind="close_week", key="g"))) == ["assessment_time_advanced", "accepted"]  # a nudge waits, another failed
    assert types(session.handle(failed)) == ["nudge_decided", "accepted"] and session.handle(failed)[0]["status"] == "replayed"
    assert types(session.handle(_request(kind="answer", key="h", entry_id="e0", body="because"))) == ["nudge_answered", "accepted"]
    assert session.handle(_request(kind="skip", key="i", entry_id="e0"))[-1]["reason"] == "no nudge waits"
    rows = session.handle(_request(kind="close_week", key="j"))
    assert [r["event_type"] for r in rows if r["row"] == "event"][1:] == ["weekly_review_requested", "weekly_review_completed", "drift_detected", "weekly_digest_built", "weekly_coach_generated"]
    assert session.handle(_request(kind="delete", key="k"))[0]["status"] == "deleted" and not session.state.held["entries"]
    assert session.handle(_request(kind="next_day", key="l"))[-1]["reason"] == "no clock"
    assert session.handle(_request(kind="dance", key="m"))[-1]["reason"] == "unknown kind"


def test_judges_fail_closed():
    request = {"case": "1", "items": [{"id": "x", "payload": ""}, {"id": "y", "payload": ""}]}
    calls = []

    def flaky(r):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("down")
        return {"x": "conflict", "y": "abstain"}

    got = judges.guarded(flaky)(request)
    assert (got["status"], got["attempts"], got["verdicts"]) == ("ok", 3, {"x": "conflict", "y": "abstain"})
    for function, status in ((lambda r: {"x": "conflict"}, "invalid"), (lambda r: {"x": "conflict", "y": "maybe"}, "invalid"), (lambda r: None, "invalid"), (lambda r: 1 / 0, "error"), (lambda r: time.sleep(5), "error")):
        got = judges.guarded(function, attempts=2, seconds=0.1)(request)
        assert (got["status"], got["verdicts"]) == (status, {})

    def declines(r):
        raise judges.Refusal("no")

    assert judges.guarded(declines)(request) == {"status": "refusal", "reason": "no", "attempts": 1, "verdicts": {}}


def test_judged_rows(spark):
    items = spark.createDataFrame([("a", str(k), "p", 1) for k in range(9)] + [("b", "1", None, 1), (None, "1", "p", 1)], "case_id string, item_id string, payload string, status int")
    out = judges.judged(items, lambda r: {x["id"]: "conflict" for x in r["items"]} if r["case"] == "a" else {}, attempts=1).collect()
    assert sorted((r["case_id"], r["verdict"], r["status"]) for r in out) == [("a", "conflict", "ok")] * 9 + [("b", "abstain", "invalid")]
    assert judges.judged(items.limit(0), lambda r: {}).count() == 0


@pytest.mark.parametrize("verdicts", [["conflict", "conflict", "abstain", "not_conflict"], ["abstain", "conflict", "conflict"], ["conflict", "gap", "conflict", "conflict"]])
def test_the_machine_agrees_with_windows(spark, verdicts):
    rows = [("s", "a", t, v, "error" if v == "not_conflict" and t > 5 else "ok") for t, v in enumerate(verdicts) if v != "gap"]
    df = spark.createDataFrame(rows, "persona_id string, dimension string, t_index long, verdict string, review_status string")
    now, steps = None, []
    for _, _, t, v, status in rows:
        now = live.machine_step(now, t, v, status)
        steps.append((t, now["state"], now["run"]))
    assert [(r["t_index"], r["state"], r["run_length"]) for r in episodes.transitions(df).orderBy("t_index").collect()] == steps
