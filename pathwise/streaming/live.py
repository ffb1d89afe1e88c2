"""Journal sessions on typed state: every request answered, every effect a linked event, every decision a change row.

A request: session_id, kind, key (idempotency), revision, entry_id, t_index, date, body, seq_in (order of arrival). Kinds:
start (with the first date), entry, answer and skip (of the nudge that an entry's displayed), remove (an entry), next_day
and close_week (the logical clock), delete (the session). The log has three kinds of rows, numbered within a session:

answer    one for each request: accepted, replayed, conflict, rejected with its reason, or deleted
event     what an accepted request did, each linked to the event before it: an entry gives journal_entry_submitted and
          nudge_suppression_checked, then nudge_decided (and nudge_generated); a week's review gives five, from
          weekly_review_requested to weekly_coach_generated
decision  a verdict on an entry and value that begins (+1) or ends (-1) to stand: the changelog that `standing_changes`
          and `drift_states` fold

A week is reviewed once it ended before the current date and is final: no nudge displayed, every entry's nudge decided.
Another answer or a removal takes back the decisions of all reviewed weeks from the entry's on and reviews them again, in
order. What judges (nudge, review, coach) is injected; see `operators.judges`, which makes any function fail closed.

State is typed and keyed (`STATE`): a request reads and writes the head, its own entry, position and key, and its week, so
its cost does not grow with the session; a correction walks the weeks from the affected one on. The same steps run over a
stored log (`replay`), where a session's maps live in the task that reads its sorted rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

REQUEST = "session_id string, kind string, key string, revision long, entry_id string, t_index long, date string, body string, seq_in long"
LOG = ("session_id string, seq long, row string, key string, event_type string, event_id string, parent_id string, status string, reason string, revision long, "
       "first_event long, last_event long, entry_id string, t_index long, week_start string, value string, verdict string, change int")  # fmt: skip
#: The state: one head, and maps by key.
HEAD = "revision long, seq long, clock string, last_entry string, first_week string, last_week string, last_event string, open array<string>"
STATE = {
    "keys": ("key string", "print string, outcome string, reason string, first_event long, last_event long, retry boolean"),
    "entries": ("entry_id string", "t_index long, date string, body string, before string, after string, nudge string, decided string"),
    "positions": ("t_index long", "entry_id string"),
    "weeks": ("week string", "entries array<string>, reviewed boolean, n_history long"),
    "decisions": ("week string, t_index long, value string", "verdict string, status string"),
    "machines": ("week string, value string", "run long, open boolean, last_t long, state string"),
}
NAMES = {name: [c.split()[0] for c in value.split(", ")] for name, (_, value) in STATE.items()} | {"head": [c.split()[0] for c in HEAD.split(", ")]}
COLUMNS = [c.split()[0] for c in LOG.split(", ")]

#: A judge's status and the event's, outcomes of a nudge that count as shown, statuses that decide one.
EVENT_STATUS = {"ok": "complete", "refusal": "refused", "invalid": "invalid", "error": "failed"}
SHOWN = ("displayed", "skipped", "answered")
DECIDED = ("complete", "refused", "invalid")
WINDOW, MOST_SHOWN = 3, 2


@dataclass(frozen=True)
class Judges:
    """What is injected. nudge(entry) -> {status, display}; review(request) -> {status, verdicts: {(t_index, value): verdict}};
    coach(request) -> {status}. A status is ok, refusal, invalid or error."""

    values: tuple[str, ...]
    nudge: Callable[[dict], dict]
    review: Callable[[dict], dict]
    coach: Callable[[dict], dict]


class Maps:
    """A session's state in memory."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.held: dict = {name: {} for name in ("head", *STATE)}

    def get(self, name: str, *key) -> dict | None:
        found = self.held[name].get(key)
        return None if found is None else dict(found)

    def put(self, name: str, value: dict, *key) -> None:
        self.held[name][key] = value

    def drop(self, name: str, *key) -> None:
        self.held[name].pop(key, None)


class StateMaps:
    """The same on a stateful operator's handles."""

    def __init__(self, handle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.maps = {name: handle.getMapState(name, key, value) for name, (key, value) in STATE.items()}

    def clear(self) -> None:
        self.head.clear()
        for state in self.maps.values():
            state.clear()

    def get(self, name: str, *key) -> dict | None:
        if name == "head":
            found = self.head.get() if self.head.exists() else None
        else:
            found = self.maps[name].getValue(key) if self.maps[name].containsKey(key) else None
        return None if found is None else {c: list(v) if isinstance(v, (list, tuple)) else v for c, v in zip(NAMES[name], found, strict=True)}

    def put(self, name: str, value: dict, *key) -> None:
        row = tuple(value[c] for c in NAMES[name])
        if name == "head":
            self.head.update(row)
        else:
            self.maps[name].updateValue(key, row)

    def drop(self, name: str, *key) -> None:
        if self.maps[name].containsKey(key):
            self.maps[name].removeKey(key)


def _day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text) if text and len(text) == 10 else None
    except ValueError:
        return None


@lru_cache(1 << 14)
def week_of(day: str) -> str:
    d = dt.date.fromisoformat(day)
    return (d - dt.timedelta(days=d.weekday())).isoformat()


@lru_cache(1 << 14)
def _later(week: str, days: int) -> str:
    return (dt.date.fromisoformat(week) + dt.timedelta(days=days)).isoformat()


def machine_step(was: dict | None, t_index: int, verdict: str, status: str) -> dict:
    """One transition of the three-state machine (`episodes.transitions` has it in windows)."""
    was = was or {"run": 0, "open": False, "last_t": None}
    ok, gap = status == "ok", was["last_t"] is not None and t_index != was["last_t"] + 1
    conflict, clear = ok and verdict == "conflict", ok and verdict == "not_conflict"
    run = (0 if gap else was["run"]) + 1 if conflict else 0
    if not ok:
        state = "insufficient_evidence"
    elif clear:
        state = "no_active_drift"
    elif run >= 2:
        state = "active_drift"
    else:
        state = "insufficient_evidence" if was["open"] else "no_active_drift"
    return {"run": run, "open": False if clear else was["open"] or conflict or not ok, "last_t": t_index, "state": state}


@dataclass
class Session:
    """One session's steps over its state."""

    id: str
    state: Maps | StateMaps
    judges: Judges
    rows: list[dict] = field(default_factory=list)

    def _row(self, head: dict, **values) -> dict:
        head["seq"] += 1
        out = dict.fromkeys(COLUMNS) | {"session_id": self.id, "seq": head["seq"], "revision": head["revision"]} | values
        self.rows.append(out)
        return out

    def _event(self, head: dict, event_type: str, status: str = "complete", **values) -> None:
        """An event, linked to the last one."""
        row = self._row(head, row="event", event_type=event_type, status=status, parent_id=head["last_event"], **values)
        row["event_id"] = head["last_event"] = f"{self.id}:{row['seq']}"

    def handle(self, request: dict) -> list[dict]:
        """The log's rows for one request."""
        self.rows = []
        head = self.state.get("head") or {"revision": 0, "seq": 0, "clock": None, "last_entry": None, "first_week": None, "last_week": None, "last_event": None, "open": []}
        key, fingerprint = request["key"], _fingerprint(request)
        known = self.state.get("keys", key) if key is not None else None
        if known and known["print"] != fingerprint:
            self._row(head, row="answer", key=key, status="conflict", reason="key was used for another request")
        elif known and not known["retry"]:
            self._row(head, row="answer", key=key, status="replayed", reason=known["reason"], event_type=known["outcome"], first_event=known["first_event"], last_event=known["last_event"])
        elif request["kind"] == "delete":
            self.state.clear()
            head = {**head, "revision": 0, "seq": 0}
            self._row(head, row="answer", key=key, status="deleted")
            return self.rows
        else:
            began = head["seq"] + 1
            why, retry = self._retry_nudge(head, request) if known else self._apply(head, request)
            outcome = "rejected" if why else "accepted"
            first, last = (began, head["seq"]) if head["seq"] >= began else (None, None)
            self._row(head, row="answer", key=key, status=outcome, reason=why, first_event=first, last_event=last)
            if key is not None:
                self.state.put("keys", {"print": fingerprint, "outcome": outcome, "reason": why, "first_event": first, "last_event": last, "retry": retry}, key)
        self.state.put("head", head)
        return self.rows

    def _apply(self, head: dict, request: dict) -> tuple[str | None, bool]:
        """What a new request does: the reason why not, and whether the same request may be sent again for its nudge."""
        kind = request["kind"]
        if kind == "start":
            if head["last_event"] is not None:
                return "session has begun", False
            if request["date"] is not None and not _day(request["date"]):
                return "bad date", False
            head["clock"] = request["date"]
            self._event(head, "profile_confirmed")
            return None, False
        if kind == "entry":
            why = self._out_of_order(head, request)
            return (why, False) if why else (None, self._enter(head, request))
        if kind in ("next_day", "close_week"):
            if head["clock"] is None:
                return "no clock", False
            head["clock"] = _later(head["clock"], 1) if kind == "next_day" else _later(week_of(head["clock"]), 7)
            head["revision"] += 1
            self._event(head, "assessment_time_advanced")
            if kind == "close_week":
                self._due(head, head["clock"])
            return None, False
        if kind in ("answer", "skip", "remove"):
            return self._correct(head, request), False
        return "unknown kind", False

    def _out_of_order(self, head: dict, request: dict) -> str | None:
        if request["revision"] != head["revision"]:
            return "stale revision"
        if request["entry_id"] is None or request["t_index"] is None:
            return "no entry or position"
        if self.state.get("entries", request["entry_id"]):
            return "entry exists"
        if self.state.get("positions", request["t_index"]):
            return "position is taken"  # also by an entry that has been removed
        last = self.state.get("entries", head["last_entry"]) if head["last_entry"] else None
        if last and request["t_index"] <= last["t_index"]:
            return "position goes back"
        if not _day(request["date"]):
            return "bad date"
        if head["clock"] is not None and request["date"] != head["clock"]:
            return "not the current date"
        if last and request["date"] < last["date"]:
            return "date goes back"
        return None

    def _enter(self, head: dict, request: dict) -> bool:
        entry_id, week = request["entry_id"], week_of(request["date"])
        shown, at = 0, head["last_entry"]
        for _ in range(WINDOW):  # the three entries before, by their links
            if at is None:
                break
            before = self.state.get("entries", at)
            shown, at = shown + (before["nudge"] in SHOWN), before["before"]
        if head["last_entry"] is not None:
            self.state.put("entries", self.state.get("entries", head["last_entry"]) | {"after": entry_id}, head["last_entry"])
        entry = {"t_index": request["t_index"], "date": request["date"], "body": request["body"], "before": head["last_entry"], "after": None, "nudge": None, "decided": None}
        self.state.put("entries", entry, entry_id)
        self.state.put("positions", {"entry_id": entry_id}, request["t_index"])
        known = self.state.get("weeks", week)
        if known is None:
            last = self.state.get("weeks", head["last_week"]) if head["last_week"] else None
            known = {"entries": [], "reviewed": False, "n_history": last["n_history"] if last else 0}
            head["open"] = [*head["open"], week]
        self.state.put("weeks", known | {"entries": [*known["entries"], entry_id], "n_history": known["n_history"] + 1}, week)
        head.update(last_entry=entry_id, last_week=week, first_week=head["first_week"] or week, revision=head["revision"] + 1)
        about = {"entry_id": entry_id, "t_index": request["t_index"], "week_start": week}
        self._event(head, "journal_entry_submitted", **about)
        self._event(head, "nudge_suppression_checked", reason="suppressed" if shown >= MOST_SHOWN else None, **about)
        retry = self._nudge(head, entry_id, entry)
        self._due(head, request["date"])
        return retry

    def _nudge(self, head: dict, entry_id: str, entry: dict) -> bool:
        found = self.judges.nudge({"session_id": self.id, "entry_id": entry_id, **entry})
        status, display = EVENT_STATUS[found["status"]], found["status"] == "ok" and bool(found.get("display"))
        about = {"entry_id": entry_id, "t_index": entry["t_index"], "week_start": week_of(entry["date"])}
        self._event(head, "nudge_decided", status, **about)
        if display:
            self._event(head, "nudge_generated", **about)
        nudge = ("displayed" if display else "no_nudge") if found["status"] == "ok" else None
        self.state.put("entries", self.state.get("entries", entry_id) | {"nudge": nudge, "decided": status}, entry_id)
        return status == "failed"

    def _retry_nudge(self, head: dict, request: dict) -> tuple[None, bool]:
        entry = self.state.get("entries", request["entry_id"])
        retry = self._nudge(head, request["entry_id"], entry) if entry else False
        self._due(head, request["date"])
        return None, retry

    def _final(self, week: dict) -> bool:
        every = [self.state.get("entries", x) for x in week["entries"]]
        return all(e["nudge"] != "displayed" and (e["nudge"] is not None or e["decided"] in DECIDED) for e in every)

    def _due(self, head: dict, now: str) -> None:
        for week in sorted(head["open"]):
            known = self.state.get("weeks", week)
            if _later(week, 6) < now and known["entries"] and self._final(known):
                head["open"] = [w for w in head["open"] if w != week]
                self._review(head, week)

    def _take_back(self, head: dict, week: str, t_indices: list[int]) -> None:
        for t in t_indices:
            for value in self.judges.values:
                was = self.state.get("decisions", week, t, value)
                if was:
                    self._row(head, row="decision", week_start=week, t_index=t, value=value, verdict=was["verdict"], status=was["status"], change=-1)
                    self.state.drop("decisions", week, t, value)

    def _review(self, head: dict, week: str) -> None:
        """Reviews a week: its decisions replace those that stood, the machines go on from the week before."""
        known = self.state.get("weeks", week)
        entries = [{"entry_id": x, **self.state.get("entries", x)} for x in known["entries"]]
        found = self.judges.review({"session_id": self.id, "week_start": week, "n_history": known["n_history"], "values": self.judges.values, "entries": entries})
        self._event(head, "weekly_review_requested", week_start=week)
        self._event(head, "weekly_review_completed", EVENT_STATUS[found["status"]], week_start=week)
        self._take_back(head, week, [e["t_index"] for e in entries])
        for e in entries:
            for value in self.judges.values:
                verdict = found["verdicts"].get((e["t_index"], value), "abstain") if found["status"] == "ok" else "abstain"
                self.state.put("decisions", {"verdict": verdict, "status": found["status"]}, week, e["t_index"], value)
                self._row(head, row="decision", week_start=week, entry_id=e["entry_id"], t_index=e["t_index"], value=value, verdict=verdict, status=found["status"], change=1)
        self.state.put("weeks", known | {"reviewed": True}, week)
        states = self._drift(head, week)
        ranks = ("no_active_drift", "insufficient_evidence", "active_drift")
        drift = max((s["state"] for s in states.values()), key=ranks.index, default="no_active_drift")
        self._event(head, "drift_detected", week_start=week, verdict=drift)
        self._event(head, "weekly_digest_built", week_start=week)
        coach = self.judges.coach({"session_id": self.id, "week_start": week, "drift": drift})
        self._event(head, "weekly_coach_generated", EVENT_STATUS[coach["status"]], week_start=week)

    def _drift(self, head: dict, week: str) -> dict[str, dict]:
        """The machines after the last reviewed week, carried on from the one before `week`."""
        before = _later(week, -7)
        while before >= head["first_week"] and not (self.state.get("weeks", before) or {"reviewed": False})["reviewed"]:
            before = _later(before, -7)
        now = {value: self.state.get("machines", before, value) for value in self.judges.values} if before >= head["first_week"] else dict.fromkeys(self.judges.values)
        at = week
        while at <= head["last_week"]:
            known = self.state.get("weeks", at)
            if known and known["reviewed"]:
                for value in self.judges.values:
                    for t in sorted(self.state.get("entries", x)["t_index"] for x in known["entries"]):
                        d = self.state.get("decisions", at, t, value)
                        if d:
                            now[value] = machine_step(now[value], t, d["verdict"], d["status"])
                    if now[value]:
                        self.state.put("machines", now[value], at, value)
                    else:
                        self.state.drop("machines", at, value)
            at = _later(at, 7)
        return {value: m for value, m in now.items() if m}

    def _correct(self, head: dict, request: dict) -> str | None:
        """An answered or skipped nudge or a removed entry: what stood from its week on is taken back and reviewed again."""
        kind, entry_id = request["kind"], request["entry_id"]
        entry = self.state.get("entries", entry_id) if entry_id is not None else None
        if entry is None:
            return "no such entry"
        if kind != "remove" and entry["nudge"] != "displayed":
            return "no nudge waits"
        if kind == "answer" and not request["body"]:
            return "no answer"
        head["revision"] += 1
        first = week_of(entry["date"])
        self._event(head, {"answer": "nudge_answered", "skip": "nudge_skipped", "remove": "journal_entry_removed"}[kind], entry_id=entry_id, t_index=entry["t_index"], week_start=first)
        again, week = [], first
        while week <= head["last_week"]:
            known = self.state.get("weeks", week)
            if known:
                if known["reviewed"]:
                    self._take_back(head, week, [self.state.get("entries", x)["t_index"] for x in known["entries"]])
                    again.append(week)
                if kind == "remove":
                    self.state.put("weeks", known | {"entries": [x for x in known["entries"] if x != entry_id], "n_history": known["n_history"] - 1}, week)
            week = _later(week, 7)
        if kind == "remove":
            for side, link in (("before", "after"), ("after", "before")):
                if entry[side] is not None:
                    self.state.put("entries", self.state.get("entries", entry[side]) | {link: entry[link]}, entry[side])
            if head["last_entry"] == entry_id:
                head["last_entry"] = entry["before"]
            self.state.drop("entries", entry_id)
        else:
            body = f"{entry['body'] or ''}\n\nResponse: {request['body']}" if kind == "answer" else entry["body"]
            self.state.put("entries", entry | {"nudge": "answered" if kind == "answer" else "skipped", "body": body}, entry_id)
        self._drift(head, first)
        for week in again:
            if self.state.get("weeks", week)["entries"]:
                self._review(head, week)
        return None


def _fingerprint(request: dict) -> str:
    return hashlib.sha256(json.dumps([request[c] for c in ("kind", "revision", "entry_id", "t_index", "date", "body")]).encode()).hexdigest()


def _requests(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            for c in ("revision", "t_index", "seq_in"):
                row[c] = None if row[c] is None else int(row[c])
            yield row


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({c: "Int64" for c in ("first_event", "last_event", "t_index")} | {"change": "Int32"})


class _Live(StatefulProcessor):
    def __init__(self, judges: Judges):
        self.judges = judges

    def init(self, handle) -> None:
        self.state = StateMaps(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = Session(key[0], self.state, self.judges)
        # A shuffle keeps no order: the requests of one batch are taken in order of arrival.
        for request in sorted(_requests(rows), key=lambda r: (r["seq_in"] is None, r["seq_in"] or 0)):
            yield _frame(session.handle(request))

    def close(self) -> None:
        pass


def ingest(requests: DataFrame, judges: Judges) -> DataFrame:
    """Streaming: the log of the requests' sessions. State needs the RocksDB store: see `session_conf`."""
    return requests.groupBy("session_id").transformWithStateInPandas(_Live(judges), LOG, "Append", "None")


#: What a session needs for typed state.
SESSION_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: The log's columns as Arrow arrays.
KINDS = {name: {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind] for name, kind in (c.split() for c in LOG.split(", "))}


def replay(requests: DataFrame, judges: Judges, row: str | None = None, parts: int | None = None) -> DataFrame:
    """Batch: the same log over stored requests; a session's rows are sorted in Spark and streamed through one task. With
    `row`, only the log's rows of this kind, so that the others are not sent to Spark. Sessions are dealt over `parts`
    partitions; without it Spark merges partitions by the requests' size, which is small beside the work on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session: Session | None = None
        for batch in batches:
            out = []
            for request in batch.to_pylist():
                if session is None or session.id != request["session_id"]:
                    session = Session(request["session_id"], Maps(), judges)
                made = session.handle(request)
                out += made if row is None else [r for r in made if r["row"] == row]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in KINDS.items()], list(KINDS))

    names = [c.split()[0] for c in REQUEST.split(", ")]
    return requests.where("session_id is not null").select(*names).repartition(*([parts] if parts else []), "session_id").sortWithinPartitions("session_id", F.col("seq_in").asc_nulls_last()).mapInArrow(run, LOG)


def changes(log: DataFrame) -> DataFrame:
    """The changelog of decisions in a log."""
    return log.where("row = 'decision'").select("session_id", "seq", "week_start", "t_index", "value", "verdict", "status", "change")


def standing_changes(changelog: DataFrame) -> DataFrame:
    """Batch: the decisions that stand after all changes, as `episodes.transitions` wants them."""
    keys = ["session_id", "value", "t_index", "week_start", "verdict", "status"]
    return changelog.groupBy(*keys).agg(F.sum("change").alias("n")).where("n > 0").drop("n").withColumnRenamed("status", "review_status")


class _Fold(StatefulProcessor):
    """Folds changes of one trajectory: verdicts by position, the machine after each position."""

    def init(self, handle) -> None:
        self.verdicts = handle.getMapState("verdicts", "t_index long", "verdict string, status string, n long")
        self.head = handle.getValueState("head", "last_t long, run long, open boolean, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r["seq"])
        head = self.head.get() if self.head.exists() else None
        last, ahead = head[0] if head else None, True
        for r in found:
            t, change = int(r["t_index"]), int(r["change"])
            was = self.verdicts.getValue((t,)) if self.verdicts.containsKey((t,)) else None
            ahead = ahead and was is None and change > 0 and (last is None or t > last)
            if change > 0:
                self.verdicts.updateValue((t,), (r["verdict"], r["status"], 1))
            elif was:
                self.verdicts.removeKey((t,))
            last = t if last is None else max(last, t)
        if ahead:  # only new positions after the last: the machine goes on from where it stood
            now = {"last_t": head[0], "run": head[1], "open": head[2], "state": head[3]} if head else None
            steps = sorted((int(r["t_index"]), r["verdict"], r["status"]) for r in found)
        else:
            now, steps = None, sorted((k[0], v[0], v[1]) for k, v in self.verdicts.iterator())
        for t, verdict, status in steps:
            now = machine_step(now, t, verdict, status)
        if now:
            self.head.update((now["last_t"], now["run"], now["open"], now["state"]))
        else:
            self.head.clear()
        out = {"session_id": key[0], "value": key[1], "seq": max(int(r["seq"]) for r in found), "state": now["state"] if now else None, "run_length": now["run"] if now else None, "t_index": now["last_t"] if now else None}
        yield pd.DataFrame([out]).astype({"run_length": "Int64", "t_index": "Int64"})

    def close(self) -> None:
        pass


def drift_states(changelog: DataFrame) -> DataFrame:
    """Streaming: the state of each trajectory after every batch that changes it; null where no decision is left."""
    return changelog.groupBy("session_id", "value").transformWithStateInPandas(_Fold(), "session_id string, value string, seq long, state string, run_length long, t_index long", "Append", "None")


#: Statuses of an event that has ended, and of one that has failed.
TERMINAL = ("complete", "reused", "refused", "invalid", "failed")
FAILED = ("refused", "invalid", "failed")


def lifecycle_problems(events: DataFrame) -> DataFrame:
    """event_id and problem of events that break their lifecycle. events: event_id, status, started_at, completed_at,
    duration_ms, error, valid (of its validation, null without one)."""
    status, ended = F.col("status"), F.col("completed_at").isNotNull() | F.col("duration_ms").isNotNull()
    over = status.isin(*TERMINAL)
    checks = {
        "unknown status": ~F.coalesce(status.isin(*TERMINAL, "queued", "running"), F.lit(False)),
        "no completion timing": over & (F.col("completed_at").isNull() | F.col("duration_ms").isNull()),
        "completion precedes start": over & F.coalesce(F.col("completed_at") < F.col("started_at"), F.lit(False)),
        "complete before the end": status.isin("queued", "running") & ended,
        "no error": status.isin(*FAILED) & F.col("error").isNull(), "error of a success": status.isin("complete", "reused") & F.col("error").isNotNull(),
        "no failed validation": (status == "invalid") & F.coalesce(F.col("valid"), F.lit(True)),
    }
    return events.select("event_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))).alias("problem"))


def session_problems(sessions: DataFrame, entries: DataFrame, event_ids: DataFrame) -> DataFrame:
    """session_id and problem. sessions: session_id, profile_session_id, clock; entries: session_id, place (order of storage),
    t_index, date; event_ids: session_id, event_id."""
    w = Window.partitionBy("session_id").orderBy("place")
    back = F.coalesce(F.col("t_index") <= F.lag("t_index").over(w), F.lit(False))
    of_entries = entries.withColumn("_back", back).groupBy("session_id").agg(F.bool_or("_back").alias("_back"), F.max_by("date", "place").alias("_last"))
    of_events = event_ids.groupBy("session_id").agg((F.count("event_id") != F.count_distinct("event_id")).alias("_twice"))
    rows = sessions.join(of_entries, "session_id", "left").join(of_events, "session_id", "left")
    no = F.lit(False)
    checks = {"profile of another session": ~F.col("profile_session_id").eqNullSafe(F.col("session_id")), "positions not unique and ascending": F.coalesce("_back", no),
              "clock precedes entries": F.coalesce(F.col("clock") < F.col("_last"), no), "event ids not unique": F.coalesce("_twice", no)}
    return rows.select("session_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))).alias("problem"))
