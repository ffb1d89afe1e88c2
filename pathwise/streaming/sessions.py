"""Journal sessions as streams: ordered, idempotent ingestion per session, week closes, corrections, and plain windows.

A stream row is an event: session_id, kind (entry, advance, edit, remove, delete), key (idempotency), revision, entry_id,
t_index, date, body, seq_in (order of arrival). An edit or removal counts for the week in which its entry stands; delete
ends the session. `ingest` is stateful per session and stricter than a watermark: what is out of order is answered, not
dropped. What a closed week's review decides, and what a correction takes back, is in `reviews`.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "session_id string, kind string, key string, revision long, entry_id string, t_index long, date string, body string, seq_in long"
ANSWER = "session_id string, key string, outcome string, reason string, revision long, seq long, week_start string"
STATE = "json string"


def fresh() -> dict:
    return {"revision": 0, "seq": 0, "clock": None, "last_t": None, "last_date": None, "ids": {}, "taken": {}, "open": {}, "closed": [], "answers": {}}


def _monday(day: str) -> str:
    d = dt.date.fromisoformat(day)
    return (d - dt.timedelta(days=d.weekday())).isoformat()


def _is_day(day: str | None) -> bool:
    try:
        return bool(day) and dt.date.fromisoformat(day) is not None
    except ValueError:
        return False


def _refusal(state: dict, event: dict) -> str | None:
    """Why an entry is out of order, or None."""
    if event["revision"] != state["revision"]:
        return "stale revision"
    if event["entry_id"] is None or event["t_index"] is None:
        return "no entry or position"
    if event["entry_id"] in state["ids"]:
        return "entry exists"
    if str(event["t_index"]) in state["taken"]:
        return "position is taken"
    if state["last_t"] is not None and event["t_index"] <= state["last_t"]:
        return "position goes back"
    if not _is_day(event["date"]):
        return "bad date"
    if state["clock"] is not None and event["date"] != state["clock"]:
        return "not the current date"
    if state["last_date"] is not None and event["date"] < state["last_date"]:
        return "date goes back"
    return None


def step(state: dict, event: dict) -> list[dict]:
    """Applies one event to a session's state and returns its answers; a repeated key repeats its answer."""
    print_ = hashlib.sha256(json.dumps([event[c] for c in ("kind", "revision", "entry_id", "t_index", "date", "body")], default=str).encode()).hexdigest()
    known = state["answers"].get(event["key"]) if event["key"] is not None else None
    if known:
        outcome = ("replayed", known[1]) if known[0] == print_ else ("conflict", "key was used for another request")
        return [_answer(state, event, *outcome)]
    if event["kind"] == "delete":
        state.clear()
        state.update(fresh())
        return [_answer(state, event, "deleted", None)]
    out = []
    if event["kind"] == "entry":
        why = _refusal(state, event)
        if why is None:
            state["ids"][event["entry_id"]], state["last_t"], state["last_date"] = [event["t_index"], event["date"]], event["t_index"], event["date"]
            state["taken"][str(event["t_index"])] = event["entry_id"]
            week = _monday(event["date"])
            state["open"][week] = state["open"].get(week, 0) + 1
            state["revision"] += 1
            out.append(_answer(state, event, "accepted", None, week))
            out += _due(state, event, event["date"])
        else:
            out.append(_answer(state, event, "rejected", why))
    elif event["kind"] == "advance":
        if not _is_day(event["date"]):
            out.append(_answer(state, event, "rejected", "bad date"))
        elif state["clock"] is not None and event["date"] <= state["clock"]:
            out.append(_answer(state, event, "rejected", "clock goes back"))
        else:
            state["clock"] = event["date"]
            state["revision"] += 1
            out.append(_answer(state, event, "accepted", None))
            out += _due(state, event, event["date"])
    elif event["kind"] in ("edit", "remove"):
        if event["entry_id"] not in state["ids"]:
            out.append(_answer(state, event, "rejected", "no such entry"))
        else:
            at, day = state["ids"][event["entry_id"]]
            week = _monday(day)
            state["revision"] += 1
            if event["kind"] == "remove":
                del state["ids"][event["entry_id"]], state["taken"][str(at)]
                if week in state["open"]:
                    state["open"][week] -= 1
                    if not state["open"][week]:
                        del state["open"][week]
            out.append(_answer(state, event, "accepted", None, week))
            out += [_answer(state, event, "week_recomputed", None, w) for w in state["closed"] if w >= week]  # in week order
    else:
        out.append(_answer(state, event, "rejected", "unknown kind"))
    if event["key"] is not None:
        state["answers"][event["key"]] = (print_, out[0]["outcome"])  # all keys, as `ids` has all entries: a repeat can come at any time
    return out


def _answer(state: dict, event: dict, outcome: str, reason: str | None, week: str | None = None) -> dict:
    state["seq"] += 1
    return {"session_id": event["session_id"], "key": event["key"], "outcome": outcome, "reason": reason, "revision": state["revision"], "seq": state["seq"], "week_start": week}


def _due(state: dict, event: dict, now: str) -> list[dict]:
    """Closes the open weeks that ended before `now`, in order."""
    out = []
    for week in sorted(state["open"]):
        if (dt.date.fromisoformat(week) + dt.timedelta(days=6)).isoformat() < now:
            del state["open"][week]
            state["closed"].append(week)
            out.append(_answer(state, event, "week_closed", None, week))
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            for c in ("revision", "t_index", "seq_in"):
                row[c] = None if row[c] is None else int(row[c])
            yield row


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])
    return df.astype({"revision": "int64", "seq": "int64"})


def ingest(events: DataFrame) -> DataFrame:
    """Streaming: answers to the events of each session; those of one batch in order of seq_in, as a shuffle keeps none.
    State is one JSON per session: it grows with the session's entries and keys."""

    def run(key, batches, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else fresh()
        out = [a for row in sorted(_rows(batches), key=lambda r: (r["seq_in"] is None, r["seq_in"] or 0)) for a in step(held, row)]
        if held["seq"] == 1 and out and out[-1]["outcome"] == "deleted":
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
        yield _frame(out)

    return events.groupBy("session_id").applyInPandasWithState(run, ANSWER, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, order: str = "seq_in") -> DataFrame:
    """Batch: the same answers over a stored log; rows of a session are sorted by `order` in Spark and streamed through in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, held = object(), fresh()
        for pdf in batches:
            out = []
            for row in _rows(iter([pdf])):
                if row["session_id"] != session:
                    session, held = row["session_id"], fresh()
                out += step(held, row)
            yield _frame(out)

    names = [c.split()[0] for c in EVENT.split(", ")]
    events = events.withColumn("seq_in", F.col(order))
    return events.select(*names).repartition("session_id").sortWithinPartitions("session_id", "seq_in").mapInPandas(run, ANSWER)


def weekly_counts(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Streaming: entries per key and Monday week by event time; a week is final once the watermark passes it."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", "7 days", "7 days", "4 days").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").cast("date").alias("week_start"), "n")


def without_repeats(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Streaming: the first of the events with one key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def trace_after(log: DataFrame, seq: int, session: str | None = None) -> DataFrame:
    """Cursor read of a log of answers."""
    rows = log.where(F.col("seq") > seq)
    return rows if session is None else rows.where(F.col("session_id") == session)


def session_problems(log: DataFrame) -> DataFrame:
    """Sessions whose accepted entries repeat a position or go back, or whose answers repeat a number."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("session_id").orderBy("seq")
    marked = log.withColumn("_back", F.coalesce(F.col("t_index") <= F.lag("t_index").over(w), F.lit(False)))
    return marked.groupBy("session_id").agg(F.bool_or("_back").alias("goes_back"), (F.count("seq") != F.count_distinct("seq")).alias("repeats_seq")).where("goes_back or repeats_seq")
