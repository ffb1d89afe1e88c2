"""Injected judges: any function of a case may judge it, and whatever goes wrong leaves an abstention, never a gap.

A judge gets {case, items: [{id, payload}]} and returns {id: verdict}. It may raise `Refusal` (the judge declines) or
ValueError (its answer is no answer); anything else is tried again, as is an answer that does not come in time. Its ids
must be the case's, each once, and its verdicts of the domain, else the answer is invalid. A status is ok, refusal,
invalid or error, as reviews have it; of a case that is not ok every item is `abstain`.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a review may say.
VERDICTS = ("conflict", "not_conflict", "abstain")
RESULT = "case_id string, item_id string, verdict string, status string, reason string, attempts int"


class Refusal(Exception):
    """The judge declines."""


def _in_time(function: Callable, request: dict, seconds: float):
    """The function's result; TimeoutError if it takes longer. A judge that hangs is left in a thread that ends with the process."""
    got: dict = {}

    def run() -> None:
        try:
            got["value"] = function(request)
        except BaseException as error:  # handed to the caller
            got["error"] = error

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"no answer in {seconds:g} s")
    if "error" in got:
        raise got["error"]
    return got["value"]


def guarded(function: Callable[[dict], dict], domain: tuple[str, ...] = VERDICTS, attempts: int = 3, seconds: float = 30.0, pause: float = 0.0) -> Callable[[dict], dict]:
    """The function as one that always answers: {status, reason, attempts, verdicts}."""

    def judge(request: dict) -> dict:
        expected, why = {item["id"] for item in request["items"]}, None
        for attempt in range(1, attempts + 1):
            try:
                verdicts = _in_time(function, request, seconds)
                if set(verdicts) != expected:
                    raise ValueError(f"{len(set(verdicts) - expected)} unknown and {len(expected - set(verdicts))} missing ids")
                if wrong := sorted({str(v) for v in verdicts.values() if v not in domain}):
                    raise ValueError(f"unknown verdicts: {', '.join(wrong[:3])}")
                return {"status": "ok", "reason": None, "attempts": attempt, "verdicts": dict(verdicts)}
            except Refusal as error:
                return {"status": "refusal", "reason": str(error), "attempts": attempt, "verdicts": {}}
            except (ValueError, TypeError, AttributeError) as error:
                return {"status": "invalid", "reason": str(error), "attempts": attempt, "verdicts": {}}
            except Exception as error:
                why = f"{type(error).__name__}: {error}"
                if attempt < attempts:
                    time.sleep(pause * 2 ** (attempt - 1))
        return {"status": "error", "reason": why, "attempts": attempts, "verdicts": {}}

    return judge


def judged(items: DataFrame, function: Callable[[dict], dict], domain: tuple[str, ...] = VERDICTS, attempts: int = 3, seconds: float = 30.0, pause: float = 0.0) -> DataFrame:
    """A verdict on every row of `items` (case_id, item_id, payload), the items of a case judged together and in order.

    Cases are dealt over tasks by their ids; a task streams its sorted rows and holds one case, which is one review's
    worth of items. A task that is run again judges its cases again."""
    judge = guarded(function, domain, attempts, seconds, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, held = None, []

        def result() -> pd.DataFrame:
            found = judge({"case": case, "items": held})
            rows = [(case, x["id"], found["verdicts"].get(x["id"], "abstain"), found["status"], found["reason"], found["attempts"]) for x in held]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"attempts": "int32"})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.case_id != case:
                    if held:
                        yield result()
                    case, held = row.case_id, []
                held.append({"id": row.item_id, "payload": row.payload})
        if held:
            yield result()

    text = [F.col(c).cast("string").alias(c) for c in ("case_id", "item_id", "payload")]
    rows = items.select(*text).where("case_id is not null and item_id is not null")
    return rows.repartition("case_id").sortWithinPartitions("case_id", "item_id").mapInPandas(run, RESULT)
