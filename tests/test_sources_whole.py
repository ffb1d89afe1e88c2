"""Strict lines, receipts, stage updates and versioned tables."""

import threading

import pytest
from pyspark.sql import functions as F

from pathwise.sources import readers, sinks, versioned


def test_strict_lines_name_file_and_line(spark, tmp_path):
    lines = [f'{{"k": {k}}}' for k in range(3000)] + ["", "   ", "[1, 2]", '{"k": 1}', "{oops", '"text"', "7"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        bad = {(r["line"], r["problem"]) for r in readers.jsonl_problems(spark, str(tmp_path)).collect()}
        numbers = readers.numbered_lines(spark, str(tmp_path / "a.jsonl"))
        assert numbers.rdd.getNumPartitions() > 3 and sorted(r["line"] for r in numbers.collect()) == list(range(1, len(lines) + 1))
        assert all(r["value"] == lines[r["line"] - 1] for r in numbers.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert bad == {(3003, "must contain a JSON object"), (3005, "is not valid JSON"), (3006, "must contain a JSON object"), (3007, "must contain a JSON object")}
    with pytest.raises(ValueError, match=r"a\.jsonl:3003 must contain a JSON object"):
        readers.read_jsonl(spark, str(tmp_path), "k long", strict=True)
    assert readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k long", strict=True).count() == 1


SCHEMA = "persona_id string, week_start string, week_end string, status string, assessments array<string>, refusal string, validation_error string, prompt_sha256 string, latency_seconds double"


def test_receipts_replace_their_own(spark, tmp_path):
    row = lambda p, w, status="ok", a=("x",): (p, w, w, status, list(a), None, None, "h", 1.0)
    at = str(tmp_path / "receipts")
    sinks.persist_receipts(spark.createDataFrame([row("p", "2024-01-01"), row("p", "2024-01-08")], SCHEMA), at)
    sinks.persist_receipts(spark.createDataFrame([row("p", "2024-01-08", "refusal", ())], SCHEMA), at)
    got = {(r["week_start"], r["status"]) for r in sinks.read_receipts(spark, at, SCHEMA).collect()}
    assert got == {("2024-01-01", "ok"), ("2024-01-08", "refusal")}
    for bad in ([row("p", "w", "perhaps")], [row("p", "w", "error")], [row("p", "w"), row("p", "w")]):
        with pytest.raises(ValueError):
            sinks.persist_receipts(spark.createDataFrame(bad, SCHEMA), at)


def test_stage_updates_are_idempotent(spark, tmp_path):
    registry = spark.createDataFrame([("a", None), ("b", False), ("c", True)], "persona_id string, stage_wrangled boolean")
    new = spark.createDataFrame([("a", "text")], "persona_id string, body string")
    for _ in range(2):
        out = sinks.write_new_stage(new, str(tmp_path / "w"), ["persona_id"], registry, "stage_wrangled")
        assert {r["persona_id"]: r["stage_wrangled"] for r in out.collect()} == {"a": True, "b": False, "c": True}
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1


def test_two_writers_lose_nothing_and_readers_see_a_table(spark, tmp_path):
    at, seen, failed = str(tmp_path / "table"), [], []
    versioned.upsert_into(spark.createDataFrame([(-1, "start")], "k long, v string"), at, ["k"])

    def write(name: str, first: int) -> None:
        try:
            for n in range(3):
                versioned.upsert_into(spark.createDataFrame([(first + n, name), (-1, name)], "k long, v string"), at, ["k"])
        except Exception as error:
            failed.append(error)

    def watch() -> None:
        while any(t.is_alive() for t in writers):
            try:
                seen.append(versioned.read(spark, at).count())
            except Exception as error:
                failed.append(error)
                return

    writers = [threading.Thread(target=write, args=(name, first)) for name, first in (("a", 0), ("b", 100))]
    for t in writers:
        t.start()
    reader = threading.Thread(target=watch)
    reader.start()
    for t in [*writers, reader]:
        t.join(300)
    assert not failed and seen == sorted(seen) and min(seen) >= 1
    assert {r["k"] for r in versioned.read(spark, at).collect()} == {-1, 0, 1, 2, 100, 101, 102}
    assert versioned.latest(spark, at)[0] == 7 and versioned.read(spark, at, 1).count() == 1
    wide = spark.createDataFrame([(0, 5)], "k long, extra int")
    versioned.upsert_into(wide, at, ["k"])
    assert {(r["k"], r["extra"]) for r in versioned.read(spark, at).where("k = 0 or k = 1").collect()} == {(0, 5), (1, None)}
    with pytest.raises(ValueError):
        versioned.upsert_into(wide, at, ["k"], F.col("extra") > 9)
    assert versioned.vacuum(spark, at) == 6 and versioned.read(spark, at).count() == 7
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, str(tmp_path / "none"))
