"""Integrity joins, upserts, votes, scalars, sources, sinks and sessions on small literals."""

import math
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathwise.functions import scalars as fn
from pathwise.operators import metrics as met
from pathwise.operators import relational as rel
from pathwise.operators import resample as res
from pathwise.operators import votes as vot
from pathwise.operators import weekly as wk
from pathwise.schema import DIMS, assert_columns
from pathwise.sources import readers, sinks
from pathwise.streaming import sessions


def folder() -> str:
    return tempfile.mkdtemp(prefix="pathwise-test-")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_integrity_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(1, "p"), (3, "q")], "k long, b string")
    with pytest.raises(ValueError, match="drops rows"):
        rel.merge_with_integrity(a, b, ["k"])
    assert rel.merge_with_integrity(a, b, ["k"], strict=False).count() == 1
    assert rel.merge_with_integrity(a, a.select("k", F.lit(1).alias("z")), ["k"]).count() == 2
    with pytest.raises(ValueError, match="missing"):
        assert_columns(a, ["nope"])
    with pytest.raises(ValueError, match="duplicate"):
        rel.join_checked(a, b.unionByName(b), ["k"], "m:1")


def test_orphans_are_dealt_by_their_rows(spark, monkeypatch):
    """A task takes `ROWS` rows or so, however small their keys are in an exchange; rows that repeat and null keys all count."""
    monkeypatch.setattr(rel, "ROWS", 5000, raising=False)
    a, b = spark.range(30_000).select(F.col("id").alias("k")), spark.range(0, 30_000, 2).select(F.col("id").alias("k"))
    found = rel.orphans(a.union(a).union(spark.sql("select cast(null as bigint)")), b.union(spark.sql("select -1L union all select null")), ["k"])
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    tasks = [r["task"] for r in rows]
    assert len(set(tasks)) >= 16 and max(map(tasks.count, set(tasks))) < 3000
    assert sorted((r["side"], r["k"] is None, r["k"] or 0) for r in rows) == sorted([("left", False, k) for k in range(1, 30_000, 2)] * 2 + [("left", True, 0), ("right", False, -1), ("right", True, 0)])


def test_upsert_evolves_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string").withColumn("n", F.lit(None))
    new = spark.createDataFrame([(2, 5, "z"), (3, 6, "z")], "k long, n int, y string")
    rows = sorted(tuple(r) for r in rel.upsert(old, new, ["k"]).collect())
    assert rows == [(1, "a", None, None), (2, None, 5, "z"), (3, None, 6, "z")]
    with pytest.raises(ValueError):
        rel.insert_unique(old, old, ["k"])
    with pytest.raises(ValueError):
        rel.update_flag(old, "k", 9, "x")


def test_wide_and_long(spark):
    long = spark.createDataFrame([(1, d, k % 3 - 1) for k, d in enumerate(DIMS)], "k long, dimension string, score int")
    wide = rel.long_to_wide(long, ["k"], "alignment_", DIMS, "score")
    assert sorted(map(tuple, rel.wide_to_long(wide, ["k"], "alignment_", DIMS, "score").collect())) == sorted(map(tuple, long.collect()))
    with pytest.raises(PySparkException):
        rel.long_to_wide(long.unionByName(long), ["k"], "alignment_", DIMS, "score").collect()


def test_running_sum_of_more_rows_than_its_ranges_are_sampled_from(spark):
    order = F.struct((F.col("id") % 7).alias("o"), "id")
    df = spark.range(0, 400_000, 1, 4).select("id", order.alias("o"), F.lit(1).alias("one"), F.lit("unread").alias("text"))
    got = rel.running_sum(df, "o", "one").select("id", "upto")
    want = lambda k, i: i // 7 + 1 + sum((400_000 - j + 6) // 7 for j in range(k))
    rows = {r["id"]: r["upto"] for r in got.collect()}
    assert len(rows) == 400_000 and all(upto == want(k % 7, k) for k, upto in rows.items())


def test_running_sum_and_quantiles(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("v"), F.lit(2).alias("n"))
    rows = rel.running_sum(df, "v", "n").orderBy("v").collect()
    assert [r.upto for r in rows] == [2 * (k + 1) for k in range(500)]
    values = sorted(r.v for r in df.collect())
    got = sorted(r.v for r in rel.nearest_quantiles(df, "v", [0.0, 0.1, 0.5, 1.0]).collect())
    assert got == sorted({values[round(q * 499)] for q in (0.0, 0.1, 0.5, 1.0)})


@pytest.mark.parametrize(("votes", "want"), [
    ([1, 1, 1, 1, 1], (1, "unanimous", 5)), ([1, 1, 1, 1, -1], (1, "strong", 4)), ([1, 1, 1, -1, -1], (1, "bare_majority", 3)), ([1, 1, -1, -1, 0], (0, "no_majority", 2)), ([0, 0, 0, 1, -1], (0, "bare_majority", 3)),
])
def test_votes(spark, votes, want):
    row = vot.resolve(spark.createDataFrame([(1, v) for v in votes], "k long, score int"), ["k"]).first()
    assert (row.label, row.tier) == want[:2] and round(row.agreement * 5) == want[2]


def test_votes_need_five(spark):
    with pytest.raises(PySparkException):
        vot.resolve(spark.createDataFrame([(1, 0)], "k long, score int"), ["k"]).collect()


def test_adjudication_keeps_agreements(spark):
    a = spark.createDataFrame([(1, "yes"), (2, "no")], "k long, answer string")
    b = spark.createDataFrame([(1, "yes"), (2, "yes")], "k long, answer string")
    open_ = vot.reconcile(a, b, ["k"])
    assert dict(vot.adjudicate(open_, b.where("k = 2"), ["k"]).select("k", "answer").collect()) == {1: "yes", 2: "yes"}
    with pytest.raises(PySparkException):
        vot.adjudicate(open_, b, ["k"]).collect()


def test_metrics_undefined_is_null(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (2, -1, -1)], "g long, a int, b int")
    got = {r.g: r.k for r in df.groupBy("g").agg(met.quadratic_kappa("a", "b").alias("k")).collect()}
    assert got == {1: None, 2: 1.0}
    assert {r.g: r.rho for r in met.spearman(df, ["g"], "a", "b").collect()}[1] is None
    assert [value(spark, fn.discretized(F.lit(x))) for x in (-0.51, -0.5, 0.5, 0.51)] == [-1, 0, 0, 1]


def test_scalars(spark):
    assert value(spark, fn.normalized_name(F.lit(" Self-Direction "))) == "self_direction"
    assert value(spark, fn.entry_text(F.lit("a"), F.lit(" "), F.lit("c"))) == "a\n\nResponse: c"
    assert value(spark, fn.session_text(F.lit(" a "), F.lit("q"), F.lit(None).cast("string"))) == 'a\n\n**Nudge:** "q"'
    assert value(spark, fn.token_overlap(F.lit("a a b"), F.lit("a c"))) == pytest.approx(1 / 3)
    assert value(spark, fn.without_phrase(F.lit("so, the end ."), "the")) == "so, end."
    assert value(spark, fn.profile_weights(F.array(F.lit("Power"), F.lit("power"))))[4] == 1.0
    assert value(spark, fn.profile_weights(F.array(F.lit("none"))))[0] == 0.1
    assert value(spark, fn.profile_weights(F.array(F.lit("none")), uniform=False)) == [0.0] * 10
    assert value(spark, fn.json_get(fn.json_put(F.lit('{"a": "1"}'), "b", F.lit(2)), "b")) == "2"
    assert value(spark, fn.kappa_band(F.lit(0.21))) == "Fair" and value(spark, fn.delta_verdict(F.lit(-1), F.lit(1))) == "inconclusive"


def test_intervals(spark):
    low, high = res.bca_bounds([x / 100 for x in range(101)], 0.5, 0.02, 0.0)
    assert low < 0.5 < high and math.isnan(res.bca_bounds([], 0.5, 0.0, 0.0)[0])
    df = spark.range(200).select("id", (F.col("id") % 2).alias("t"), F.lit(1).alias("b"))
    row = res.bca_interval(df, "id", "t", "b", 200).first()
    assert row.estimate == 0.5 and 0.35 < row.low < 0.5 < row.high < 0.65
    with pytest.raises(ValueError):
        res.weighted_choice(df, {"a": -1.0}, F.col("id"))


def test_weeks_start_on_monday(spark):
    days = spark.sql("select 1 p, date'2025-01-05' d, 1.0D v union all select 1, date'2025-01-06', 3.0D")
    assert [str(r.week_start) for r in wk.aggregate_weeks(days, ["v"], ("p",)).orderBy("week_start").collect()] == ["2024-12-30", "2025-01-06"]


def write(path, name, text):
    with open(f"{path}/{name}", "w") as f:
        f.write(text)


WRANGLED = """# Persona 0a1b2c3d: Ann
- **Age:** 30
- **Core Values:** Power, Security

## Entry 0 - 2025-01-01

A long first entry text.

**Nudge:** "What's the "real" reason?"

**Response:** I do not know.

---

## Entry 1 - 2025-01-03

short

---

## Entry 4 - 2025-01-04

Another entry, alone here.
"""


def test_wrangled_markdown(spark):
    at = folder()
    write(at, "persona_0a1b2c3d.md", WRANGLED)
    files = readers.whole_files(spark, at)
    entries, warnings = readers.wrangled_entries(files)
    rows = {r.t_index: r for r in entries.collect()}
    assert set(rows) == {0, 4} and rows[0].nudge_text == 'What\'s the "real" reason?' and rows[0].response_text == "I do not know." and rows[4].initial_entry == "Another entry, alone here."
    assert [r.t_index for r in warnings.collect()] == [1]
    p = readers.profile(files).first()
    assert (p.persona_id, p.name, p.age, p.core_values) == ("0a1b2c3d", "Ann", "30", "Power, Security")
    text = sinks.persona_markdown(readers.profile(files).select("persona_id", "name", "age"), entries).first().markdown
    write(again := folder(), "persona_0a1b2c3d.md", text)
    assert {r.t_index: r.initial_entry for r in readers.wrangled_entries(readers.whole_files(spark, again))[0].collect()} == {k: r.initial_entry for k, r in rows.items()}


RAW = """## Entry 1 - 2025-02-01

### Initial Entry
**Tone**: calm

Some text of the entry.

### Nudge (Soft)
{nudge}

### Response
**Mode:** Answering

Because.

---
"""


@pytest.mark.parametrize("nudge", ['**Trigger**: x\n"Why so?"', "**Category:** x\n\nWhy so?", "**Type**: x\n> Why so?"])
def test_raw_markdown(spark, nudge):
    at = folder()
    write(at, "p_12345678.md", RAW.format(nudge=nudge))
    r = readers.raw_entries(readers.whole_files(spark, at)).first()
    assert (r.t_index, r.date, r.initial_entry, r.nudge_text, r.response_text, r.problem) == (0, "2025-02-01", "Some text of the entry.", "Why so?", "Because.", None)


def test_raw_markdown_marks(spark):
    at = folder()
    head = "## Entry {} - 2025-02-0{}\n\n### Initial Entry\n**Tone:** calm | **Verbosity**: long\n\n{}\n\n"
    nudge = '### Nudge\n**Trigger:** x\n\n"Why "so"?"\n\n'
    parts = [
        head.format(7, 1, "*(No nudge for this entry)*\n\nFirst.\n\nMore: of it.") + "---\n",
        head.format(9, 2, "Second.") + nudge + "*(no response - she slept)*\n\n---\n",
        head.format(9, 3, "Third.") + "[ No nudge generated: cap\nreached ]\n\n### Nudge\nnothing\n---\n",
        *(head.format(9, 4, "Fourth.") + nudge + f"### Response (Answering directly)\n**Response Mode:** short\n{x}\n\n---\n" for x in ("[N/A - No nudge provided]", "`[No response recorded]`", "**[No Response]**", "*No response recorded*", "Said.\n\nTwice.")),
        head.format(9, 5, "Fifth.") + "### Nudge\n**Category:** x\ntoo close\n\n### Response\nx\n",
    ]
    write(at, "p_12345678.md", "# Persona 12345678: Ann\n\n" + "\n".join(parts))
    rows = sorted(readers.raw_entries(readers.whole_files(spark, at)).collect())
    assert [r.t_index for r in rows] == list(range(9)) and rows[0].initial_entry == "First.\n\nMore: of it." and [r.initial_entry for r in rows[1:3]] == ["Second.", "Third.\n\n[ No nudge generated: cap\nreached ]"]
    assert [r.nudge_text for r in rows] == [None, 'Why "so"?', None, *['Why "so"?'] * 5, None]
    assert [r.response_text for r in rows] == [*[None] * 7, "Said.\n\nTwice.", None]
    assert [bool(r.problem) for r in rows] == [*[False] * 8, True]


def test_raw_markdown_marks_that_are_none(spark):
    at = folder()
    head = "## Entry 9 - 2025-02-0{}\n\n### Initial Entry\nText {}.\n\n### Nudge\n**Trigger:** x\n\n\"Why?\"\n\n### Response\n{}\n\n---\n"
    said = ["[noresponserecorded]", "[No  response recorded]", "*no response recorded", "[No response recorded] but", "`[No response recorded]", "[N-A - No nudge provided]", "(no response)"]
    none = ["[na-no nudge provided]", "[N/A  -  NO NUDGE PROVIDED]", "` [no RESPONSE recorded] `", "*(No response yet)*"]
    write(at, "p_12345678.md", "# Persona 12345678: Ann\n\n" + "\n".join(head.format(1 + k % 9, k, x) for k, x in enumerate(said + none)))
    rows = sorted(readers.raw_entries(readers.whole_files(spark, at)).collect())
    assert [r.response_text for r in rows] == said + [None] * len(none)


def test_raw_markdown_problem(spark):
    at = folder()
    write(at, "p_12345678.md", RAW.format(nudge="nothing known"))
    assert readers.raw_entries(readers.whole_files(spark, at)).first().problem


def test_label_files(spark):
    import json

    scores = dict.fromkeys(DIMS, 0) | {"power": -1}
    at = folder()
    write(at, "persona_00000001_labels.json", json.dumps({"persona_id": "1", "labels": [{"t_index": 0, "date": "2025-01-01", "scores": scores, "rationale": "why"}]}))
    write(at, "persona_00000002_labels.json", "{ not json")
    write(at, "persona_00000003_labels.json", json.dumps({"persona_id": "3", "labels": [{"t_index": 0, "date": "2025-01-01", "scores": scores | {"power": 7}}]}))
    labels, errors = readers.read_label_files(spark, at)
    row = labels.first()
    assert labels.count() == 1 and row.alignment_power == -1 and json.loads(row.rationales_json) == {"power": "why"} and row.migrated
    assert errors.count() == 2
    bad = folder()
    write(bad, "persona_00000002_labels.json", "{ not json")
    with pytest.raises(ValueError):
        readers.read_label_files(spark, bad)


def test_jsonl(spark):
    at = folder()
    write(at, "a.jsonl", '{"k": 1}\n\n{"k": 2}\nnot json\n')
    assert sorted(r.k for r in readers.read_jsonl(spark, at, "k long").collect()) == [1, 2]
    with pytest.raises(Exception, match="a.jsonl:4 is not valid JSON"):
        readers.read_jsonl(spark, at, "k long", strict=True).collect()


def test_sinks(spark):
    at, df = folder(), spark.createDataFrame([(1, 0), (2, 1)], "k long, alignment_power int")
    sinks.upsert_into(df, f"{at}/a", ["k"], sinks.annotation_check(["alignment_power"]))
    sinks.upsert_into(df.where("k = 2").withColumn("alignment_power", F.lit(-1)), f"{at}/a", ["k"])
    assert dict(spark.read.parquet(f"{at}/a").collect()) == {1: 0, 2: -1}
    with pytest.raises(ValueError):
        sinks.upsert_into(df.withColumn("alignment_power", F.lit(5)), f"{at}/a", ["k"], sinks.annotation_check(["alignment_power"]))
    sinks.publish_once(df, f"{at}/b", lambda d: None)
    with pytest.raises(FileExistsError):
        sinks.publish_once(df, f"{at}/b")
    sinks.write_new(df, f"{at}/c", ["k"])
    sinks.write_new(df, f"{at}/c", ["k"])
    assert spark.read.parquet(f"{at}/c").count() == 2
    assert sinks.cached(df, f"{at}/d", "v1").count() == 2
    assert sinks.cached(df.limit(1), f"{at}/d", "v1").count() == 2 and sinks.cached(df.where("k = 1"), f"{at}/d", "v2").count() == 1
    with pytest.raises(ValueError):
        sinks.write_frame(df, f"{at}/x.xlsx")
    sinks.write_frame(df, f"{at}/x.csv")
    assert readers.read_csv(spark, f"{at}/x.csv", "k long, alignment_power int").count() == 2


def test_json_sinks(spark):
    import json

    at = folder()
    df = spark.createDataFrame([(2, None, "x")], "b long, c string, a string")
    sinks.append_jsonl(df, f"{at}/log")
    sinks.append_jsonl(df, f"{at}/log")
    assert [r.value for r in spark.read.text(f"{at}/log").collect()] == ['{"a":"x","b":2,"c":null}'] * 2
    sinks.as_json(df, f"{at}/one")
    assert json.loads(spark.read.text(f"{at}/one").first().value) == {"b": 2, "a": "x"}
    tiers = spark.createDataFrame([("p", "strong", 1)], "persona_id string, confidence string, extra int")
    sinks.write_consensus(tiers, f"{at}/tiers", ["persona_id", "confidence"], ["confidence"])
    assert spark.read.parquet(f"{at}/tiers").columns == ["persona_id", "confidence"]
    with pytest.raises(ValueError):
        sinks.write_consensus(tiers.withColumn("confidence", F.lit("sure")), f"{at}/tiers", ["persona_id"], ["confidence"])


def event(session, kind, key, revision, entry=None, t=None, date=None):
    return (session, kind, key, revision, entry, t, date, "")


def numbered(log):
    return [(*e, k) for k, e in enumerate(log)]


LOG = [
    event("s", "entry", "a", 0, "e0", 0, "2025-01-06"), event("s", "entry", "a", 0, "e0", 0, "2025-01-06"), event("s", "entry", "a", 0, "e9", 0, "2025-01-06"),
    event("s", "entry", "b", 0, "e1", 1, "2025-01-07"), event("s", "entry", "c", 1, "e1", 0, "2025-01-07"), event("s", "entry", "d", 1, "e1", 1, "2025-01-05"),
    event("s", "entry", "e", 1, "e1", 1, "2025-01-08"), event("s", "advance", "f", 2, date="2025-01-13"), event("s", "edit", "g", 3, "e0", 0, "2025-01-06"), event("s", "delete", "h", 4),
]
ANSWERS = ["accepted", "replayed", "conflict", "rejected", "rejected", "rejected", "accepted", "accepted", "week_closed", "accepted", "week_recomputed", "deleted"]


def test_replayed_session(spark):
    df = spark.createDataFrame(numbered(LOG), sessions.EVENT)
    assert [r.outcome for r in sessions.replay(df).collect()] == ANSWERS


def test_streamed_session(spark):
    source, out = folder(), folder()
    spark.createDataFrame(numbered(LOG)[::-1], sessions.EVENT).repartition(3).write.mode("append").json(source)  # in no order
    stream = sessions.ingest(spark.readStream.schema(sessions.EVENT).json(source))
    query = stream.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.outcome for r in spark.table("answers").collect()) == sorted(ANSWERS)


def test_session_corrections_and_nulls(spark):
    log = [
        event("s", "entry", None, 0, "e0", 0, "2025-01-06"), event("s", "entry", None, 1, "e1", 1, "2025-01-14"), event("s", "entry", None, 2, "e2", 2, "2025-01-15"), event("s", "advance", None, 3),
        event("s", "edit", None, 3, "e0"), event("s", "remove", None, 4, "e0"), event("s", "edit", None, 5, "e0"), event("s", "entry", None, 5, None, 3, "2025-01-15"), event("s", "entry", None, 5, "e5", 3), event("s", "remove", None, 5, "e2"),
        event("s", "advance", None, 6, date="2025-01-20"), event("s", None, None, 7), event("s", "remove", None, 7, "e1"), (None,) * 8,
    ]
    got = [(r.outcome, r.reason, r.week_start) for r in sessions.replay(spark.createDataFrame(numbered(log), sessions.EVENT)).collect() if r.session_id]
    monday = "2025-01-06", "2025-01-13"
    assert got == [
        ("accepted", None, monday[0]), ("accepted", None, monday[1]), ("week_closed", None, monday[0]), ("accepted", None, monday[1]), ("rejected", "bad date", None),
        ("accepted", None, monday[0]), ("week_recomputed", None, monday[0]), ("accepted", None, monday[0]), ("week_recomputed", None, monday[0]), ("rejected", "no such entry", None), ("rejected", "no entry or position", None), ("rejected", "bad date", None), ("accepted", None, monday[1]),
        ("accepted", None, None), ("week_closed", None, monday[1]), ("rejected", "unknown kind", None), ("accepted", None, monday[1]), ("week_recomputed", None, monday[1]),
    ]


def test_session_problems(spark):
    log = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 3), ("b", 2, 3), ("c", 1, 0), ("c", 1, 1)], "session_id string, seq long, t_index long")
    assert {r.session_id: (r.goes_back, r.repeats_seq) for r in sessions.session_problems(log).collect()}.keys() == {"b", "c"}


def test_weekly_stream(spark):
    source, out = folder(), folder()
    spark.sql("select 1 as user_id, timestamp'2025-01-06 10:00:00' ts union all select 1, timestamp'2025-01-12 10:00:00' union all select 1, timestamp'2025-01-25 10:00:00'").write.mode("append").parquet(source)
    stream = sessions.weekly_counts(spark.readStream.schema("user_id int, ts timestamp").parquet(source), "ts", ["user_id"])
    query = stream.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(str(r.week_start), r.n) for r in spark.table("weeks").collect()] == [("2025-01-06", 2)]


def test_spearman_of_groups_with_ties_holds_no_group_in_a_task(spark):
    import random

    rng = random.Random(5)
    rows = [(g, rng.choice([None, *range(6)]), rng.randrange(4) / 4) for g in (1, 2, None) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, a int, b double")
    out = met.spearman(df, ["g"], "a", "b")
    mean = lambda values, v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
    for r in out.collect():
        kept = [(a, b) for g, a, b in rows if g == r.g and a is not None]
        xs, ys = ([mean([k[i] for k in kept], k[i]) for k in kept] for i in (0, 1))
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True))
        assert math.isclose(r.rho, cov / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys)), abs_tol=1e-9)
    assert out.count() == 3 and "rank(" not in out._jdf.queryExecution().toString()


def test_rationale_pass_finds_the_labels_itself(spark):
    rows = [(p, e, d, r, (p + e * 3 + len(d) * r * r) % 3 - 1) for p in (1, 2) for e in range(4) for d in DIMS for r in range(1, 6)]
    df = spark.createDataFrame([(p, p * 10 + e, d, r, s) for p, e, d, r, s in rows], "persona_id long, event_id long, dimension string, pass int, score int")
    keys = ["persona_id", "event_id"]
    given = vot.rationale_pass(df, keys, vot.resolve(df, [*keys, "dimension"]).select(*keys, "dimension", "label"))
    assert sorted(map(tuple, vot.rationale_pass(df, keys).collect())) == sorted(map(tuple, given.collect()))
    with pytest.raises(PySparkException, match="other than 5"):
        vot.rationale_pass(df.where("pass < 5"), keys).collect()


def test_views_are_dealt_by_their_own_size(spark, monkeypatch):
    from pathwise import adapter

    sf = "/root/testdata/sf0.001"
    n = adapter.table(spark, sf, "events").count()
    monkeypatch.setattr(adapter, "EVENTS", 20)
    vote = adapter.vote(spark, sf)
    assert vote.rdd.getNumPartitions() == -(-n // 20)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(vote) > 50 * size(adapter.entry(spark, sf))  # else Spark broadcasts what it takes for a small side
