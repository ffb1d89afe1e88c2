"""Review cases as data: queues, disagreement of runs, completeness of prompts and responses, evidence, acceptance, inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.operators import sequence
from pathwise.session import checkpointed

CASE = ("persona_id", "dimension")
#: The names of the review queues.
QUEUES = ("All persona/Core Value cases", "Reference Drift", "Uncertain LLM-Judge Conflict Label", "Model disagreement", "Run disagreement", "Invalid response", "Unresolved because of Abstain", "Missed Drift", "False Drift alert")


def run_disagreement(tokens: DataFrame, spans: DataFrame, run: str = "repeat", case=CASE, runs: int = 3) -> DataFrame:
    """case, by_token and by_spans of the cases where runs differ: in the token of an entry (t_index), or in the set of their
    predicted spans (onset, end). A run without spans has the empty set."""
    # Tokens are told apart by grouping: the least and largest of strings would need sorted rows.
    told = tokens.groupBy(*case, "t_index", "token").agg(F.lit(1).alias("_one")).groupBy(*case, "t_index").agg((F.count("token") > 1).alias("_t"))
    entries = told.groupBy(*case).agg(F.bool_or("_t").alias("by_token"))
    spot = F.struct("onset", "end")
    sets = spans.groupBy(*case, run).agg(F.sort_array(F.collect_set(spot)).alias("_s")).groupBy(*case).agg(F.count_distinct("_s").alias("_n"), F.count(F.lit(1)).alias("_with"))
    out = entries.join(sets, list(case), "left")
    by_spans = F.coalesce((F.col("_n") > 1) | ((F.col("_with") > 0) & (F.col("_with") < runs)), F.lit(False))
    return out.select(*case, "by_token", by_spans.alias("by_spans")).where("by_token or by_spans")


def run_profiles(tokens: DataFrame, run: str = "repeat", case=CASE) -> DataFrame:
    """One row per run and case, in one pass over `tokens` (run, t_index, verdict, label and ok): whether a response is invalid,
    whether an adjacent pair is left open by an abstention, and the spans (onset, end) of two or more adjacent true labels."""
    w = Window.partitionBy(*case, run).orderBy("t_index")
    hit = F.coalesce(F.col("label"), F.lit(False))
    rows = tokens.select(*case, run, "t_index", "ok", hit.alias("_hit"), F.when(F.col("ok"), F.col("verdict")).otherwise("abstain").alias("a"))
    rows = rows.withColumns({"b": F.lead("a").over(w), "n": F.lead("t_index").over(w), "_nth": F.sum(F.col("_hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    open_ = (F.col("n") == F.col("t_index") + 1) & ((F.col("a") == "abstain") | (F.col("b") == "abstain")) & (F.col("a") != "not_conflict") & (F.col("b") != "not_conflict")
    parts = rows.groupBy(*case, run, F.when(F.col("_hit"), F.col("t_index") - F.col("_nth")).alias("_run")).agg(
        F.bool_or(~F.col("ok")).alias("_bad"), F.bool_or(F.coalesce(open_, F.lit(False))).alias("_open"), F.min("t_index").alias("onset"), F.max("t_index").alias("end"), F.count(F.lit(1)).alias("_n"))
    span = F.when(F.col("_run").isNotNull() & (F.col("_n") >= 2), F.struct("onset", "end"))
    return parts.groupBy(*case, run).agg(F.bool_or("_bad").alias("invalid"), F.bool_or("_open").alias("unresolved"), F.sort_array(F.collect_list(span)).alias("spans"))


def review_queues(cases: DataFrame, reference: DataFrame, labels: DataFrame, models: DataFrame, runs: DataFrame, metrics: DataFrame, case=CASE) -> DataFrame:
    """case and queue, for each queue that a case is in. cases: `run_profiles`; reference: its episodes; labels: with score, null
    if uncertain; models and runs: the cases in which models and runs disagree; metrics: missed, false_alerts. Each part is read
    once, for all its queues, and says in a bit which ones; a case's bits meet in one aggregation."""
    true = F.lit(True)
    parts = (
        (cases, {QUEUES[0]: true, "Invalid response": F.col("invalid"), "Unresolved because of Abstain": F.col("unresolved")}),
        (reference, {"Reference Drift": true}), (labels.where("score is null"), {"Uncertain LLM-Judge Conflict Label": true}),
        (models, {"Model disagreement": true}), (runs, {"Run disagreement": true}),
        (metrics, {"Missed Drift": F.col("missed") > 0, "False Drift alert": F.col("false_alerts") > 0}),
    )
    bit = lambda name, flag: F.when(flag, 1 << QUEUES.index(name)).otherwise(0)
    marked = [df.select(*case, reduce(Column.bitwiseOR, (bit(*x) for x in flags.items())).alias("_in")) for df, flags in parts]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in case))
    each = reduce(DataFrame.unionByName, (df.groupBy(*case).agg(F.bit_or("_in").alias("_in")) for df in marked)).where(known).groupBy(*case).agg(F.bit_or("_in").alias("_in"))
    names = F.array_compact(F.array(*(F.when(F.col("_in").bitwiseAND(1 << i) != 0, name) for i, name in enumerate(QUEUES))))
    return each.where(F.col("_in").bitwiseAND(1) != 0).select(*case, F.explode(names).alias("queue"))


def window_problems(windows: DataFrame, entries: DataFrame, by: str = "persona_id") -> tuple[DataFrame, DataFrame]:
    """What is wrong with prompts' windows, and the coordinates that aren't in exactly one of them.

    windows: by, week_start, week_end, visible and current (arrays of positions), cutoff, shown (the hash of the text of each
    position, a map); entries: by, t_index, d, text_hash. A window has to show all entries up to its end and no other, hold
    those of its week as current, and cut off at the last of these; texts are the entries' own. A set is right if its size
    is and all its members are, so that no window is joined with all entries before it."""
    key = [by, "week_start"]
    dates = entries.select(by, "d", F.lit(1).alias("_one"), F.lit(None).cast("date").alias("week_start"), F.lit(None).cast("date").alias("week_end"), F.lit(None).cast("long").alias("_w"))
    ends = checkpointed(windows.withColumn("_w", F.monotonically_increasing_id()))  # numbered once
    at = lambda day, sign: ends.select(by, F.date_add(F.col(day), 0 if sign > 0 else -1).alias("d"), F.lit(0).alias("_one"), "week_start", "week_end", (F.col("_w") * 2 + int(sign > 0)).alias("_w"))
    marks = dates.unionByName(at("week_end", 1)).unionByName(at("week_start", -1))
    upto = Window.partitionBy(by).orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("_n", F.sum("_one").over(upto)).where("_w is not null").groupBy(F.shiftright("_w", 1).alias("_w")).agg(F.max(F.when(F.col("_w") % 2 == 1, F.col("_n"))).alias("_visible"), F.max(F.when(F.col("_w") % 2 == 0, F.col("_n"))).alias("_past"))
    said = ends.select("_w", by, "week_start", "week_end", F.explode_outer(F.array_distinct("visible")).alias("t_index"), "current", "shown")
    # What a window says of a position is looked up before rows are dealt: the whole map in each row would grow with its square.
    said = said.select("_w", by, "week_start", "week_end", "t_index", F.array_contains("current", F.col("t_index")).alias("_now"), F.element_at("shown", F.col("t_index")).alias("_shown"))
    known = said.join(entries.select(by, "t_index", "d", "text_hash"), [by, "t_index"], "left")
    now = F.col("_now")
    inside = F.col("d").between(F.col("week_start"), F.col("week_end"))
    facts = known.groupBy("_w").agg(
        F.count_if(F.coalesce(F.col("d") <= F.col("week_end"), F.lit(False))).alias("_right"), F.count_if(F.coalesce(now & inside, F.lit(False))).alias("_current"), F.max(F.when(F.coalesce(inside, F.lit(False)), F.col("t_index"))).alias("_last"),
        F.coalesce(F.bool_and(F.col("_shown").eqNullSafe(F.col("text_hash"))), F.lit(True)).alias("_texts"))
    rows = ends.join(facts, "_w").join(counted, "_w").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    n_now = F.col("_visible") - F.col("_past")
    checks = {
        "duplicate prompt": F.col("_same") > 1, "history boundary": (F.size("visible") != F.col("_visible")) | (F.col("_right") != F.col("_visible")),
        "current-week boundary": (F.size("current") != n_now) | (F.col("_current") != n_now), "cutoff": ~F.col("cutoff").eqNullSafe(F.col("_last")), "history text": ~F.col("_texts"),
    }
    problems = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))
    found = rows.select(*key, F.explode(problems).alias("problem"))
    held = windows.select(by, F.explode("current").alias("t_index")).groupBy(by, "t_index").agg(F.count(F.lit(1)).alias("n_windows"))
    uncovered = entries.select(by, "t_index").join(held, [by, "t_index"], "left").select(by, "t_index", F.coalesce("n_windows", F.lit(0)).alias("n_windows")).where("n_windows <> 1")
    return found, uncovered


def evidence_picks(entries: DataFrame, by=("persona_id", "week"), tension: str = "tension", strength: str = "strength", mean: str = "m") -> DataFrame:
    """by, t_index, direction and rank: the entries that a digest cites. Misaligned ones come first by tension (those below 0
    are its primary ones, the others its fallback, in one order), one where there are at most two entries and two else;
    then the best aligned one by strength among those not chosen."""
    w = Window.partitionBy(*by)
    rows = entries.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy(F.col(tension).asc_nulls_last(), F.col(mean).asc_nulls_last(), "t_index"))})
    low = F.col("_i") <= F.when(F.col("_n") <= 2, 1).otherwise(2)
    high = F.row_number().over(Window.partitionBy(*by, low).orderBy(F.col(strength).desc_nulls_last(), F.col(mean).desc_nulls_last(), "t_index"))
    rows = rows.withColumns({"_low": low, "_high": high})
    picked = rows.where("_low or _high = 1")
    primary = F.when(F.col("_low"), F.col(tension) < 0).otherwise(F.col(strength) > 0)
    return picked.select(*by, "t_index", F.when(F.col("_low"), "misaligned").otherwise("aligned").alias("direction"), F.when(F.col("_low"), F.col("_i")).otherwise(1).alias("rank"), F.coalesce(primary, F.lit(False)).alias("primary"))


def state_evidence(decisions: DataFrame, states: DataFrame, start: Column, end: Column, case=CASE, most: int = 3) -> DataFrame:
    """case, t_index and why: the fewest decisions that explain a current state. Those of the window if there are any, else the
    support of an open drift, else the last ones; of each at most `most`, the latest. states: case, state, run_length."""
    newest = Window.partitionBy(*case).orderBy(F.desc("t_index"))
    rows = decisions.join(states.select(*case, "state", "run_length"), list(case)).withColumn("_in", F.coalesce(F.col("d").between(start, end), F.lit(False)))
    rows = rows.withColumns({"_i": F.row_number().over(newest), "_any": F.max("_in").over(Window.partitionBy(*case)), "_w": F.sum(F.col("_in").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    why = F.when(F.col("_any"), "window").when((F.col("state") == "active_drift") & (F.col("run_length") > 0), "open drift").otherwise("latest")
    kept = F.when(F.col("_any"), F.col("_in") & (F.col("_w") <= most)).when(why == "open drift", F.col("_i") <= F.least(F.lit(most), F.col("run_length"))).otherwise(F.col("_i") <= most)
    return rows.where(kept).select(*case, "t_index", why.alias("why"))


def accepted_pairs(entries: DataFrame, reviews: DataFrame, pair: str = "pair_id", entry: str = "entry_id") -> DataFrame:
    """pair, label_agreement, opposite, accepted and n_entries: what two reviewers accept. entries: pair, entry, label_a, label_b;
    reviews: pair, reviewer, comparable, realistic, accept (yes or no), issues. All of ten hold: the labels agree, they are
    opposite and not neutral, and both reviewers say comparable, realistic and accept and list no issue."""
    same = F.col("label_a").eqNullSafe(F.col("label_b"))
    agreed = F.collect_set(F.when(same, F.col("label_a")))
    labels = entries.groupBy(pair).agg(F.bool_and(same).alias("label_agreement"), (F.sort_array(agreed) == F.array(F.lit(-1), F.lit(1))).alias("opposite"), F.count_distinct(entry).alias("n_entries"))
    yes = lambda c: F.col(c) == "yes"
    sure = F.coalesce(yes("comparable") & yes("realistic") & yes("accept") & (F.size("issues") == 0), F.lit(False))
    both = reviews.groupBy(pair).agg(F.bool_and(sure).alias("_all"), F.count_distinct("reviewer").alias("_n"))
    out = labels.join(both, pair, "left")
    ok = F.col("label_agreement") & F.col("opposite") & F.coalesce(F.col("_all") & (F.col("_n") == 2), F.lit(False))
    return out.select(pair, "label_agreement", "opposite", ok.alias("accepted"), "n_entries")


#: What an assessment may say, and the reason that a yes needs.
DECISIONS, YES_REASON = ("yes", "no", "uncertain"), "direct_behavior_or_choice"


def response_problems(expected: DataFrame, assessments: DataFrame, verdicts: DataFrame, case: str = "case_id") -> DataFrame:
    """case and problem of a reviewer's response. expected: case, position; assessments: case, position, decision, reason;
    verdicts: case, sustained, rationale. Every position once and no other; a yes names direct behaviour; two yes in a row
    mean sustained, none mean no (or uncertain where an entry is)."""
    both = assessments.groupBy(case, "position").agg(F.count(F.lit(1)).alias("n"), F.max("decision").alias("decision"), F.max("reason").alias("reason"))
    rows = expected.select(case, "position", F.lit(True).alias("_wanted")).join(both, [case, "position"], "full")
    w = Window.partitionBy(case).orderBy("position")
    yes = F.col("decision") == "yes"
    rows = rows.withColumn("_pair", F.coalesce(yes & (F.lag("decision").over(w) == "yes") & (F.lag("position").over(w) == F.col("position") - 1), F.lit(False)))
    missing = F.col("_wanted").isNull() | F.coalesce(F.col("n") != 1, F.lit(True))
    facts = rows.groupBy(case).agg(
        F.bool_or(missing).alias("_cover"), F.bool_or(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)) & ~missing).alias("_domain"), F.bool_or(F.coalesce(yes & (F.col("reason") != YES_REASON), F.lit(False))).alias("_reason"),
        F.bool_or("_pair").alias("_pair"), F.bool_or(F.coalesce(F.col("decision") == "uncertain", F.lit(False))).alias("_open"), F.bool_and(F.col("_wanted").isNull()).alias("_unknown"))
    rows = facts.join(verdicts.select(case, "sustained", "rationale", F.lit(True).alias("_said")), case, "full")
    fits = F.when(F.col("_pair"), F.col("sustained") == "yes").otherwise((F.col("sustained") == "no") | ((F.col("sustained") == "uncertain") & F.col("_open")))
    checks = {"unknown case": F.coalesce(F.col("_unknown"), F.lit(True)), "missing case": F.col("_said").isNull(), "entry coverage": F.col("_cover"), "decision": F.col("_domain"), "reason of a yes": F.col("_reason"),
              "sustained": F.col("_said") & ~F.coalesce(fits, F.lit(False)), "rationale": F.col("_said") & (F.length(F.trim(F.coalesce("rationale", F.lit("")))) == 0)}
    return rows.select(case, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))).alias("problem"))


def inventory(rows: DataFrame, sources: dict[str, Column], case=CASE) -> DataFrame:
    """case, length, and per source the maximal runs by position, the windows of two adjacent hits and whether it makes the case
    a candidate; sources (of those that do); content_sha256, of the positions and all sources' hits in order."""
    w = Window.partitionBy(*case).orderBy("t_index")
    flags = {f"_{name}": F.coalesce(hit, F.lit(False)) for name, hit in sources.items()}
    rows = rows.withColumns(flags)
    rows = rows.withColumns({f"{f}_before": F.coalesce(F.lag(f).over(w), F.lit(False)) for f in flags})
    parts = []
    for name in sources:
        hit, before = F.col(f"_{name}"), F.col(f"_{name}_before")
        parts += [F.count_if(hit & ~before).alias(f"{name}_runs"), F.count_if(hit & before).alias(f"{name}_windows"), F.coalesce(F.bool_or(hit & before), F.lit(False)).alias(f"{name}_candidate")]
    line = F.concat_ws(":", F.col("t_index").cast("string"), *(F.col(f).cast("int").cast("string") for f in flags))
    content = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_index", line.alias("line")))), lambda x: x["line"]), "|"), 256)
    out = rows.groupBy(*case).agg(F.count(F.lit(1)).alias("length"), *parts, content.alias("content_sha256"))
    return out.withColumn("sources", F.concat_ws(",", *(F.when(F.col(f"{name}_candidate"), F.lit(name)) for name in sources)))


def trajectory_problems(entries: DataFrame, by: str = "persona_id") -> DataFrame:
    """by, n_entries and problem (null if none): positions have to be 0 to n - 1, each once, and all texts to say something."""
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    out = entries.groupBy(by).agg(F.count(F.lit(1)).alias("n_entries"), F.min("t_index").alias("_min"), F.max("t_index").alias("_max"), F.count_distinct("t_index").alias("_n"), F.min(F.when(blank, F.col("t_index"))).alias("_blank"))
    whole = (F.col("_min") == 0) & (F.col("_max") == F.col("n_entries") - 1) & (F.col("_n") == F.col("n_entries"))
    problem = F.when(~whole, "non-contiguous positions").when(F.col("_blank").isNotNull(), F.concat(F.lit("missing text at "), F.col("_blank").cast("string")))
    return out.select(by, "n_entries", problem.alias("problem"))


def full_cases(entries: DataFrame, declared: DataFrame, split: str, by: str = "persona_id") -> DataFrame:
    """case_id, by, dimension, n_entries and the ordered entries of every declared value of personas without a problem."""
    good = trajectory_problems(entries, by).where("problem is null").select(by, "n_entries")
    rows = entries.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("t_index", F.trim("text").alias("text")))).alias("entries"))
    case = F.concat_ws(":", F.lit(split), F.col(by).cast("string"), F.col("dimension"))
    return declared.select(by, "dimension").distinct().join(good, by).join(rows, by).select(case.alias("case_id"), by, "dimension", "n_entries", "entries")


def assert_counts(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """`actual`, one row of counts, or ValueError with the first that differs or is not expected."""
    row = actual.first().asDict()
    for name, value in row.items():
        if expected.get(name) != value:
            raise ValueError(f"expected {name}={expected.get(name)!r}; live value is {value}")
    return actual


#: The floors of a promotion, of which the last is a ceiling.
FLOORS = {"qwk_mean": 0.362, "recall_minus1": 0.313, "minority_recall_mean": 0.448, "calibration_global": 0.713, "hedging_mean": 0.621}


def guardrails(runs: DataFrame, baseline: DataFrame, hard: list[str], floors: dict[str, float] = FLOORS, loss: float = 0.02, gain: float = 0.05) -> DataFrame:
    """`runs` with floor flags, changes of the hard dimensions (columns hard_*) against the one-row baseline, whether none loses
    more than `loss` and one gains `gain`, the least margin, and rank: by floors met, guardrails, margin, then the measures."""
    base = baseline.select(*(F.col(c).alias(f"_base_{c}") for c in hard))
    rows = runs.join(F.broadcast(base), F.lit(True))  # one row
    margin = {c: (floors[c] - F.col(c) if c == "hedging_mean" else F.col(c) - floors[c]) for c in floors}
    rows = rows.withColumns({f"meets_{c}": F.coalesce(m >= 0, F.lit(False)) for c, m in margin.items()})
    change = {c: F.col(c) - F.col(f"_base_{c}") for c in hard}
    rows = rows.withColumns({f"change_{c}": d for c, d in change.items()})
    no_loss, some_gain = reduce(lambda a, b: a & b, (d >= -loss for d in change.values())), reduce(lambda a, b: a | b, (d >= gain for d in change.values()))
    rows = rows.withColumns({"n_floors": sum((F.col(f"meets_{c}").cast("int") for c in floors), F.lit(0)), "no_material_loss": no_loss, "required_gain": some_gain, "least_margin": F.least(*margin.values())})
    order = [F.desc("n_floors"), F.desc("no_material_loss"), F.desc("required_gain"), F.desc("least_margin"), F.desc("qwk_mean"), F.desc("recall_minus1"), F.desc("minority_recall_mean"), F.asc("hedging_mean"), F.desc("calibration_global"), F.asc("run")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop(*(f"_base_{c}" for c in hard))  # one row a run


def matched_recall(truth: DataFrame, arms: DataFrame, cell: list[str], by: str = "repeat") -> DataFrame:
    """Per repeat the cells where both arms gave a verdict: how many, their share of all, how many are conflicts, and each arm's
    recall of these (0 without any). truth: cell, conflict; arms: by, cell, a, b (verdicts)."""
    all_cells = truth.agg(F.count(F.lit(1)).alias("_all"))  # one row
    both = arms.where((F.col("a") != "abstain") & (F.col("b") != "abstain")).join(truth, cell)
    bad = F.col("conflict")
    recall = lambda c: F.coalesce(F.try_divide(F.count_if(bad & (F.col(c) == "conflict")), F.count_if(bad)), F.lit(0.0))
    out = both.groupBy(by).agg(F.count(F.lit(1)).alias("n_matched"), F.count_if(bad).alias("n_conflict"), recall("a").alias("recall_a"), recall("b").alias("recall_b"))
    return out.join(F.broadcast(all_cells), F.lit(True)).withColumn("coverage", F.col("n_matched") / F.col("_all")).drop("_all")


def run_tokens(decisions: DataFrame, run: Column, off: Column) -> DataFrame:
    """Decisions of several runs: `decisions` for each of `run`, failed where `off`; with ok, label and token."""
    rows = decisions.select("*", run.alias("repeat")).withColumn("ok", (F.col("review_status") == "ok") & ~off)
    return rows.withColumns({"label": F.when(F.col("ok") & (F.col("verdict") != "abstain"), F.col("verdict") == "conflict"), "token": F.when(F.col("ok"), F.col("verdict")).otherwise("invalid")})


def run_spans(rows: DataFrame, case=CASE) -> DataFrame:
    return sequence.drift_spans(rows, F.coalesce(F.col("label"), F.lit(False)), ("repeat", *case))


def recovered(responses: DataFrame, parsed: Column) -> DataFrame:
    """`responses` (verdict, status, quote, text) with status ok and recovered_from where an invalid one that was parsed satisfies
    the contract: a known verdict, and for a conflict a quote that says something and stands in the text as it is."""
    quoted = (F.trim("quote") != "") & F.contains("text", "quote")
    valid = F.when(F.col("verdict") == "conflict", F.coalesce(quoted, F.lit(False))).otherwise(F.coalesce(F.col("verdict").isin("not_conflict", "abstain"), F.lit(False)))
    again = (F.col("status") == "invalid") & parsed & valid
    return responses.withColumns({"status": F.when(again, "ok").otherwise(F.col("status")), "recovered_from": F.when(again, "invalid")})


def dimension_trace(epochs: DataFrame, fields: list[str], dims, selected: int | None = None) -> DataFrame:
    """epoch, dimension, the fields, val_recall_minus1, val_recall_zero, val_recall_plus1, eligible and selected: one row per epoch
    and dimension of epochs' vectors (fields: arrays; recall: array of minus1, zero, plus1). A vector of another length raises;
    without epochs the frame has its columns and types all the same."""
    arrays = [*fields, "recall"]
    short = F.array_max(F.array(*(F.abs(F.size(c) - len(dims)) for c in arrays)))
    checked = epochs.withColumn("recall", F.when(F.coalesce(short, F.lit(1)) == 0, F.col("recall")).otherwise(F.raise_error(F.concat(F.lit("a vector of epoch "), F.col("epoch").cast("string"), F.lit(" lacks dimensions")))))
    rows = checked.select("epoch", "eligible", F.inline(F.arrays_zip(F.array(*map(F.lit, dims)).alias("dimension"), *arrays)))
    chosen = F.coalesce(F.col("epoch") == F.lit(selected), F.lit(False))
    return rows.select("epoch", F.col("dimension"), *fields, *(F.col(f"recall.{k}").alias(f"val_recall_{k}") for k in ("minus1", "zero", "plus1")), "eligible", chosen.alias("selected"))
