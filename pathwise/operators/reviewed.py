"""What reviews of cases, passes and weeks are reduced to: tiers, recommendations, provenance, evidence, focus, policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.operators import episodes
from pathwise.operators.relational import pass_differences
from pathwise.schema import DIMS

#: Recommendations from the mildest on, policies, and the modes that ask for more reflection.
RECOMMENDATIONS = ("keep_current_labels", "targeted_relabeling", "change_distillation_target")
POLICIES = {"active_drift": "drift_detected", "insufficient_evidence": "more_reflection_needed"}
UNSETTLED = ("uncertain", "mixed", "rut", "crash", "evolution", "high_uncertainty", "mixed_state", "background_strain")
#: The triggers of a signal that put its dimension first, by direction.
TRIGGERS = {"tension": ("crash", "rut", "evolution"), "strength": ("evolution", "acknowledgement")}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_match_tier(a, b) -> Column:
    """0 for one split, 1 for two of which none is retired, 2 otherwise."""
    a, b = _c(a), _c(b)
    return F.when(a == b, 0).when((a != "retired") & (b != "retired"), 1).otherwise(2)


def recommendations(df: DataFrame, path_flip="max_path_flip", band="max_path_band", lost="n_unrecoverable", reduced="n_reduced") -> DataFrame:
    """`df` (one row a dimension) with `recommendation` and `overall`, the most severe of all."""
    which = F.when((F.col(path_flip) >= 4) | (F.col(lost) >= 2), 2).when((F.col(band) == "ambiguous") | (F.col(reduced) >= 2), 1).otherwise(0)
    named = lambda k: F.element_at(F.array(*map(F.lit, RECOMMENDATIONS)), k + 1)
    worst = df.agg(F.max(which).alias("_worst"))  # one row
    return df.join(F.broadcast(worst), F.lit(True)).select(*df.columns, named(which).alias("recommendation"), named(F.col("_worst")).alias("overall"))


def score_vector(scores="scores") -> Column:
    """A map's scores of the ten dimensions in order, `x` where it has none."""
    return F.concat_ws(",", *(F.coalesce(F.try_element_at(_c(scores), F.lit(d)).cast("string"), F.lit("x")) for d in DIMS))


def provenance(results: DataFrame, by=("pass",), item: str = "event_id", scores: str = "scores", rationales: str = "rationales") -> DataFrame:
    """Per pass: rows, a hash of its items with their score vectors, scores other than 0 and those with a rationale.

    The hash is the sums of three parts of the rows' digests: rows in any order have one, and no task holds a pass. A part
    has 40 bits, so that some ten million rows are more than a long holds: it is summed in halves.
    """
    scored = F.map_keys(F.map_filter(scores, lambda d, x: x != 0))
    told = F.map_keys(F.map_filter(F.coalesce(rationales, F.create_map().cast("map<string,string>")), lambda d, x: F.length(F.trim(x)) > 0))
    rows = results.select(*by, F.md5(F.concat_ws("|", F.col(item).cast("string"), score_vector(scores))).alias("_row"), F.size(scored).alias("_n"), F.size(F.array_intersect(scored, told)).alias("_told"))
    part = lambda k: F.conv(F.substring("_row", k, 10), 16, 10).cast("long")
    exact = lambda x: F.sum(F.shiftright(x, 20)).cast("decimal(20,0)") * (1 << 20) + F.sum(x.bitwiseAND(F.lit((1 << 20) - 1)))
    parts = [exact(part(k)).cast("string") for k in (1, 11, 21)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *parts).alias("score_hash"), F.sum("_n").alias("n_scores"), F.sum("_told").alias("n_rationales"))


def provenance_problems(stored: DataFrame, now: DataFrame, by=("pass",)) -> DataFrame:
    """by and problem: what a stored provenance says otherwise than the recomputed one, a pass that only one has, rationales
    that are missing, and passes with one hash."""
    both = stored.withColumn("_s", F.lit(True)).alias("s").join(now.withColumn("_n", F.lit(True)).alias("n"), list(by), "full_outer")
    differ = lambda c: ~F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    known = F.col("_s").isNotNull() & F.col("_n").isNotNull()
    found = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), "no provenance"), F.when(F.col("_n").isNull(), "no results"), *(F.when(known & differ(c), f"{c} differs") for c in ("n_rows", "score_hash", "n_scores", "n_rationales")),
        F.when(known & (F.col("n.n_rationales") < F.col("n.n_scores")), "rationales are missing")))
    rows = both.select(*by, F.explode(found).alias("problem"))
    same = now.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("score_hash"))).where("_k > 1").select(*by, F.lit("same scores as another pass").alias("problem"))
    return rows.unionByName(same)


def merge_passes(shards: DataFrame, expected: DataFrame, by=("pass",), item: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Results of all shards as one table per pass, and problems: items that a pass lacks, has twice, or was not asked for."""
    counts = shards.groupBy(*by, item).agg(F.count(F.lit(1)).alias("_n"))
    both = counts.join(expected.select(*by, item).distinct().withColumn("_asked", F.lit(True)), [*by, item], "full_outer")
    problem = F.when(F.col("_asked").isNull(), "extra").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return shards, both.select(*by, item, problem.alias("problem")).where("problem is not null")


def pass_similarity(results: DataFrame, now: DataFrame, rater: str = "pass", item: str | list[str] = "event_id", value: str = "vector") -> DataFrame:
    """a, b, n_shared, n_differ of every two passes, with whether their score hashes agree."""
    one = now.select(F.col(rater).alias("a"), F.col("score_hash").alias("_a"))
    other = now.select(F.col(rater).alias("b"), F.col("score_hash").alias("_b"))
    return pass_differences(results, item, rater, value).join(one, "a").join(other, "b").select("a", "b", "n_shared", "n_differ", (F.col("_a") == F.col("_b")).alias("hash_match"))


def evidence_snippets(decisions: DataFrame, by=("persona_id",), limit: int = 3) -> DataFrame:
    """The last decisions of each group (with `quote` and `text`) as evidence: a conflict's quote, else the entry's text;
    decisions without either are left out after the choice."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t_index"), F.desc("dim_index")))
    quote = F.when(F.col("verdict") == "conflict", F.nullif(F.trim("quote"), F.lit("")))
    excerpt = F.coalesce(quote, F.nullif(F.col("text"), F.lit("")))
    direction = F.when(F.col("verdict") == "conflict", "misaligned").otherwise("context")
    return decisions.withColumns({"_place": place, "excerpt": excerpt, "direction": direction}).where((F.col("_place") <= limit) & F.col("excerpt").isNotNull()).drop("_place")


def prioritized(ranked, signals, direction: str) -> Column:
    """Ranked dimensions after those of signals (dimension, mean, trigger) that speak in the direction."""
    signed = (lambda x: x["mean"] < 0) if direction == "tension" else (lambda x: x["mean"] > 0)
    first = F.filter(_c(signals), lambda x: signed(x) & x["trigger"].isin(*TRIGGERS[direction]))
    return F.array_distinct(F.concat(F.transform(first, lambda x: x["dimension"]), _c(ranked)))


def row_dimensions(scored, direction: str, most: int = 2) -> Column:
    """The best dimensions of a row (array of dimension, score in candidate order): those with the direction's sign, from
    the farthest; without any the first by score."""
    sign = -1 if direction == "aligned" else 1
    keyed = F.array_sort(F.transform(_c(scored), lambda x, i: F.struct((x["score"] * sign).alias("s"), i.alias("i"), x["dimension"].alias("d"))))
    signed = F.filter(keyed, lambda x: x["s"] < 0)
    return F.transform(F.when(F.size(signed) > 0, F.slice(signed, 1, most)).otherwise(F.slice(keyed, 1, 1)), lambda x: x["d"])


def digest_policy(states, mode) -> Column:
    """Delivery policy from a digest's states (an array) and response mode."""
    out = None
    for state, policy in POLICIES.items():
        hit = F.array_contains(_c(states), state)
        out = F.when(hit, policy) if out is None else out.when(hit, policy)
    return out.when(_c(mode).isin(*UNSETTLED), "more_reflection_needed").otherwise("no_current_drift")


def survey_problems(responses: DataFrame, sets: DataFrame, by: str = "session_id", complete: bool = True) -> DataFrame:
    """by, set_number and problem of survey responses (items, item_order_shown, selected_best, selected_worst,
    response_time_ms) against the prescribed sets (set_number, prescribed); set_number is null where sets are missing."""
    prescribed = F.col("prescribed")
    six = lambda c: (F.size(c) == F.size(prescribed)) & (F.size(F.array_distinct(c)) == F.size(prescribed)) & (F.size(F.array_except(c, prescribed)) == 0)
    chosen = F.array_contains(prescribed, F.col("selected_best")) & F.array_contains(prescribed, F.col("selected_worst")) & (F.col("selected_best") != F.col("selected_worst"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = responses.join(sets, "set_number", "left").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(by, "set_number")))
    problem = F.when(prescribed.isNull(), "unknown set").when(~sure(six("items") & six("item_order_shown")), "other items than prescribed").when(~sure(chosen), "choices are not two of the items").when(
        ~sure(F.col("response_time_ms") >= 0), "response time").when(F.col("_same") > 1, "repeated set")
    found = rows.select(by, "set_number", problem.alias("problem")).where("problem is not null")
    if not complete:
        return found
    n = sets.agg(F.count(F.lit(1)).alias("_all"))  # one row
    short = responses.groupBy(by).agg(F.count_distinct("set_number").alias("_n")).join(F.broadcast(n), F.lit(True)).where("_n < _all")
    return found.unionByName(short.select(by, F.lit(None).cast(responses.schema["set_number"].dataType).alias("set_number"), F.lit("sets are missing").alias("problem")))


def _rated(df: DataFrame) -> DataFrame:
    """`df` with precision, recall and coverage of its counts; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return df.withColumns({"precision": ratio("hits", "n_predicted"), "recall": ratio("hits", "n_reference"), "coverage": ratio("n_covered", "n_cases")})


def case_metrics(cases: DataFrame, reference: DataFrame, predicted: DataFrame, covered: DataFrame, responses: DataFrame, lag: int = 2, run=("setup", "repeat"), case=("persona_id", "dimension")) -> DataFrame:
    """Per run and case: reference, predicted, hits, misses, false alerts, median delays in entries and days, whether it is
    covered, and valid and invalid responses.

    cases: run and case; reference: episodes by case with confirmation_d; predicted: episodes by run and case with
    detection_d; covered: by run and case; responses: by run and case with `ok`, one a week.
    """
    keys = (*run, *case)
    wanted = cases.select(*keys).distinct()
    targets = wanted.join(reference, list(case))
    matches = episodes.match_episodes(targets, predicted, lag, keys)
    dated = matches.join(targets.select(*keys, F.col("episode_id").alias("reference_episode_id"), F.col("confirmation_d").alias("_rd")), [*keys, "reference_episode_id"]).join(
        predicted.select(*keys, F.col("episode_id").alias("predicted_episode_id"), F.col("detection_d").alias("_pd")), [*keys, "predicted_episode_id"])
    parts = [
        targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reference")), predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_predicted")),
        dated.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.median("latency_entries").alias("median_delay_entries"), F.median(F.datediff("_pd", "_rd")).alias("median_delay_days")),
        covered.select(*keys, "covered"), responses.groupBy(*keys).agg(F.count_if("ok").alias("valid_responses"), F.count_if(~F.col("ok")).alias("invalid_responses")),
    ]
    out = wanted
    for part in parts:  # all on one key
        out = out.join(part, list(keys), "left")
    out = out.na.fill(0, ["n_reference", "n_predicted", "hits", "valid_responses", "invalid_responses"]).na.fill(False, ["covered"])
    return out.withColumns({"missed": F.col("n_reference") - F.col("hits"), "false_alerts": F.col("n_predicted") - F.col("hits")})


def case_errors(cases: DataFrame, reference: DataFrame, predicted: DataFrame, lag: int = 2, run=("repeat",), case=("persona_id", "dimension")) -> DataFrame:
    """`missed` and `false_alerts` of `case_metrics` alone, for the runs and cases that have episodes; no dates are needed."""
    keys = (*run, *case)
    targets = cases.select(*keys).distinct().join(reference, list(case))
    signs = ((targets, 1, 0), (predicted, 0, 1), (episodes.match_episodes(targets, predicted, lag, keys), -1, -1))
    counted = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(m).alias("missed"), F.lit(f).alias("false_alerts")) for df, m, f in signs))
    return counted.groupBy(*keys).agg(F.sum("missed").alias("missed"), F.sum("false_alerts").alias("false_alerts"))


def pair_metrics(reference: DataFrame, pairs: DataFrame, cases: DataFrame, lag: int = 2, case=("persona_id", "dimension")) -> DataFrame:
    """One row: drift metrics of verdicts on adjacent pairs (case, t_index of the first entry, decision yes, no or abstain).

    Runs of yes pairs are predicted drifts. A case is covered by any yes, or if it has pairs and all are no. Hits are told
    apart by whether the reference (with onset_d and confirmation_d) lies in one week.
    """
    w = Window.partitionBy(*case).orderBy("t_index")
    yes = pairs.where("decision = 'yes'").withColumn("_run", F.col("t_index") - F.row_number().over(w))
    predicted = yes.groupBy(*case, "_run").agg(F.min("t_index").alias("onset_t_index"), (F.max("t_index") + 1).alias("end_t_index")).select(
        *case, F.concat_ws("::", *(F.col(c).cast("string") for c in case), F.col("onset_t_index").cast("string")).alias("episode_id"), "onset_t_index", (F.col("onset_t_index") + 1).alias("confirmation_t_index"), "end_t_index", F.lit("yes").alias("delivery_state"))
    matches = episodes.match_episodes(reference, predicted, lag, case)
    hit = matches.select(*case, F.col("reference_episode_id").alias("episode_id"), F.lit(1).alias("_hit"))
    week = lambda c: F.date_trunc("week", c)
    same = week("onset_d") == week("confirmation_d")
    found = reference.join(hit, [*case, "episode_id"], "left").agg(
        F.count(F.lit(1)).alias("n_reference"), F.count("_hit").alias("hits"), F.count_if(same).alias("same_week_reference"), F.count_if(same & F.col("_hit").isNotNull()).alias("same_week_hits"),
        F.count_if(~same).alias("cross_week_reference"), F.count_if(~same & F.col("_hit").isNotNull()).alias("cross_week_hits"))
    verdicts = pairs.groupBy(*case).agg((F.bool_or(F.col("decision") == "yes") | F.bool_and(F.col("decision") == "no")).alias("_covered"))
    covered = cases.select(*case).distinct().join(verdicts, list(case), "left").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("_covered").alias("n_covered"))
    alerts = predicted.agg(F.count(F.lit(1)).alias("n_predicted"))
    return _rated(found.crossJoin(covered).crossJoin(alerts))  # one row each
