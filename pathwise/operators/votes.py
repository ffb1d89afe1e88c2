"""Votes of several passes or reviewers made into labels, tiers and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tally(df: DataFrame, keys, score: str = "score") -> DataFrame:
    """Votes for -1, 0 and 1 per cell, and how many there are."""
    s = F.col(score)
    return df.groupBy(*keys).agg(F.count_if(s == -1).alias("n_neg"), F.count_if(s == 0).alias("n_zero"), F.count_if(s == 1).alias("n_pos"), F.count(s).alias("n_votes"))


def resolved(need: int = 5) -> dict[str, Column]:
    """Label, tier and agreement of a tally: half or more zeros give 0; else the larger sign; tied signs give 0 without majority."""
    neg, zero, pos = F.col("n_neg"), F.col("n_zero"), F.col("n_pos")
    quiet = zero * 2 > need
    label = F.when(quiet, 0).when(pos > neg, 1).when(neg > pos, -1).otherwise(0)
    winning = F.when(quiet, zero).otherwise(F.greatest(neg, pos))
    tier = F.when(~quiet & (neg == pos), "no_majority").when(winning == need, "unanimous").when(winning == need - 1, "strong").otherwise("bare_majority")
    return {"label": label, "tier": tier, "agreement": winning / need}


def resolve(df: DataFrame, keys, need: int = 5) -> DataFrame:
    """Activity, then polarity, over exactly `need` votes per cell; cells with another number are an error."""
    return _checked(tally(df, keys).withColumns(resolved(need)), need)


def _checked(counted: DataFrame, need: int) -> DataFrame:
    return counted.withColumn("label", F.when(F.col("n_votes") == need, F.col("label")).otherwise(F.raise_error(F.lit(f"a cell has other than {need} votes")).cast("int")))


def vote_distribution(df: DataFrame, keys) -> DataFrame:
    """Shares and entropy (bits) of each cell's votes."""
    t = tally(df, keys)
    shares = F.array(*(F.col(c) / F.col("n_votes") for c in ("n_neg", "n_zero", "n_pos")))
    bits = -F.aggregate(F.filter(F.col("p"), lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log2(x))
    return t.withColumn("p", shares).withColumn("entropy", bits)


def majority_with_tiebreak(df: DataFrame, keys, rater: str = "pass", score: str = "score") -> DataFrame:
    """Majority of passes 1 to 3; three different votes take pass 4, which only such cells may use."""
    first = F.col(rater) <= 3
    n = lambda v: F.count_if(first & (F.col(score) == v))
    t = df.groupBy(*keys).agg(n(-1).alias("a"), n(0).alias("z"), n(1).alias("b"), F.max(F.when(F.col(rater) == 4, F.col(score))).alias("fourth"))
    tie = (F.col("a") == 1) & (F.col("z") == 1) & (F.col("b") == 1)
    return t.select(*keys, tie.alias("tied"), F.when(tie, F.col("fourth")).when(F.col("a") >= 2, -1).when(F.col("z") >= 2, 0).otherwise(1).alias("label"))


def rationale_pass(df: DataFrame, keys, labels: DataFrame | None = None, rater: str = "pass", need: int = 5) -> DataFrame:
    """Per item the pass whose votes agree with the labels in most cells, the lowest of equals. Without `labels`, those that
    `resolve` gives the votes, beside each vote: rows that are dealt by some of the keys are not dealt again."""
    if labels is None:
        cell, s = Window.partitionBy(*keys, "dimension"), F.col("score")
        counts = {"n_neg": F.count_if(s == -1), "n_zero": F.count_if(s == 0), "n_pos": F.count_if(s == 1), "n_votes": F.count(s)}
        joined = _checked(df.withColumns({c: n.over(cell) for c, n in counts.items()}).withColumns(resolved(need)), need)
    else:
        joined = df.join(labels, [*keys, "dimension"])
    scored = joined.groupBy(*keys, rater).agg(F.count_if(F.col("score") == F.col("label")).alias("matches"))
    return scored.groupBy(*keys).agg(F.max_by(rater, F.struct("matches", -F.col(rater))).alias("source_pass"), F.max("matches").alias("matches"))


def reconcile(a: DataFrame, b: DataFrame, keys, valid=("yes", "no"), case: list[str] | None = None) -> DataFrame:
    """Two reviewers' answers: the shared valid one, else unresolved; with `case`, one disagreement leaves its whole case unresolved."""
    both = a.select(*keys, F.col("answer").alias("a")).join(b.select(*keys, F.col("answer").alias("b")), list(keys))
    agreed = F.coalesce((F.col("a") == F.col("b")) & F.col("a").isin(*valid), F.lit(False))
    out = both.withColumn("agreed", agreed)
    if case:
        out = out.withColumn("agreed", F.bool_and("agreed").over(Window.partitionBy(*case)))
    return out.withColumn("answer", F.when(F.col("agreed"), F.col("a")))


def adjudicate(reconciled: DataFrame, rulings: DataFrame, keys) -> DataFrame:
    """Rulings fill unresolved answers; a ruling on an agreed one raises."""
    r = rulings.select(*keys, F.col("answer").alias("_ruling"))
    clash = F.raise_error(F.lit("a ruling changes an agreed answer")).cast("string")
    return reconciled.join(r, list(keys), "left").withColumn(
        "answer", F.when(F.col("answer").isNull(), F.col("_ruling")).when(F.col("_ruling").isNotNull(), clash).otherwise(F.col("answer"))).drop("_ruling")


def fail_closed(coordinates: DataFrame, assessments: DataFrame, keys) -> DataFrame:
    """Every coordinate with its verdict; abstain where the review failed or says nothing."""
    rows = assessments.select(*keys, F.when(F.col("review_status") == "ok", F.col("verdict")).alias("_verdict"))
    return coordinates.join(rows, list(keys), "left").withColumn("verdict", F.coalesce("_verdict", F.lit("abstain"))).drop("_verdict")


def id_problems(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, unknown or given twice."""
    counts = got.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = expected.select(key).distinct().withColumn("_wanted", F.lit(True)).join(counts, key, "full_outer")
    why = F.when(F.col("_wanted").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    return both.withColumn("problem", why).where("problem is not null").select(key, "problem")
