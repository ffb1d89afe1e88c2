"""Mixing sources to target word counts by subset-sum budget fitting.

Sources, sorted by code point with null last, weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess goes to the others by weight (`source_targets`). A source then gives all its
documents `floor(target / words)` times, and the remaining budget is fitted from its counts of documents by exact
length: a proportional draft, and bounded-knapsack dynamic programming for what the draft leaves, all of it where the draft
would miss (`fit_counts`). Which
documents of a length are taken follows a seeded hash of id and text: counts by 1/256 of the hash range give whole takes, and only
the range at the boundary is ranked, so that no task sees all documents of a common length. All this moves numbers, not
texts; the mix itself joins them to the rows by the rows' own numbers.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own; repeated rows
are mixed as separate documents; sources without words have target 0; an empty table gives an empty result; extra
columns of any name are carried by `mix_documents`. The same rows and seed give the same mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import WORD, table, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 17
RANGES = 256
#: Mean document lengths that the draft leaves to the dynamic programme at first, and the part of the budget up to which
#: a gap is taken; a wider one has a smaller draft tried, four times as much left each time, while sums up to MOST_SUMS are
#: in reach of the programme's table. Without a draft the best sum of all is found.
SLACK_DOCS, GAP, MOST_SUMS = 8, 1000, 1 << 24


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take (at most `counts`) for a total near `budget`, never above it.

    The draft takes the same share of every length, then one more of some lengths while they fit. The rest of the
    budget, a few documents' words, is fitted by bounded-knapsack dynamic programming over the documents left. Where
    that misses the budget by more than one part in `GAP`, more is left to the programme."""
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    slack, best, best_gap = SLACK_DOCS * -(-total // int(counts.sum())), None, budget + 1
    while True:
        take = _fitted(sizes, counts, budget, total, max(0, budget - slack))
        gap = budget - int((sizes * take).sum())
        if gap < best_gap:
            best, best_gap = take, gap
        if best_gap * GAP <= budget or slack >= budget or 4 * slack > MOST_SUMS:
            return best
        slack *= 4


def _fitted(sizes: np.ndarray, counts: np.ndarray, budget: int, total: int, draft: int) -> np.ndarray:
    """A draft of `draft` words, the rest by dynamic programming: each length's count is split into powers of two, and
    `made_by` holds the piece that first reached a sum."""
    exact = counts * (draft / total)
    take = np.minimum(np.floor(exact).astype(np.int64), counts)
    left = budget - int((sizes * take).sum())
    slack = budget - draft
    shuffled = np.random.default_rng(SEED).permutation(len(sizes))
    for k in shuffled[np.argsort((np.floor(exact) - exact)[shuffled], kind="stable")] if draft else ():  # the largest fractions first, ties in seeded order
        if take[k] < counts[k] and left - sizes[k] >= slack:
            take[k] += 1
            left -= int(sizes[k])
    reach, made_by = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64)
    reach[0] = True
    pieces: list[tuple[int, int]] = []
    for k in np.argsort(-sizes, kind="stable"):
        free, part = int(min(counts[k] - take[k], left // sizes[k])), 1
        while free > 0 and not reach[left]:
            n = min(part, free)
            w = n * int(sizes[k])
            new = np.flatnonzero(reach[: left + 1 - w] & ~reach[w:]) + w
            made_by[new] = len(pieces)
            reach[new] = True
            pieces.append((int(k), n))
            free, part = free - n, 2 * part
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, n = pieces[made_by[at]]
        take[k] += n
        at -= n * int(sizes[k])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable")
    words, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // words)
    extra = fit_counts(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(round(target - whole * words)))
    return pd.DataFrame({"skey": rows["skey"], "size": rows["size"], "whole": np.int64(whole), "extra": extra})


def _before(rows: DataFrame, order: list, sums: dict, name: str) -> DataFrame:
    """`rows` with the sums of what stands before each in `order`, by ranges: sums within a range's part add to those of
    the parts before, of which there are as many as partitions, hence the window over them and the broadcast."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_part", F.shiftright("_row", 33)), name)
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*(F.sum(value).alias(f"_{c}") for c, value in sums.items()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums))
    out = dealt.join(F.broadcast(parts), "_part")
    return out.select(*rows.columns, *((F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(f"_{c}")).alias(c) for c, value in sums.items()))


def source_targets(sources: DataFrame) -> DataFrame:
    """skey, source_size and target of one row per source (skey, source, source_size), however many sources there are.
    Level filling in closed form: sorted by cap over weight, the first source whose cap is above the level of those from
    it on is where capping ends. Sums are of whole numbers, so any dealing gives the same."""
    ranked = _before(sources, [F.col("source").asc_nulls_last(), "skey"], {"place": F.lit(1)}, "mix-ranked")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    rows = ranked.select("skey", "source_size", weight.alias("weight"), (F.col("source_size") * MAX_REPEAT).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = _before(rows, ["ratio", "skey"], {"caps": F.col("cap"), "weights": F.col("weight")}, "mix-ratios")
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("all"))  # one row, as is the level
    above = rows.join(F.broadcast(whole), F.lit(True)).withColumn("level", (F.col("size") * SHARE - F.col("caps")) / (F.col("all") - F.col("weights")))
    level = above.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).alias("first")).select(F.col("first.level").alias("level"))
    return rows.join(F.broadcast(level), F.lit(True)).select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, seed: int, *carried) -> DataFrame:
    """uid (the row's number), skey, source, _id, size and the seeded hash of every row, written once: the text is read and
    its words counted once."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), text_of())
    sized = docs.select(
        *carried, F.monotonically_increasing_id().alias("uid"), key.alias("skey"), "source", F.col("doc_id").alias("_id"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), hashed.alias("_hash"), F.pmod(hashed, F.lit(RANGES)).cast("int").alias("_range"),
    )
    return written(sized, "mix-sized")


def _times(sized: DataFrame) -> DataFrame:
    """uid, _id, size, source_size, target and times, how often the mix takes the row, for every row of `sized`."""
    sized = sized.select("uid", "skey", "source", "_id", "size", "_hash", "_range")
    ranges = sized.groupBy("skey", "source", "size", "_range").agg(F.count("*").alias("_n"))
    lengths = ranges.groupBy("skey", "source", "size").agg(F.sum("_n").alias("n"))
    targets = source_targets(lengths.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    fitted = lengths.filter("size > 0").join(targets, "skey").select("skey", "size", "n", "source_size", "target")
    plan = fitted.groupBy("skey").applyInPandas(_fit_source, "skey string, size long, whole long, extra long")
    upto = Window.partitionBy("skey", "size").orderBy("_range")
    cut = ranges.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).join(plan, ["skey", "size"], "left").join(targets, "skey")
    # Of a range the first `_take` rows are taken once more than `_whole` times.
    take = F.least(F.col("_n"), F.greatest(F.lit(0), F.coalesce("extra", F.lit(0)) - F.col("_before")))
    cut = written(cut.select("skey", "size", "_range", "source_size", "target", "_n", F.coalesce("whole", F.lit(0)).alias("_whole"), take.alias("_take")), "mix-cut")
    placed = sized.join(cut, ["skey", "size", "_range"])
    rank = F.row_number().over(Window.partitionBy("skey", "size", "_range").orderBy("_hash", "_id", "uid"))
    split = (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
    one = placed.filter(~split).withColumn("_more", (F.col("_take") > 0).cast("long"))
    other = placed.filter(split).withColumn("_rank", rank).withColumn("_more", (F.col("_rank") <= F.col("_take")).cast("long")).drop("_rank")
    return one.unionByName(other).select("uid", "_id", "size", "source_size", "target", (F.col("_whole") + F.col("_more")).alias("times"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    out = _times(_sized(docs, seed))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs`, all columns, as often as it is taken."""
    sized = _sized(docs, seed, F.struct(*docs.columns).alias("row"))
    taken = _times(sized).filter("times > 0").select("uid", "times")
    return sized.select("uid", "row").join(taken, "uid").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
