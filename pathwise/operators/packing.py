"""Sequential packing and split search without one task or driver that sees all rows.

`capped_shards` is what a loop over sorted groups does: a shard takes the next groups until a cap would be passed. Where a
shard that begins at a group ends depends on that group alone, so the loop is a chain of pointers: next-boundary pointers
by ranges of running sums, pointers out of each chunk, and doubling over chunks. `stratified_split` scores thousands of
seeded permutations at once: a permutation is a keyed bijection of row numbers, so a row's place in each is computed where
the row is, and what meets are sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.operators.relational import running_sum
from pathwise.session import checkpointed

#: Rows of a chunk of `capped_shards`, at least.
CHUNK = 4096
#: Permutations scored, at most, and for each row of a small table; the parts of a score.
MOST, LEAST, PER_ROW = 4096, 256, 32
MEAN_SHARE, MISSING = 0.5, 10.0
ROUNDS, FACTOR = 4, 0x9E3779B1


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """`rows` with `place`, from 0 in `order`, whose values differ. Ranges are counted, no task sees all rows."""
    return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one").withColumn("place", F.col("upto") - 1).drop("_one", "upto")


def capped_shards(groups: DataFrame, group: str, size: str, max_groups: int, max_size: int, chunk: int = CHUNK) -> DataFrame:
    """group, size and shard (from 1) of every group, in order of `group`: a shard takes groups in order while it has fewer
    than `max_groups` and their sizes add to at most `max_size`; a group that is larger by itself has a shard of its own."""
    if max_groups < 1 or max_size < 0 or chunk < max_groups:
        raise ValueError("a shard holds a group at least, a chunk a shard")
    rows = numbered(running_sum(groups.select(F.col(group).alias("_group"), F.col(size).cast("long").alias("_size")), "_group", "_size").withColumnRenamed("upto", "_upto"), "_group")
    rows = rows.select("_group", "_size", "place", (F.col("_upto") - F.col("_size")).alias("_before"), F.floor(F.col("place") / chunk).alias("_chunk"))
    # A row is seen in its own chunk, and by the chunk before as what may follow there: shards hold at most max_groups.
    seen = rows.select("*", F.explode(F.when(F.col("place") % chunk <= max_groups, F.array("_chunk", F.col("_chunk") - 1)).otherwise(F.array("_chunk"))).alias("_in"))
    ahead = Window.partitionBy("_in").orderBy("_before").rangeBetween(0, max_size)
    beyond = F.greatest(F.col("place") + 1, F.least(F.max("place").over(ahead), F.col("place") + max_groups))
    last = F.max("place").over(Window.partitionBy("_in"))
    # The last row's shard may reach past it: then nothing follows.
    whole = F.max("_upto").over(Window.partitionBy("_in"))
    seen = seen.withColumn("_upto", F.col("_before") + F.col("_size"))
    ends = (beyond == last) & (whole - F.col("_before") <= max_size) & (last + 1 - F.col("place") <= max_groups)
    nexts = checkpointed(seen.withColumn("_next", F.when(ends, last + 1).otherwise(beyond)).where("_in = _chunk").select("_group", "_size", "place", "_chunk", "_next"))

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        first, nxt = int(pdf["place"].iloc[0]), pdf["_next"].to_numpy(np.int64)
        out = nxt.copy()
        for k in range(len(out) - 1, -1, -1):
            if out[k] < first + len(out):
                out[k] = out[out[k] - first]
        return pd.DataFrame({"place": pdf["place"][:max_groups], "to": out[:max_groups]})

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        first, nxt, at = int(pdf["place"].iloc[0]), pdf["_next"].tolist(), pdf["_entry"].iloc[0]
        begins, k = np.zeros(len(pdf), np.int64), len(pdf) if pd.isna(at) else int(at) - first
        while k < len(pdf):
            begins[k] = 1
            k = nxt[k] - first
        return pd.DataFrame({"_group": pdf["_group"], "_size": pdf["_size"], "begins": begins})

    # Entries of a chunk are among its first max_groups rows. Doubling: after k rounds those within 2^k chunks are known.
    jumps = checkpointed(nexts.groupBy("_chunk").applyInPandas(leave, "place long, to long"))
    entries, chunks = jumps.where("place = 0").select("place"), (nexts.agg(F.max("_chunk")).first()[0] or 0) + 1
    known = 1
    while known < chunks:
        entries = checkpointed(entries.union(entries.join(jumps, "place").select(F.col("to").alias("place"))).distinct())
        jumps = checkpointed(jumps.join(jumps.select(F.col("place").alias("to"), F.col("to").alias("_far")), "to").select("place", F.col("_far").alias("to")))
        known *= 2
    entry = entries.groupBy(F.floor(F.col("place") / chunk).alias("_chunk")).agg(F.min("place").alias("_entry"))  # the last pointer is behind the last row
    kind = groups.schema[group].dataType.simpleString()
    marked = nexts.join(entry, "_chunk", "left").groupBy("_chunk").applyInPandas(mark, f"_group {kind}, _size long, begins long")
    return running_sum(marked, "_group", "begins").select(F.col("_group").alias(group), F.col("_size").alias(size), F.col("upto").alias("shard"))


def half_bits(rows: int) -> int:
    """Bits of each half of the smallest even-sized domain that holds the row numbers."""
    return max(1, -(-max(1, (rows - 1).bit_length()) // 2))


def permuted(places: np.ndarray, rows: int, number: np.ndarray, seed: int) -> np.ndarray:
    """Where permutation `number` (both broadcast) puts each row number: a Feistel network of `ROUNDS` rounds on the numbers'
    halves, walked until it is inside the rows again."""
    half = half_bits(rows)
    mask = np.int64((1 << half) - 1)
    shape = np.broadcast(places, number).shape
    now, number = np.broadcast_to(places, shape).astype(np.int64), np.broadcast_to(number, shape).astype(np.int64)
    todo = np.ones(shape, bool)
    while todo.any():
        left, right = now[todo] >> half, now[todo] & mask
        for k in range(ROUNDS):
            mixed = right * FACTOR + (number[todo] * 7919 + k * 104_729 + seed) * 65_537
            left, right = right, left ^ ((mixed >> np.int64(7)) ^ (mixed >> np.int64(19))) & mask
        now[todo] = (left << half) | right
        todo &= now >= rows
    return now


def stratified_split(flags: DataFrame, key: str, features: list[str], n_train: int, n_val: int, seed: int = 7, permutations: int | None = None) -> DataFrame:
    """key, split (train, val or test), permutation and score: the split by the best of many seeded permutations, the first
    of those that tie. A score adds the largest gap between a part's share of a feature and all rows' share, half the mean
    gap, and ten for every feature that a part lacks though it should have one; parts are val and test."""
    rows = numbered(flags.select(key, *features), key)
    total = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f).cast("long")).alias(f) for f in features)).first()
    n = total["n"]
    if not n:
        return rows.select(key, F.lit(None).cast("string").alias("split"), F.lit(None).cast("long").alias("permutation"), F.lit(None).cast("double").alias("score"))
    tries = permutations or min(MOST, max(LEAST, PER_ROW * n))
    sizes = [min(n_val, max(0, n - n_train)), max(0, n - n_train - n_val)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((tries, 2, len(features)), np.int64)
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                places = permuted(part["place"].to_numpy(np.int64)[None, :], n, np.arange(tries)[:, None], seed)
                matrix = part[features].to_numpy(np.float64)
                for j, inside in enumerate(((places >= n_train) & (places < n_train + n_val), places >= n_train + n_val)):
                    found[:, j] += (inside.astype(np.float64) @ matrix).astype(np.int64)
        if found.any():
            yield pd.DataFrame({"permutation": np.arange(tries), **{f"{p}_{i}": found[:, j, i] for j, p in enumerate(("v", "t")) for i in range(len(features))}})

    names = [f"{p}_{i}" for p in ("v", "t") for i in range(len(features))]
    summed = rows.mapInPandas(sums, "permutation long, " + ", ".join(f"{c} long" for c in names)).groupBy("permutation").agg(*(F.sum(c).alias(c) for c in names))
    most, means, missing = [], [], F.lit(0)
    for size, p in zip(sizes, ("v", "t"), strict=True):
        if not size:
            continue
        gaps = [F.abs(F.col(f"{p}_{i}") / size - total[f] / n) for i, f in enumerate(features)]
        most += gaps
        means.append(sum(gaps, F.lit(0.0)) / len(gaps))
        wanted = [i for i, f in enumerate(features) if total[f] > 0 and total[f] * (size / n) >= 1.0]
        missing = sum((F.when(F.col(f"{p}_{i}") == 0, 1).otherwise(0) for i in wanted), missing)
    score = (F.greatest(*most) if len(most) > 1 else most[0] if most else F.lit(0.0)) + (sum(means, F.lit(0.0)) / len(means) * MEAN_SHARE if means else F.lit(0.0)) + missing * MISSING
    best = summed.select("permutation", F.round(score, 12).alias("score")).orderBy("score", "permutation").limit(1).first()
    number, value = (best["permutation"], best["score"]) if best else (0, 0.0)
    place = F.pandas_udf(lambda p: pd.Series(permuted(p.to_numpy(np.int64), n, np.int64(number), seed)), "long")
    at = place("place")
    split = F.when(at < n_train, "train").when(at < n_train + n_val, "val").otherwise("test")
    return rows.select(key, split.alias("split"), F.lit(number).cast("long").alias("permutation"), F.lit(float(value)).alias("score"))
