"""Joins with integrity, overlays, reshapes, upserts and ranked selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.schema import assert_columns, assert_unique
from pathwise.session import checkpointed


#: Rows of both sides in a partition of `orphans`.
ROWS = 1_000_000


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Key rows of either side that the other lacks, with the side.

    Both sides are dealt by key over a partition per `ROWS` of their rows, and joined by sorting, which can spill: sorted keys
    shrink so far in an exchange that Spark, which merges partitions by their size there, would leave tasks of any number of
    rows.
    """
    left, right = left.select(*keys), right.select(*keys)
    parts = max(left.sparkSession.sparkContext.defaultParallelism, -(-(left.count() + right.count()) // ROWS))
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    one = lambda a, b, side: a.join(b.hint("merge"), keys, "left_anti").withColumn("side", F.lit(side))
    return one(left, right, "left").unionByName(one(right, left, "right"))


def merge_with_integrity(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Inner join that raises if a row of either side finds no partner (with `strict`), naming up to five of each.

    Both sides' presence comes from one aggregation over the keys; orphans are looked up only after a failure.
    """
    assert_columns(left, keys), assert_columns(right, keys)
    if strict:
        lost = orphans(left, right, keys)
        counts = {r["side"]: r["count"] for r in lost.groupBy("side").count().collect()}
        if counts:
            some = [tuple(r) for r in lost.limit(5).collect()]
            raise ValueError(f"join on {keys} drops rows: {counts}, such as {some}")
    return left.join(right, keys, "inner")


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], validate: str, how: str = "left") -> DataFrame:
    """Join after checking that keys are unique: '1:1' on both sides, 'm:1' on the right, '1:m' on the left."""
    if validate in ("1:1", "1:m"):
        assert_unique(left, keys)
    if validate in ("1:1", "m:1"):
        assert_unique(right, keys)
    return left.join(right, keys, how)


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_right", how: str = "inner") -> DataFrame:
    """Join in which columns of the right side that the left has, too, get a suffix."""
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), keys, how)


def overlay(base: DataFrame, delta: DataFrame, keys: list[str], values: list[str], default: dict[str, Column] | None = None) -> DataFrame:
    """`base` with `values` taken from `delta` where it has the key, a null there included (then `default`, if given)."""
    d = delta.select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values), F.lit(True).alias("_hit"))
    out = base.join(d, keys, "left")
    new = lambda v: F.coalesce(F.col(f"_new_{v}"), (default or {}).get(v, F.lit(None)))
    return out.withColumns({v: F.when(F.col("_hit"), new(v)).otherwise(F.col(v)) for v in values}).drop("_hit", *(f"_new_{v}" for v in values))


def shared_keys(df: DataFrame, keys: list[str], rater: str, n: int) -> DataFrame:
    """Keys that all `n` raters have."""
    return df.groupBy(*keys).agg(F.count_distinct(rater).alias("_n")).where(F.col("_n") == n).select(*keys)


def key_differences(a: DataFrame, b: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Keys on one side only, or with other values in `same`: empty where both agree."""
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in same), F.lit(True).alias("_a"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in same), F.lit(True).alias("_b"))
    differ = reduce(lambda x, y: x | y, (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in same), F.col("_a").isNull() | F.col("_b").isNull())
    why = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").otherwise("differs")
    return left.join(right, keys, "full_outer").where(differ).select(*keys, why.alias("why"))


def pass_differences(df: DataFrame, item: str | list[str], rater: str, value: str) -> DataFrame:
    """How many items each pair of raters (a < b) labels differently, of how many shared ones.

    The raters of an item (a handful) pair up inside its row, so each item is read once.
    """
    rows = df.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("v")))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["r"] > a["r"]), lambda b: F.struct(a["r"].alias("a"), b["r"].alias("b"), (~a["v"].eqNullSafe(b["v"])).alias("differ")))))
    return rows.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"), F.count_if("differ").alias("n_differ"))


def mean_of(*columns: str) -> Column:
    """Mean of the columns' values without nulls; 0 for no columns."""
    if not columns:
        return F.lit(0.0)
    values = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def strict_map(column: str, mapping: dict) -> Column:
    """`column` through a mapping; a value that it lacks raises when the row is read, a null stays null."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), F.col(column))
    known = F.array(*(F.lit(k) for k in mapping))
    return F.when(F.col(column).isNull(), F.lit(None)).when(F.array_contains(known, F.col(column)), found).otherwise(
        F.raise_error(F.concat(F.lit(f"no mapping for {column} = "), F.col(column).cast("string"))))


def wide_to_long(df: DataFrame, ids: list[str], prefix: str, names, value: str, dimension: str = "dimension") -> DataFrame:
    """Columns <prefix><name> as rows of (ids, dimension, value)."""
    return df.select(*ids, F.inline(F.array(*(F.struct(F.lit(n).alias(dimension), F.col(prefix + n).alias(value)) for n in names))))


def long_to_wide(df: DataFrame, ids: list[str], prefix: str, names, value: str, dimension: str = "dimension") -> DataFrame:
    """The inverse: one column per name, by one aggregation; a name given twice for an id raises."""
    is_ = lambda n: F.col(dimension) == n
    kind = df.schema[value].dataType
    cell = lambda n: F.when(F.count_if(is_(n)) > 1, F.raise_error(F.lit(f"{n} occurs twice for a row")).cast(kind)).otherwise(F.max(F.when(is_(n), F.col(value))))
    return df.groupBy(*ids).agg(*(cell(n).alias(prefix + n) for n in names))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` without the keys of `new`, and `new`; columns that one side lacks become typed nulls.

    A column that is all null with no type on one side takes the other's type.
    """
    assert_unique(new, keys)

    def typed(df: DataFrame, other: DataFrame) -> DataFrame:
        kinds = dict(other.dtypes)
        return df.withColumns({c: F.col(c).cast(kinds[c]) for c, kind in df.dtypes if kind == "void" and c in kinds})

    existing, new = typed(existing, new), typed(new, existing)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True).select(*existing.columns, *(c for c in new.columns if c not in existing.columns))


def insert_unique(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` and `new`; a key of `new` that exists raises."""
    clash = new.join(existing.select(*keys), keys, "left_semi").select(*keys).limit(5).collect()
    if clash:
        raise ValueError(f"keys exist already: {[tuple(r) for r in clash]}")
    return existing.unionByName(assert_unique(new, keys))


def update_flag(df: DataFrame, key: str, value, flag: str) -> DataFrame:
    """`df` with `flag` true where `key` is `value`; raises where no row is."""
    if df.where(F.col(key) == value).isEmpty():
        raise ValueError(f"no row with {key} = {value!r}")
    return df.withColumn(flag, F.when(F.col(key) == value, True).otherwise(F.col(flag)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First `k` rows of each group. Spark keeps only k rows per group and task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fill_buckets(df: DataFrame, by: list[str], tiers: list[Column], size: int, order: list[Column]) -> DataFrame:
    """`size` rows of each group, from the lowest tier on that a row matches; rows that match none come last."""
    tier = reduce(lambda acc, it: acc.when(it[1], it[0]), enumerate(tiers[1:], 1), F.when(tiers[0], 0)).otherwise(len(tiers))
    return top_k(df.withColumn("tier", tier), by, [F.col("tier"), *order], size)


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """`df` with `turn`: rows of all groups in turns, the first of each, then the second, and so on."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def digest(*parts) -> Column:
    """Hex SHA-256 of the parts joined by '|': a shuffle order that every run repeats."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)), 256)


def nearest_quantiles(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """Values at rank round(q * (n - 1)) of the sorted non-null values (half to even), distinct and ascending.

    Ranks come from counts of distinct values, so nothing is gathered: the window runs over them per range partition.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, "v", "n")
    total = counts.agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*(F.bround(F.lit(float(q)) * (F.col("total") - 1)).cast("long") for q in points))).alias("at")
    return ranked.join(F.broadcast(total.select(wanted)), (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select(F.col("v").alias(value)).distinct()  # one row per point


def running_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """`upto`: sum of `value` over all rows up to this one in `order`, without one task that holds all of them.

    Rows are dealt by ranges; sums within a range add to the sums of the ranges before it (one row per range). The ranges
    come from samples that differ from run to run, so rows and sums read the same ranges, kept with the rows.
    """
    dealt = checkpointed(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    inner = dealt.withColumn("_sum", F.sum(value).over(Window.partitionBy("_part").orderBy(order)))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_all"))
    offset = F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inner.join(F.broadcast(sums.select("_part", offset.alias("_offset"))), "_part").withColumn("upto", F.col("_sum") + F.col("_offset")).drop("_part", "_sum", "_offset")
