"""A bounded, repeatable sample of labelled rows for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(rows: DataFrame, label: str, per_label: int, labels: int | None = 64, seed: int = 5) -> DataFrame:
    """About `per_label` rows of each of the `labels` most frequent values of `label` (of every value for None; all rows
    of a value that has fewer), `per_label * labels` in all at most.
    Whether a row is in follows a hash of its doc_id against a rate from its label's count, so that no task ranks or
    holds a label's rows. Where more rows are in, each label loses those next to its own rate."""
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    if labels is None:
        labels = max(1, counts.count())
    else:
        counts = counts.orderBy(F.desc("_n"), "_label").limit(labels)
    # One row a label, as the model that is fitted has, hence the broadcast: no label's rows move.
    rates = F.broadcast(counts.select("_label", (F.lit(float(per_label)) / F.col("_n")).alias("_rate")))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.withColumn("_unit", unit).join(rates, rows[label] == rates["_label"]).filter("_unit < _rate")
    return picked.orderBy(F.col("_unit") / F.col("_rate"), "doc_id").limit(per_label * labels).drop("_unit", "_label", "_rate")
