"""Writers: by suffix, JSON lines, Markdown, upserts into a folder, publishing once, and reuse of checked results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.operators.relational import upsert
from pathwise.schema import TIERS, assert_columns, assert_unique


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path: works on any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_frame(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Parquet, CSV or JSON lines, by the path's suffix; another suffix raises."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writers = {"parquet": lambda w: w.parquet(path), "csv": lambda w: w.option("header", True).csv(path), "jsonl": lambda w: w.json(path), "json": lambda w: w.json(path)}
    if kind not in writers:
        raise ValueError(f"no writer for {path!r}")
    writers[kind](df.write.mode(mode))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON with keys in order of name, nulls written, appended."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def persona_markdown(profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """persona_id, markdown: heading, profile lines, then the entries in order of t_index."""
    section = F.concat(F.lit("## Entry "), F.col("t_index").cast("string"), F.lit(" - "), F.col("date"), F.lit("\n\n"), F.concat_ws(
        "\n\n", "initial_entry", F.when(F.col("nudge_text").isNotNull(), F.concat(F.lit('**Nudge:** "'), "nudge_text", F.lit('"'))), F.when(F.col("response_text").isNotNull(), F.concat(F.lit("**Response:** "), "response_text"))))
    body = entries.groupBy("persona_id").agg(F.array_sort(F.collect_list(F.struct("t_index", section.alias("s")))).alias("x"))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- **{c.replace('_', ' ').title()}:** "), F.col(c))) for c in profiles.columns if c not in ("persona_id", "name")]
    text = F.concat_ws("\n\n---\n\n", F.concat(F.lit("# Persona "), F.col("persona_id"), F.lit(": "), F.coalesce("name", F.lit("")), F.lit("\n\n"), F.concat_ws("\n", *lines)), F.array_join("x.s", "\n\n---\n\n"))
    return profiles.join(body, "persona_id", "left").select("persona_id", text.alias("markdown"))


def write_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key the folder does not have: a rerun writes nothing."""
    new = df
    if exists(df.sparkSession, path):
        new = df.join(df.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)


def write_new_stage(df: DataFrame, path: str, keys: list[str], registry: DataFrame, flag: str) -> DataFrame:
    """`write_new`, then the registry with `flag` set for every key that the folder has: the same after any number of reruns,
    also after one that wrote rows and died before the registry was stored."""
    write_new(df, path, keys)
    done = df.sparkSession.read.parquet(path).select(*keys).distinct().withColumn("_done", F.lit(True))
    out = registry.join(done, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("_done", F.lit(False)))
    return out.select(*registry.columns)


def swap_in(df: DataFrame, path: str) -> None:
    """Replaces a Parquet folder by `df`, which may read it: written beside it, then renamed into place.

    A failure before the renames leaves the old folder; between the two renames there is a moment without one, and a failure
    there leaves the old rows beside it under '.old-'. One writer at a time.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(fresh)
    fs, p = _fs(spark, path)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p):
        fs.rename(p, new_path(old))
    fs.rename(new_path(fresh), p)
    if fs.exists(new_path(old)):
        fs.delete(new_path(old), True)
    spark.catalog.refreshByPath(path)


def upsert_into(new: DataFrame, path: str, keys: list[str], check: Column | None = None) -> None:
    """Upserts rows into a Parquet folder, with columns reconciled both ways; rows that fail `check` raise before anything is written."""
    if check is not None and not new.where(~F.coalesce(check, F.lit(False))).isEmpty():
        raise ValueError("rows outside their domain")
    spark = new.sparkSession
    swap_in(upsert(spark.read.parquet(path), new, keys) if exists(spark, path) else new, path)


def annotation_check(columns: list[str]) -> Column:
    """Every score is -1, 0 or 1."""
    return F.forall(F.array(*columns), lambda x: x.between(-1, 1))


def write_consensus(df: DataFrame, path: str, required: list[str], tiers: list[str]) -> None:
    """The required columns in their order, after a check that the tier columns hold known tiers."""
    assert_columns(df, [*required, *tiers])
    if not df.where(~F.forall(F.array(*tiers), lambda x: x.isin(*TIERS))).isEmpty():
        raise ValueError("unknown confidence tier")
    df.select(*required).write.mode("overwrite").parquet(path)


def publish_once(df: DataFrame, path: str, check=None) -> None:
    """Writes to a temporary folder, checks what was written, renames; an existing target raises."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    temporary = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    df.write.parquet(temporary)
    fs, p = _fs(spark, path)
    try:
        if check is not None:
            check(spark.read.parquet(temporary))
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(temporary), p):
            raise FileExistsError(path)
    finally:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(temporary), True)


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows as a multiset and of the schema, by one aggregation."""
    row = F.xxhash64(*(F.to_json(F.struct(F.col(c))) if "map" in t else F.col(c) for c, t in df.dtypes)) if df.columns else F.lit(0)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{got['n']}:{got['x']}:{got['s']}:{df.schema.simpleString()}"


def cached(df: DataFrame, path: str, provenance: str, check=None) -> DataFrame:
    """`df` as stored at `path`, reused only if the stored provenance and fingerprint hold (and `check` passes)."""
    spark = df.sparkSession
    note = f"{path.rstrip('/')}.provenance"
    if exists(spark, path) and exists(spark, note):
        stored = spark.read.parquet(path)
        said = {r["value"] for r in spark.read.text(note).collect()}
        if said == {f"{provenance}\t{fingerprint(stored)}"} and (check is None or check(stored)):
            return stored
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    spark.createDataFrame([(f"{provenance}\t{fingerprint(stored)}",)], "value string").coalesce(1).write.mode("overwrite").text(note)
    return stored


def as_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


#: The fields of a weekly review's receipt, and its statuses.
RECEIPT = ("persona_id", "week_start", "week_end", "status", "assessments", "refusal", "validation_error", "prompt_sha256", "latency_seconds")
RECEIPT_STATUSES = ("ok", "refusal", "invalid", "error")


def persist_receipts(receipts: DataFrame, path: str) -> None:
    """One JSON per receipt, keys in order of name, in the folder of its persona and week: a receipt that is stored again
    replaces its own. A receipt with other fields, an unknown status, or assessments though it is not ok raises, and so do two
    of one week."""
    assert_columns(receipts, RECEIPT)
    ok = F.col("status").isin(*RECEIPT_STATUSES) & ((F.col("status") == "ok") | (F.coalesce(F.size("assessments"), F.lit(0)) <= 0))
    if not receipts.where(~F.coalesce(ok, F.lit(False))).isEmpty():
        raise ValueError("receipts outside their contract")
    assert_unique(receipts, ["persona_id", "week_start"])
    text = F.to_json(F.struct(*sorted(RECEIPT)), {"ignoreNullFields": "false"}).alias("value")
    receipts.select("persona_id", "week_start", text).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("persona_id", "week_start").text(path)


def read_receipts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
