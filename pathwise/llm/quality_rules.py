"""Host-level quality rules, in DataFrame functions only.

Every document gets word measures and a base verdict. Failures are summed by host (the `source` column), each
host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts by moments, and the verdict on
the host is joined back to its documents.

Defined cases: a null text has no words (and fails the base rule); a null source is a host of its own; an empty
table gives an empty result; repeated rows count as often as they occur; other columns are ignored by `measures` and
kept by `keep_documents`. The measures are written once to the shared folder, so the text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import WORD, text_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when more than this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.6
#: Weight of the prior, in documents, where the hosts' rates do not vary enough to fit one.
DEFAULT_PRIOR = 10.0

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _with_measures(docs: DataFrame) -> DataFrame:
    """`docs` with the five measures. Windows are sorted by hash and position inside their row, so equal ones meet."""
    window = lambda i: F.struct(F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]).alias("h"), i.alias("i"))
    split = docs.withColumn("_t", text_of()).withColumns({
        "_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)),
        "_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)),
        "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
    }).drop("_t")
    sized = split.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_g": F.when(F.size("_w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    }).drop("_w", "_l")
    twice = lambda x, j: ((j > 0) & (F.get("_g", j - 1)["h"] == x["h"])) | F.coalesce(F.get("_g", j + 1)["h"] == x["h"], F.lit(False))
    found = sized.withColumn("_s", F.sort_array(F.transform(F.filter("_g", twice), lambda x: x["i"]))).drop("_g")
    # A window at s covers the words s to s + 2; a word already covered by the window before it is not counted again.
    cover = F.aggregate("_s", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct((s + 3).alias("end"), (a["n"] + s + 3 - F.greatest(a["end"], s)).alias("n")), lambda a: a["n"])
    return found.withColumn("n_repeat_words", cover).drop("_s")


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures, n_words and base_failed of every row."""
    out = _with_measures(docs.select("doc_id", "source", "text").withColumn("text", text_of()))
    return out.withColumn("base_failed", _failed()).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host_key, host_rate (shrunk) and host_kept, one row a host. The prior is Beta(m s, (1 - m) s) with the mean m of
    the hosts' rates and s = m (1 - m) / variance - 1, from one aggregate row over the hosts."""
    hosts = measured.groupBy(F.col("source").alias("host_key")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    prior = hosts.agg(F.avg(F.col("f") / F.col("n")).alias("m"), F.var_pop(F.col("f") / F.col("n")).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(DEFAULT_PRIOR))
    prior = prior.select("m", strength.alias("s"))
    # The prior is a single row by construction (a global aggregate), hence the broadcast.
    shrunk = hosts.join(F.broadcast(prior), F.lit(True)).withColumn("host_rate", (F.col("f") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")))
    return shrunk.select("host_key", "host_rate", (F.col("host_rate") <= max_rate).alias("host_kept"))


def apply_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The measures of every row of `docs` with host_rate and kept."""
    measured = written(measures(docs), "quality-rules")
    hosts = host_verdicts(measured, max_rate)
    joined = measured.join(hosts, measured["source"].eqNullSafe(hosts["host_key"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_key", "host_kept")


def keep_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of `docs`, all columns, that pass the base rule and whose host passes."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "source", "text")
    judged = _with_measures(packed).select("_row", "source", _failed().alias("base_failed"))
    judged = written(judged, "quality-kept")
    hosts = host_verdicts(judged, max_rate)
    kept = judged.filter(~F.col("base_failed")).join(hosts, judged["source"].eqNullSafe(hosts["host_key"]), "left").filter("host_kept")
    return kept.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from pathwise.llm.common import table

    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM win),
rep AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10.0 END AS s FROM p),
r AS (SELECT source, (f + m * s) / (n + s) <= 0.6 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_kept) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
