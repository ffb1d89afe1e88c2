"""Scalar queries (survey rows F*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise import adapter
from pathwise.adapter import table
from pathwise.functions import scalars as fn
from pathwise.plans.base import Plans
from pathwise.schema import DIMS

plans = Plans()


def _docs(spark, sf):
    return table(spark, sf, "documents")


@plans.add("f01_normalized_name", "SELECT p_partkey, translate(lower(trim(p_name)), '- ', '__') AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.normalized_name("p_name").alias("name"))


WORDS = "[w FOR w IN regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') IF w <> '']"


@plans.add("f04_excerpt", f"SELECT doc_id, sha256(array_to_string(list_slice(w, 1, 40), ' ') || CASE WHEN len(w) > 40 THEN '...' ELSE '' END) AS digest FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(fn.excerpt("text"), 256).alias("digest"))


@plans.add("f05_char_excerpt", """SELECT doc_id, sha256(CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substring(t, 1, 60)) || '...' END) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(fn.char_excerpt("text", 60), 256).alias("digest"))


#: Turns by threes: an entry, a nudge and a response.
TURNS = "SELECT conv_id, turn // 3 AS part, max(CASE WHEN turn % 3 = 0 THEN text END) AS a, max(CASE WHEN turn % 3 = 1 THEN text END) AS b, max(CASE WHEN turn % 3 = 2 THEN text END) AS c FROM conversations GROUP BY 1, 2"


def _turns(spark, sf):
    part = lambda k, n: F.max(F.when(F.col("turn") % 3 == k, F.col("text"))).alias(n)
    return table(spark, sf, "conversations").groupBy("conv_id", F.expr("turn div 3").alias("part")).agg(part(0, "a"), part(1, "b"), part(2, "c"))


@plans.add("f06_entry_text", f"""SELECT conv_id, part, sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(a) <> '' THEN a END, CASE WHEN trim(b) <> '' THEN 'Nudge: "' || b || '"' END, CASE WHEN trim(c) <> '' THEN 'Response: ' || c END)) AS digest FROM ({TURNS})""")
def _(spark, sf):
    return _turns(spark, sf).select("conv_id", "part", F.sha2(fn.entry_text("a", "b", "c"), 256).alias("digest"))


@plans.add("f07_session_text", f"""SELECT conv_id, part, sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(a) <> '' THEN trim(a) END, CASE WHEN trim(b) <> '' THEN '**Nudge:** "' || trim(b) || '"' END, CASE WHEN trim(c) <> '' THEN '**Response:** ' || trim(c) END)) AS digest FROM ({TURNS})""")
def _(spark, sf):
    return _turns(spark, sf).select("conv_id", "part", F.sha2(fn.session_text("a", "b", "c"), 256).alias("digest"))


@plans.add("f08_word_count", f"SELECT doc_id, len({WORDS}) AS n_words FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", fn.word_count("text").alias("n_words"))


@plans.add("f09_token_text", "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') AS tokens FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fn.token_text("text").alias("tokens"))


@plans.add("f10_token_overlap", """WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT item_id, sum(n) AS n FROM c GROUP BY 1)
SELECT a.item_id, round(coalesce((SELECT sum(least(x.n, y.n)) FROM c x JOIN c y ON x.w = y.w WHERE x.item_id = a.item_id AND y.item_id = b.item_id), 0) / greatest(a.n, b.n), 6) AS overlap FROM s a JOIN s b ON b.item_id = a.item_id + 1""")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", F.round(fn.token_overlap("text", "other"), 6).alias("overlap"))


@plans.add("f11_content_words", """SELECT item_id, w, min(i) AS first_place FROM (SELECT item_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z0-9'']+') IF x NOT IN ('the', 'and', 'that')] AS l FROM benchmark)) GROUP BY ALL""")
def _(spark, sf):
    kept = F.filter(fn.tokens("text"), lambda t: ~t.isin("the", "and", "that"))
    words = table(spark, sf, "benchmark").select("item_id", kept.alias("l"), F.explode(fn.content_words("text", ("the", "and", "that"))).alias("w"))
    return words.select("item_id", "w", F.array_position("l", F.col("w")).alias("first_place"))


@plans.add("f12_occurrences", r"""WITH p AS (SELECT item_id, string_split_regex(lower(text), '\bthe\b') AS l FROM benchmark)
SELECT item_id, unnest([CAST(list_sum([length(x) FOR x IN list_slice(l, 1, k)]) AS INTEGER) + 3 * (k - 1) FOR k IN range(1, len(l))]) AS start FROM p""")
def occurrences(spark, sf):
    """Start (in characters) of every token 'the': lengths of the pieces between them add up."""
    pieces = F.split(F.lower("text"), r"\bthe\b")
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda k: k < F.size(pieces)), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, p: a + F.length(p)) + 3 * (k - 1))
    return table(spark, sf, "benchmark").select("item_id", F.explode(starts).alias("start"))


@plans.add("f13_without_word", r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe\b', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ([.,;:!?])', '\1', 'g')) AS text FROM benchmark")
def without(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fn.without_phrase("text", "the").alias("text"))


@plans.add("f14_banned", r"SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^\pL\pN_])(?:the|und)(?:$|[^\pL\pN_])') AS hit FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", fn.banned("text", ["the", "und"]).alias("hit"))


@plans.add("f15_leaked_labels", "SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(lower(p_name), '\\bring\\b') THEN 'ring' END, CASE WHEN regexp_matches(lower(p_name), '\\bsmall\\b') THEN 'small' END) AS leaked FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", fn.leaked_labels("p_name", ["ring", "small"])).alias("leaked"))


@plans.add("f16_quoted_phrases", """SELECT p_partkey, array_to_string([trim(q) FOR q IN regexp_extract_all('say "' || p_name || '" or " " and "' || p_brand || ' "', '"([^"]+)"', 1) IF trim(q) <> ''], '|') AS quotes FROM part""")
def _(spark, sf):
    said = F.concat(F.lit('say "'), "p_name", F.lit('" or " " and "'), "p_brand", F.lit(' "'))
    return table(spark, sf, "part").select("p_partkey", F.array_join(fn.quoted_phrases(said), "|").alias("quotes"))


def _label_pattern() -> str:
    return "|".join(d.replace("_", " ") for d in DIMS)


@plans.add("f17_narrative_checks", f"""WITH t AS (SELECT conv_id, part, a, 'You said "' || coalesce(a, NULL)[1:12] || '". ' || b AS x FROM ({TURNS}) WHERE b IS NOT NULL)
SELECT conv_id, part, CASE WHEN x IS NOT NULL THEN len([q FOR q IN [trim(r) FOR r IN regexp_extract_all(x, '"([^"]+)"', 1)] IF q <> '' AND contains(lower(a), lower(q))]) > 0 END AS groundedness,
  NOT (contains(lower(x), 'score') OR contains(lower(x), 'alignment') OR contains(lower(x), 'mean=')) AS non_circularity, NOT regexp_matches(lower(x), '\\b({_label_pattern()})\\b') AS value_leakage,
  NOT regexp_matches(x, '(?i)\\b(better|improv\\w*|progress\\w*|recover\\w*|success\\w*)\\b') AND (NOT regexp_matches(x, '(?i)\\b(did not continue|didn''t continue|pattern (has )?(ended|stopped))\\b') OR conv_id % 2 = 0) AS state_claims,
  len(regexp_extract_all(x, '[^\\s]+')) BETWEEN 25 AND 180 AS length FROM t""")
def narrative(spark, sf):
    df = _turns(spark, sf).where("b is not null").select("conv_id", "part", F.concat(F.lit('You said "'), F.substring("a", 1, 12), F.lit('". '), F.col("b")).alias("text"), F.array("a").alias("evidence"), (F.col("conv_id") % 2 == 0).alias("ended"))
    checks = fn.narrative_checks("text", "evidence", [d.replace("_", " ") for d in DIMS], ("score", "alignment", "mean="), r"\b(better|improv\w*|progress\w*|recover\w*|success\w*)\b", r"\b(did not continue|didn't continue|pattern (has )?(ended|stopped))\b", "ended")
    return df.select("conv_id", "part", *(c.alias(k) for k, c in checks.items()))


@plans.add("f18_contexts", "SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'und') AS hit FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", fn.contains_any("text", ["the", "und"]).alias("hit"))


@plans.add("f19_fallback_mode", """WITH g AS (SELECT persona_id, avg(score) AS m, avg(agreement) * 0.5 AS u, coalesce(bool_or(is_core AND score < 0), false) AS ct, coalesce(bool_or(score > 0), false) AS st, coalesce(bool_or(score < 0), false) AS te, min(event_id) % 5 = 0 AS di, min(event_id) % 3 = 0 AS sr FROM label GROUP BY 1)
SELECT persona_id, CASE WHEN u >= 0.3 THEN 'high_uncertainty' WHEN di THEN 'high_uncertainty' WHEN m < -0.15 AND ct THEN 'rut' WHEN st AND te AND m BETWEEN -0.15 AND 0.2 THEN 'mixed_state' WHEN NOT te AND st AND sr THEN 'background_strain' ELSE 'stable' END AS mode FROM g""", views=True)
def _(spark, sf):
    s, no = F.col("score"), F.lit(False)
    g = adapter.label(spark, sf).groupBy("persona_id").agg(
        F.avg(s).alias("m"), (F.avg("agreement") * 0.5).alias("u"), F.coalesce(F.bool_or(F.col("is_core") & (s < 0)), no).alias("ct"), F.coalesce(F.bool_or(s > 0), no).alias("st"), F.coalesce(F.bool_or(s < 0), no).alias("te"), F.min("event_id").alias("e"))
    return g.select("persona_id", fn.response_mode("m", "u", F.col("e") % 5 == 0, "ct", "st", "te", no, F.col("e") % 3 == 0).alias("mode"))


@plans.add("f20_placeholder", "SELECT p_partkey, regexp_full_match(trim(p_name), '(?i)(small|large) \\w+') AS hit FROM part")
def _(spark, sf):
    wrapped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" `"), "p_name", F.lit("` "))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", fn.placeholder(wrapped, r"(?i)(small|large) \w+").alias("hit"))


@plans.add("f21_valid_quote", """SELECT conv_id, turn, contains(a, q) AND (conv_id % 2 = 1 OR (trim(q) <> '' AND conv_id % 3 <> 0)) AS valid FROM (SELECT conv_id, turn, text AS a, CASE WHEN conv_id % 4 = 0 THEN 'not there at all' ELSE substring(text, 2, 9) END AS q FROM conversations WHERE text IS NOT NULL)""")
def _(spark, sf):
    c = F.col("conv_id")
    df = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("a"))
    quote = F.when(c % 4 == 0, "not there at all").otherwise(F.substring("a", 2, 9))
    return df.select("conv_id", "turn", fn.valid_quote("a", F.when(c % 2 == 0, "conflict").otherwise("abstain"), quote, F.lit("why"), F.when(c % 3 == 0, "low").otherwise("high")).alias("valid"))


@plans.add("f22_canonical_hash", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS digest FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.canonical_hash("o_orderstatus", "o_orderkey", "o_custkey").alias("digest"))


@plans.add("f23_unordered_hash", """SELECT o_custkey, sha256(string_agg(r, chr(10) ORDER BY r)) AS digest FROM (SELECT o_custkey, o_orderkey || ':' || o_orderstatus AS r FROM orders) GROUP BY 1""")
def _(spark, sf):
    row = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(row))), 256).alias("digest"))


@plans.add("f24_approx_tokens", "SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS n_tokens FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", fn.approx_tokens("text").alias("n_tokens"))


@plans.add("f25_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS sunday, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def _(spark, sf):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = F.to_date(iso, "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d"), fn.week_start(d).alias("monday"), fn.week_end(d).alias("sunday"), iso.alias("iso"))


@plans.add("f28_latest_window", "SELECT count(*) AS n, min(d) AS first_d FROM entry WHERE d > (SELECT max(d) FROM entry) - 7", views=True)
def _(spark, sf):
    e = adapter.entry(spark, sf).select("d")
    last = e.agg(F.max("d").alias("last"))  # one row
    return e.join(F.broadcast(last), F.col("d") > F.date_sub("last", 7)).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"))


WEIGHTS = "WITH c AS (SELECT DISTINCT persona_id, dim_index, is_core FROM label) SELECT persona_id, dim_index, CASE WHEN is_core THEN 1.0::DOUBLE ELSE 0 END / count(*) FILTER (WHERE is_core) OVER (PARTITION BY persona_id) AS weight FROM c"


@plans.add("f29_profile_weights", WEIGHTS, views=True)
def _(spark, sf):
    cores = adapter.label(spark, sf).where("is_core").groupBy("persona_id").agg(F.collect_set(F.initcap("dimension")).alias("v"))
    return cores.select("persona_id", F.posexplode(fn.profile_weights("v")).alias("dim_index", "weight"))


@plans.add("f30_detector_weights", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS total, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1 END AS DOUBLE) AS most FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    declared = F.when(k % 6 == 0, F.array("c_mktsegment", F.lit("Security"), F.lit("Power"))).when(k % 3 == 0, F.array("c_mktsegment", F.lit("Security"))).otherwise(F.array("c_mktsegment"))
    w = fn.profile_weights(declared, uniform=False)
    return table(spark, sf, "customer").select("c_custkey", F.aggregate(w, F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max(w).alias("most"))


@plans.add("f31_expected_alignment", "SELECT event_id, round(least(1.0, greatest(0.0, (value / 100 - 0.15) / 0.85)), 6) AS expected FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(fn.expected_alignment(F.col("value") / 100), 6).alias("expected"))


@plans.add("f32_discretize", "SELECT event_id, CASE WHEN v < -0.5 THEN -1 WHEN v > 0.5 THEN 1 ELSE 0 END AS c FROM (SELECT event_id, CAST(event_id % 9 - 4 AS DOUBLE) / 4 AS v FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.discretized((F.col("event_id") % 9 - 4).cast("double") / 4).alias("c"))


LOGITS = "SELECT event_id, CAST(event_id % 7 AS DOUBLE) / 2 AS a, CAST(event_id % 5 AS DOUBLE) / 2 AS b, CAST(event_id % 3 AS DOUBLE) / 2 AS c FROM events"
SOFTMAX = f"SELECT event_id, exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)) AS p, exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)) AS q, exp(c - m) / (exp(a - m) + exp(b - m) + exp(c - m)) AS r FROM (SELECT *, greatest(a, b, c) AS m FROM ({LOGITS}))"


def _logits(spark, sf):
    part = lambda n: (F.col("event_id") % n).cast("double") / 2
    return table(spark, sf, "events").select("event_id", F.array(part(7), part(5), part(3)).alias("z"))


def _softmax(spark, sf):
    return _logits(spark, sf).withColumn("p", fn.shifted_softmax("z"))


@plans.add("f33_expected_score", f"SELECT event_id, round(r - p, 6) AS score FROM ({SOFTMAX})")
def _(spark, sf):
    return _softmax(spark, sf).select("event_id", F.round(fn.expected_score("p"), 6).alias("score"))


@plans.add("f34_prior_shift", f"""SELECT event_id, round(exp(x) / (exp(x) + exp(y) + exp(z)), 6) AS p_neg, round(exp(z) / (exp(x) + exp(y) + exp(z)), 6) AS p_pos FROM (SELECT event_id, a - 0.5 * ln(0.1) AS x, b - 0.5 * ln(0.7) AS y, c - 0.5 * ln(0.2) AS z FROM ({LOGITS}))""")
def _(spark, sf):
    df = _logits(spark, sf).withColumn("prior", F.array(F.lit(0.1), F.lit(0.7), F.lit(0.2))).withColumn("p", fn.shifted_softmax("z", "prior", 0.5))
    return df.select("event_id", F.round(F.col("p")[0], 6).alias("p_neg"), F.round(F.col("p")[2], 6).alias("p_pos"))


@plans.add("f35_margin_class", f"SELECT event_id, CASE WHEN round(p, 9) >= round(q, 9) - 0.1 AND round(p, 9) >= round(r, 9) THEN -1 WHEN round(r, 9) > round(p, 9) AND round(r, 9) >= round(q, 9) - 0.05 THEN 1 ELSE 0 END AS c FROM ({SOFTMAX})")
def _(spark, sf):
    p = F.transform("p", lambda x: F.round(x, 9))
    return _softmax(spark, sf).select("event_id", fn.margin_class(p, F.lit(0.1), F.lit(0.05)).alias("c"))


@plans.add("f36_temperature", f"SELECT event_id, round(sqrt(p) / (sqrt(p) + sqrt(q) + sqrt(r)), 6) AS p_neg FROM ({SOFTMAX})")
def _(spark, sf):
    return _softmax(spark, sf).select("event_id", F.round(fn.temperature_scaled("p", 2.0)[0], 6).alias("p_neg"))


@plans.add("f37_mixture", f"SELECT event_id, round(0.75 * p + 0.25 * 0.2, 6) AS p_neg, round(0.75 * (p + r) + 0.25 * 0.6 - pow(0.75 * (r - p) + 0.25 * 0.2, 2), 6) AS variance FROM ({SOFTMAX})")
def _(spark, sf):
    mean, variance = fn.mixture(F.array("p", F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))), F.array(F.lit(3.0), F.lit(1.0)))
    return _softmax(spark, sf).select("event_id", F.round(mean[0], 6).alias("p_neg"), F.round(variance, 6).alias("variance"))


@plans.add("f38_ordinal_heads", f"""SELECT event_id, round(1 - s, 6) AS coral_neg, round(least(s, t), 6) AS coral_pos, round(s * t, 6) AS corn_pos, round(s * (1 - t), 6) AS two_neg FROM (SELECT event_id, 1 / (1 + exp(-a)) AS s, 1 / (1 + exp(-b)) AS t FROM ({LOGITS}))""")
def _(spark, sf):
    z = F.col("z")
    return _logits(spark, sf).select("event_id", F.round(fn.coral_probabilities("z")[0], 6).alias("coral_neg"), F.round(fn.coral_probabilities("z")[2], 6).alias("coral_pos"),
                                     F.round(fn.corn_probabilities("z")[2], 6).alias("corn_pos"), F.round(fn.two_stage_probabilities(z[0], z[1])[0], 6).alias("two_neg"))


@plans.add("f39_argmax", f"SELECT event_id, CASE WHEN a >= b AND a >= c THEN -1 WHEN b >= c THEN 0 ELSE 1 END AS c FROM ({LOGITS})")
def _(spark, sf):
    return _logits(spark, sf).select("event_id", fn.argmax_class("z").alias("c"))


@plans.add("f40_class_weights", """WITH c AS (SELECT dimension, count(*) FILTER (WHERE score = -1) AS a, count(*) FILTER (WHERE score = 0) AS z, count(*) FILTER (WHERE score = 1) AS b FROM label GROUP BY 1), m AS (SELECT *, pow(greatest(a, 1), -0.25) AS x, pow(greatest(z, 1), -0.25) AS y, pow(greatest(b, 1), -0.25) AS w FROM c)
SELECT dimension, round(0.5 * x / greatest(x, y, w), 6) AS margin_neg, round(0.5 * y / greatest(x, y, w), 6) AS margin_zero FROM m""", views=True)
def _(spark, sf):
    n = lambda v: F.count_if(F.col("score") == v)
    c = adapter.label(spark, sf).groupBy("dimension").agg(F.array(n(-1), n(0), n(1)).alias("c"))
    return c.select("dimension", F.round(fn.ldam_margins("c")[0], 6).alias("margin_neg"), F.round(fn.ldam_margins("c")[1], 6).alias("margin_zero"))


@plans.add("f41_truncated_embedding", """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY 1),
n AS (SELECT u.vec_id, i, (x - m) / sqrt(v + 1e-5) AS x FROM u JOIN s USING (vec_id) WHERE i <= 16), l AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM n GROUP BY 1) SELECT vec_id, i - 1 AS dim_index, round(x / greatest(norm, 1e-8), 6) AS x FROM n JOIN l USING (vec_id)""")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(fn.truncated_embedding("embedding", 16)).alias("dim_index", "x")).withColumn("x", F.round("x", 6))


@plans.add("f42_pooled_history", """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), h AS (SELECT vec_id, i, avg(x) OVER w AS m, count(*) OVER w AS n FROM u WHERE i <= 8 WINDOW w AS (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
l AS (SELECT vec_id, sqrt(sum(m * m)) AS norm FROM h GROUP BY 1) SELECT h.vec_id, i - 1 AS dim_index, round(coalesce(m, 0) / greatest(coalesce(norm, 0), 1e-8), 6) AS x, round(n / 3, 6) AS share FROM h JOIN l ON l.vec_id = h.vec_id""")
def _(spark, sf):
    long = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 8)).alias("dim_index", "x"))
    w = Window.partitionBy("label", "dim_index").orderBy("vec_id").rowsBetween(-3, -1)
    h = long.select("vec_id", "dim_index", F.coalesce(F.avg(F.col("x").cast("double")).over(w), F.lit(0.0)).alias("m"), F.round(F.count("x").over(w) / 3, 6).alias("share"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("vec_id")))
    return h.select("vec_id", "dim_index", F.round(F.col("m") / F.greatest(norm, F.lit(1e-8)), 6).alias("x"), "share")


@plans.add("f43_state_vector", "SELECT event_id, 4 AS n, round(value / 100 + k + t_index + 0.5, 6) AS total FROM entry", views=True)
def _(spark, sf):
    state = F.concat(F.array(F.col("value") / 100), F.array(F.col("k").cast("double"), F.col("t_index").cast("double")), F.array(F.lit(0.5)))
    return adapter.entry(spark, sf).select("event_id", F.size(state).alias("n"), F.round(F.aggregate(state, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@plans.add("f44_vote_entropy", """WITH t AS (SELECT event_id, dimension, score, count(*) / 5.0 AS p FROM vote GROUP BY ALL) SELECT event_id, dimension, round(abs(-sum(p * log2(p))), 6) AS entropy FROM t GROUP BY ALL""", views=True)
def _(spark, sf):
    from pathwise.operators import votes as vot

    return vot.vote_distribution(adapter.vote(spark, sf), ["event_id", "dimension"]).select("event_id", "dimension", F.round(F.abs("entropy"), 6).alias("entropy"))


@plans.add("f45_kappa_bands", "SELECT event_id, CASE WHEN v < 0 THEN 'Poor' WHEN v < 0.21 THEN 'Slight' WHEN v < 0.41 THEN 'Fair' WHEN v < 0.61 THEN 'Moderate' WHEN v < 0.81 THEN 'Substantial' ELSE 'Almost Perfect' END AS band FROM (SELECT event_id, CAST(event_id % 120 - 15 AS DOUBLE) / 100 AS v FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.kappa_band((F.col("event_id") % 120 - 15).cast("double") / 100).alias("band"))


@plans.add("f46_delta_verdict", "SELECT event_id, CASE WHEN a > 0 THEN 'improved' WHEN b < 0 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM (SELECT event_id, event_id % 5 - 3 AS a, event_id % 5 - 1 AS b FROM events)")
def _(spark, sf):
    e = F.col("event_id") % 5
    return table(spark, sf, "events").select("event_id", fn.delta_verdict(e - 3, e - 1).alias("verdict"))


@plans.add("f47_round_half_up", "SELECT event_id, floor((event_id % 40 - 20) / 8 * 100 + 0.5 + 1e-9) / 100 AS v FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.round_half_up((F.col("event_id") % 40 - 20) / 8, 2).alias("v"))


@plans.add("f48_json_edit", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(event_id % 3 AS VARCHAR) AS added FROM events")
def _(spark, sf):
    put = fn.json_put("props", "z", F.col("event_id") % 3)
    return table(spark, sf, "events").select("event_id", fn.json_get(put, "k").alias("k"), fn.json_get(put, "z").alias("added"))


@plans.add("f49_entry_id", "SELECT CAST(persona_id AS VARCHAR) AS persona, t_index FROM entry", views=True)
def _(spark, sf):
    ids = adapter.entry(spark, sf).select(F.concat_ws("__", F.col("persona_id").cast("string"), F.col("t_index").cast("string")).alias("id"))
    persona, t = fn.entry_id_parts("id")
    return ids.select(persona.alias("persona"), t.alias("t_index"))


@plans.add("f50_reachability", """SELECT event_id, CASE WHEN a = c THEN 'matches_full_context' WHEN a = b THEN 'changes_with_bio_or_history' WHEN b = c THEN 'changes_between_active_state_and_legacy_profile_prompt' ELSE 'unresolved_context_sensitivity' END AS bucket FROM (SELECT event_id, event_id % 3 AS a, event_id % 4 AS b, event_id % 5 AS c FROM events)""")
def _(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", fn.reachability_bucket(e % 3, e % 4, e % 5).alias("bucket"))


@plans.add("f51_lower_confidence", "SELECT event_id, ['low', 'medium', 'high'][1 + least(event_id % 3, event_id % 4 % 3)] AS c FROM events")
def _(spark, sf):
    level = lambda x: F.when(x == 0, "low").when(x == 1, "medium").otherwise("high")
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", fn.lower_confidence(level(e % 3), level(e % 4 % 3)).alias("c"))


@plans.add("f52_state_change", """WITH s AS (SELECT event_id, ['active_drift', 'no_active_drift', 'insufficient_evidence'][1 + event_id % 3] AS b, ['active_drift', 'no_active_drift', 'insufficient_evidence'][1 + event_id // 3 % 3] AS n, event_id % 31 = 0 AS r FROM events)
SELECT event_id, CASE WHEN r THEN 'active_drift_restarted' WHEN n = 'active_drift' AND b <> n THEN 'active_drift_started' WHEN b = 'active_drift' AND n = 'no_active_drift' THEN 'active_drift_ended' WHEN n = 'insufficient_evidence' AND b <> n THEN 'evidence_became_insufficient' WHEN b = 'insufficient_evidence' AND n <> b THEN 'evidence_resolved' ELSE 'unchanged' END AS change FROM s""")
def _(spark, sf):
    name = lambda x: F.element_at(F.array(F.lit("active_drift"), F.lit("no_active_drift"), F.lit("insufficient_evidence")), (x % 3 + 1).cast("int"))
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", fn.state_change(name(e), name(F.floor(e / 3)), e % 31 == 0).alias("change"))


@plans.add("f53_file_name", "SELECT c_custkey, lower(regexp_replace(trim(c_name), '[^A-Za-z0-9_-]+', '_', 'g')) AS name FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.safe_file_name("c_name").alias("name"))


@plans.add("f54_canonical_mode", "SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'eco') THEN 'economy' WHEN starts_with(lower(p_type), 'pro') THEN 'promo' ELSE 'other' END AS mode FROM part")
def _(spark, sf):
    t = F.lower("p_type")
    return table(spark, sf, "part").select("p_partkey", F.when(F.startswith(t, F.lit("eco")), "economy").when(F.startswith(t, F.lit("pro")), "promo").otherwise("other").alias("mode"))


@plans.add("f58_sorted_item", "SELECT o_custkey, list_sort(list(o_orderpriority))[1] AS first_priority FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("first_priority"))  # the first of the sorted list


@plans.add("f59_strip_prefix", "SELECT o_orderkey, regexp_replace(o_orderpriority, '^\\d-', '') AS name FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.regexp_replace("o_orderpriority", r"^\d-", "").alias("name"))


@plans.add("f60_blank", "SELECT doc_id, regexp_full_match(text, '[ \\t\\n\\x0B\\f\\r]*') AS blank FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", (F.length(F.regexp_replace("text", r"\s", "")) == 0).alias("blank"))


@plans.add("f61_reducers", "SELECT bool_and(score IS NOT NULL) AS every, bool_or(score = 1) AS some, CAST(sum(score) AS BIGINT) AS total, min(score) AS low, max(score) AS high, count(*) FILTER (WHERE score IS NULL) AS n_null FROM label", views=True)
def _(spark, sf):
    s = F.col("score")
    return adapter.label(spark, sf).agg(F.bool_and(s.isNotNull()).alias("every"), F.bool_or(s == 1).alias("some"), F.sum(s).alias("total"), F.min(s).alias("low"), F.max(s).alias("high"), F.count_if(s.isNull()).alias("n_null"))
