"""Column expressions on text, dates, weights and probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathwise.schema import DIMS

#: Upper bounds (exclusive) of kappa's bands.
KAPPA_BANDS = ((0.0, "Poor"), (0.21, "Slight"), (0.41, "Fair"), (0.61, "Moderate"), (0.81, "Substantial"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, use) -> Column:
    """`use` of x, evaluated once: a lambda's free expression is else computed for every element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# Names and text


def normalized_name(x) -> Column:
    """Trimmed and lower, with '-' and ' ' as '_'."""
    return F.translate(F.lower(F.trim(_c(x))), "- ", "__")


def display_name(x) -> Column:
    return F.initcap(F.translate(_c(x), "_", " "))


def words(x) -> Column:
    """Runs between white space; an empty array for blank text."""
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def word_count(x) -> Column:
    return F.size(words(x))


def excerpt(x, most: int = 40) -> Column:
    """The first `most` words, with '...' only if there are more."""
    w = words(x)
    return F.concat(F.concat_ws(" ", F.slice(w, 1, most)), F.when(F.size(w) > most, "...").otherwise(""))


def char_excerpt(x, most: int) -> Column:
    """White space squeezed; beyond `most` characters cut, trimmed at the end and marked."""
    flat = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("...")))


def _filled(x) -> Column:
    return F.length(F.trim(F.coalesce(_c(x), F.lit("")))) > 0


def entry_text(entry, nudge, response) -> Column:
    """Parts joined by an empty line, blank ones left out; the nudge quoted."""
    return F.concat_ws("\n\n", F.when(_filled(entry), _c(entry)), F.when(_filled(nudge), F.concat(F.lit('Nudge: "'), _c(nudge), F.lit('"'))), F.when(_filled(response), F.concat(F.lit("Response: "), _c(response))))


def session_text(entry, nudge, response) -> Column:
    """The same with every part trimmed and its marker in bold."""
    return F.concat_ws("\n\n", F.when(_filled(entry), F.trim(_c(entry))), F.when(_filled(nudge), F.concat(F.lit('**Nudge:** "'), F.trim(_c(nudge)), F.lit('"'))), F.when(_filled(response), F.concat(F.lit("**Response:** "), F.trim(_c(response)))))


def tokens(x) -> Column:
    """Lower-case runs of a-z, 0-9 and the apostrophe."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9']+"), F.lit(0))


def token_text(x) -> Column:
    return F.concat_ws(" ", tokens(x))


def token_overlap(a, b) -> Column:
    """Size of the multiset intersection over the larger size; null for two empty texts. For short texts (journal entries)."""
    x, y = tokens(a), tokens(b)

    def numbered(arr: Column) -> Column:
        """Sorted tokens with the occurrence number of each: position less that of its first, so that a set intersection counts."""
        return let(F.array_sort(arr), lambda ordered: F.transform(ordered, lambda t, i: F.concat(t, F.lit("#"), (i + 1 - F.array_position(ordered, t)).cast("string"))))

    return F.try_divide(F.size(F.array_intersect(numbered(x), numbered(y))).cast("double"), F.greatest(F.size(x), F.size(y)))


def content_words(x, stop) -> Column:
    """Different tokens in the order of their first occurrence, without stop words."""
    return F.array_distinct(F.filter(tokens(x), lambda t: ~t.isin(*stop)))


def banned(x, terms) -> Column:
    """Whether one of the terms stands in the text as whole words, in any case; never for no terms."""
    kept = [t for t in terms if t.strip()]
    if not kept:
        return F.lit(False)
    quoted = "|".join("\\Q" + t + "\\E" for t in kept)
    return _c(x).rlike(rf"(?i)\b({quoted})\b")


def leaked_labels(x, labels) -> Column:
    """Those of `labels` that stand in the text as whole words, in any case."""
    found = [F.when(F.lower(_c(x)).rlike(rf"\b\Q{n.lower()}\E\b"), F.lit(n)) for n in labels]
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def quoted_phrases(x) -> Column:
    """Trimmed contents of straight double quotes, blank ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(_c(x), F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.trim(q)), lambda q: q != "")


def contains_any(x, patterns) -> Column:
    return reduce(lambda a, p: a | F.contains(F.lower(_c(x)), F.lit(p)), patterns, F.lit(False))


def narrative_checks(text, evidence, labels, scoring_terms, transition: str, end_claim: str, supports_end, least: int = 25, most: int = 180) -> dict[str, Column]:
    """Five booleans on a generated text: quotes from the evidence (an array), no scoring terms, no labels, no unsupported claims, length."""
    grounded = F.exists(quoted_phrases(text), lambda q: F.exists(_c(evidence), lambda e: F.contains(F.lower(e), F.lower(q))))
    claims = ~_c(text).rlike(f"(?i){transition}") & (~_c(text).rlike(f"(?i){end_claim}") | _c(supports_end))
    return {"groundedness": grounded, "non_circularity": ~contains_any(text, scoring_terms), "value_leakage": F.size(leaked_labels(text, labels)) == 0,
            "state_claims": claims, "length": word_count(text).between(least, most)}


def placeholder(x, pattern: str) -> Column:
    """Whether the whole text, without a pair of backticks around it, matches `pattern`."""
    trimmed = F.trim(_c(x))
    bare = F.when(trimmed.rlike("(?s)^`.*`$"), F.trim(F.regexp_replace(trimmed, "^`|`$", ""))).otherwise(trimmed)
    return bare.rlike(f"^(?:{pattern})$")


def without_phrase(x, phrase: str) -> Column:
    """The text without a phrase (whole words, any case), with spaces and punctuation closed up."""
    gone = F.regexp_replace(_c(x), rf"(?i)\b\Q{phrase}\E\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(gone, r"\s+", " "), r" ([.,;:!?])", "$1"))


def valid_quote(text, verdict, quote, reason, confidence) -> Column:
    """A quote must be part of the text; a conflict needs a quote, a reason and more than low confidence."""
    exact = (F.coalesce(_c(quote), F.lit("")) == "") | F.contains(_c(text), _c(quote))
    full = (_c(verdict) != "conflict") | (_filled(quote) & _filled(reason) & (_c(confidence) != "low"))
    return exact & full


def canonical_hash(*columns: str) -> Column:
    """Hex SHA-256 of the columns as JSON, keys in order of name, nulls written."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def approx_tokens(x) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(_c(x)) / 4))


def safe_file_name(x) -> Column:
    return F.lower(F.regexp_replace(F.trim(_c(x)), "[^A-Za-z0-9_-]+", "_"))


def entry_id_parts(x) -> tuple[Column, Column]:
    """persona and t_index of '<persona>__<t>'."""
    return F.regexp_extract(_c(x), r"^(.*)__(\d+)$", 1), F.regexp_extract(_c(x), r"^(.*)__(\d+)$", 2).try_cast("long")


# JSON held in a string


def json_get(x, key: str) -> Column:
    return F.element_at(F.from_json(_c(x), "map<string,string>"), key)


def json_put(x, key: str, value) -> Column:
    """The object with one key set (or, for a null value, dropped)."""
    rest = F.map_filter(F.coalesce(F.from_json(_c(x), "map<string,string>"), F.expr("cast(map() as map<string,string>)")), lambda k, v: k != key)
    return F.to_json(F.when(_c(value).isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), _c(value).cast("string")))))


# Dates


def week_start(x) -> Column:
    return F.date_trunc("week", _c(x)).cast("date")


def week_end(x) -> Column:
    return F.date_add(week_start(x), 6)


# Weights, classes, probabilities


def profile_weights(values, uniform: bool = True) -> Column:
    """Ten weights: 1/n on each declared value; without a known one 1/10 each, or zeros where not `uniform`."""
    known = F.array_distinct(F.filter(F.transform(_c(values), normalized_name), lambda v: v.isin(*DIMS)))
    none = F.array_repeat(F.lit(0.1 if uniform else 0.0), 10)
    return F.when(F.size(known) > 0, F.transform(F.array(*(F.lit(d) for d in DIMS)), lambda d: F.when(F.array_contains(known, d), F.lit(1.0) / F.size(known)).otherwise(0.0))).otherwise(none)


def expected_alignment(weight, floor: float = 0.15) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(weight) - floor) / (1 - floor)))


def discretized(x, at: float = 0.5) -> Column:
    """-1 below -at, 1 above at, else 0; null stays null."""
    return F.when(_c(x) < -at, -1).when(_c(x) > at, 1).when(_c(x).isNotNull(), 0)


def expected_score(p) -> Column:
    return F.get(_c(p), F.lit(2)) - F.get(_c(p), F.lit(0))


def normalized(values) -> Column:
    return let(values, lambda v: let(total(v), lambda t: F.transform(v, lambda x: F.try_divide(x, t))))


def shifted_softmax(logits, priors=None, tau: float = 0.0) -> Column:
    """Softmax of logits - tau * ln(prior), the largest taken off first."""
    z = _c(logits) if not tau else F.zip_with(_c(logits), _c(priors), lambda x, p: x - tau * F.ln(p))
    return normalized(let(z, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))))


def temperature_scaled(p, t: float) -> Column:
    return normalized(F.transform(_c(p), lambda x: F.pow(x, F.lit(1.0 / t))))


def margin_class(p, minus, plus) -> Column:
    """-1 if its probability is within `minus` of zero's and no less than +1's; else +1 likewise; else 0."""
    a, z, b = (F.get(_c(p), F.lit(k)) for k in range(3))
    return F.when((a >= z - _c(minus)) & (a >= b), -1).when((b > a) & (b >= z - _c(plus)), 1).otherwise(0)


def argmax_class(p) -> Column:
    """Position of the first largest of three, less 1."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 2).cast("int")


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def coral_probabilities(logits) -> Column:
    """Three class probabilities of two cumulative logits, the second no larger than the first."""
    a = sigmoid(F.get(_c(logits), F.lit(0)))
    b = F.least(a, sigmoid(F.get(_c(logits), F.lit(1))))
    return F.array(1 - a, a - b, b)


def corn_probabilities(logits) -> Column:
    """The same of conditional logits: P(>1) = P(>0) P(>1 | >0)."""
    a = sigmoid(F.get(_c(logits), F.lit(0)))
    b = a * sigmoid(F.get(_c(logits), F.lit(1)))
    return F.array(1 - a, a - b, b)


def two_stage_probabilities(active, positive) -> Column:
    """Of an activity logit and a polarity logit."""
    a, p = sigmoid(active), sigmoid(positive)
    return F.array(a * (1 - p), 1 - a, a * p)


def mixture(ps, weights) -> tuple[Column, Column]:
    """Mean distribution of weighted distributions, and the variance of its score -1, 0, 1 within and between them."""
    w = normalized(_c(weights))
    part = lambda k: total(F.zip_with(_c(ps), w, lambda p, x: F.get(p, F.lit(k)) * x))
    mean = F.array(part(0), part(1), part(2))
    return mean, let(mean, lambda m: m[0] + m[2] - (m[2] - m[0]) * (m[2] - m[0]))


def ldam_margins(counts, most: float = 0.5) -> Column:
    """most * n^(-1/4), scaled so that the rarest class has `most`."""
    raw = F.transform(_c(counts), lambda n: F.pow(F.greatest(n.cast("double"), F.lit(1.0)), F.lit(-0.25)))
    return let(raw, lambda r: let(F.array_max(r), lambda top: F.transform(r, lambda m: m * most / top)))


def effective_weights(counts, beta: float = 0.99) -> Column:
    """(1 - beta) / (1 - beta^n), scaled to mean 1."""
    raw = F.transform(_c(counts), lambda n: (1 - beta) / (1 - F.pow(F.lit(beta), F.greatest(n, F.lit(1)))))
    return let(raw, lambda r: let(F.size(r) / total(r), lambda scale: F.transform(r, lambda x: x * scale)))


def entropy_bits(p) -> Column:
    return -F.aggregate(F.filter(_c(p), lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log2(x))


def kappa_band(x) -> Column:
    return reduce(lambda acc, b: acc.when(_c(x) < b[0], b[1]), KAPPA_BANDS[1:], F.when(_c(x).isNull(), None).when(_c(x) < KAPPA_BANDS[0][0], KAPPA_BANDS[0][1])).otherwise("Almost Perfect")


def delta_verdict(low, high) -> Column:
    return F.when(_c(low) > 0, "improved").when(_c(high) < 0, "worse").when(_c(low).isNull() | _c(high).isNull(), None).otherwise("inconclusive")


def round_half_up(x, digits: int = 0) -> Column:
    """Halves away from zero downwards too: floor(x * 10^d + 0.5 + epsilon) / 10^d."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5 + 1e-9) / scale


def reachability_bucket(active, profile, full) -> Column:
    return F.when(_c(active) == _c(full), "matches_full_context").when(_c(active) == _c(profile), "changes_with_bio_or_history").when(
        _c(profile) == _c(full), "changes_between_active_state_and_legacy_profile_prompt").otherwise("unresolved_context_sensitivity")


def lower_confidence(a, b) -> Column:
    rank = lambda x: F.when(_c(x) == "low", 0).when(_c(x) == "medium", 1).otherwise(2)
    return F.when(rank(a) <= rank(b), _c(a)).otherwise(_c(b))


def state_change(before, now, restarted) -> Column:
    active, none, unsure = (F.lit(s) for s in ("active_drift", "no_active_drift", "insufficient_evidence"))
    b, n = _c(before), _c(now)
    return F.when(_c(restarted), "active_drift_restarted").when((n == active) & (b != active), "active_drift_started").when((b == active) & (n == none), "active_drift_ended").when(
        (n == unsure) & (b != unsure), "evidence_became_insufficient").when((b == unsure) & (n != unsure), "evidence_resolved").otherwise("unchanged")


def response_mode(overall_mean, uncertainty, distress, core_tension, any_strength, any_tension, mixed, strain) -> Column:
    """The fallback chain of weekly modes."""
    m = _c(overall_mean)
    return F.when(_c(uncertainty) >= 0.3, "high_uncertainty").when(_c(distress), "high_uncertainty").when((m < -0.15) & _c(core_tension), "rut").when(
        _c(any_strength) & (_c(any_tension) | _c(mixed)) & m.between(-0.15, 0.2), "mixed_state").when(~_c(any_tension) & _c(any_strength) & _c(strain), "background_strain").otherwise("stable")


# Vectors


def unit(v: Column, floor: float = 1e-8) -> Column:
    return let(v, lambda x: let(F.greatest(F.sqrt(dot(x, x)), F.lit(floor)), lambda norm: F.transform(x, lambda y: y / norm)))


def truncated_embedding(v, size: int) -> Column:
    """Standardized over its length (population variance + 1e-5), cut to `size`, scaled to length one."""
    double = F.transform(_c(v), lambda x: x.cast("double"))
    centred = let(double, lambda d: let(total(d) / F.size(d), lambda mean: F.transform(d, lambda x: x - mean)))
    return unit(let(centred, lambda d: let(F.sqrt(dot(d, d) / F.size(d) + 1e-5), lambda sd: F.transform(F.slice(d, 1, size), lambda x: x / sd))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
