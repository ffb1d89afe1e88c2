"""Exact removal of long byte strings that occur more than once in a corpus, by suffix arrays over what can repeat.

A string of `length` bytes is anchored at one of its `gram`-byte pieces, the one with the least hash (the first of
equals). The same string has the same anchor wherever it stands, so strings with different anchors differ, and each
document falls into contexts: runs of start positions with one anchor, with the bytes that their strings cover. Only
contexts whose anchor repeats go on, and in two ways, both to suffix arrays:

* Contexts that recur whole by their hash: the first and the last place of each, in chains of contexts that follow each
  other at both places, so that a repeated document or passage is laid out twice, and not once for each of its copies.
* The different contexts under one anchor, laid out together. An anchor with more than `HOT` of them is never gathered:
  they are cut again by anchors of a longer gram, at the last level of the whole string.

The suffixes of what is laid out are ordered by two-stage sorting (`two_stage`), and a start whose suffix shares `length`
bytes or more with a neighbour in that order repeats. Nothing else decides it.

Work and shuffles are linear in the text: about one context in 170 bytes, and only those whose anchor repeats go on.

Defined cases: a null text is empty; a text shorter than `length` bytes loses nothing; repeated rows are repeats of each
other; texts of any length are read whole, in pieces that overlap by length - 1 bytes; an empty table gives an empty
result; a null doc_id is as good as any; other columns of any name are carried by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import discard, slices, table, text_of, written
from pathwise.llm.two_stage import Strings, common_prefixes, suffix_array

LENGTH = 400
#: Different contexts under one anchor that a task may gather.
HOT = 192
#: Bytes handled at a time, bytes under one suffix array, and starts of a chain.
PIECE, TOGETHER, CHAIN = 1 << 19, 1 << 20, 1 << 14

_rng = np.random.default_rng(400)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
POSITION = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of STEP and of its inverse modulo 2^64, as far as a buffer has needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            ones = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([ones, np.full(n, STEP)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([ones, np.full(n, BACK)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def contexts(pieces: list[bytes], gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor (hash), context (hash), piece, first start in the piece and number of starts of every context."""
    lengths = np.array([len(x) for x in pieces], np.int64)
    raw = b"".join(pieces)
    n, window = len(raw), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    up, down = _Powers.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[np.frombuffer(raw, np.uint8)] * up, dtype=np.uint64, out=sums[1:])
    hashed = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    m = len(hashed)
    if window == 1:
        at = np.arange(m)
    else:  # the least of each window, from the least before and after in blocks of a window's size
        keys = np.full(-(-m // window) * window, ~np.uint64(0))
        keys[:m] = (hashed & ~POSITION) | np.arange(m, dtype=np.uint64)
        keys = keys.reshape(-1, window)
        ahead = np.minimum.accumulate(keys, 1).ravel()
        behind = np.minimum.accumulate(keys[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(behind[: m - window + 1], ahead[window - 1 : m]) & POSITION).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= ends)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    of = at[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (np.diff(starts) != 1)]))
    first, many = starts[fresh], np.diff(np.append(fresh, len(starts)))
    digest = xxhash.xxh3_64_intdigest
    named = np.array([digest(raw[a : a + c + length - 1]) for a, c in zip(first.tolist(), many.tolist(), strict=True)], np.uint64)
    piece = np.searchsorted(np.cumsum(lengths), first, "right")
    return hashed[of[fresh]].view(np.int64), named.view(np.int64), piece, first - (np.cumsum(lengths) - lengths)[piece], many


def _occurrences(segments: DataFrame, gram: int, length: int) -> DataFrame:
    """a, c, id, hash, lo and n: the contexts of all segments (id, hash, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes, bodies = (batch[x].to_pylist() for x in ("id", "hash", "body"))
            held, owners, size = [], [], 0

            def result() -> pa.RecordBatch:
                a, c, piece, lo, n = contexts(held, gram, length)
                row = np.array([k for k, _ in owners], np.int64)[piece] if len(piece) else piece
                shift = np.array([x for _, x in owners], np.int64)[piece] if len(piece) else piece
                columns = [a, c, np.array(ids, np.int64)[row], np.array(hashes, np.int64)[row], lo + shift, n]
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "c", "id", "hash", "lo", "n"])

            for k, body in enumerate(bodies):
                for at in range(0, max(1, len(body) - length + 1), PIECE):
                    held.append(body[at : at + PIECE + length - 1])
                    owners.append((k, at))
                    size += len(held[-1])
                    if size >= PIECE:
                        yield result()
                        held, owners, size = [], [], 0
            if held:
                yield result()

    return segments.select("id", "hash", "body").mapInArrow(run, "a long, c long, id long, hash long, lo long, n long")


def _compared(rows: list[dict], length: int) -> list[tuple[int, int, int, int]]:
    """(anchor, context, first start, number) of the runs of repeated starts in the rows' members: contexts (off, n, a, c)
    by their place in the row's body."""
    strings = Strings([x["body"] for x in rows])
    order = suffix_array(strings)
    shared = common_prefixes(strings, order) >= length
    repeated = np.zeros(len(strings.data), bool)
    repeated[order[shared]] = True
    repeated[order[np.flatnonzero(shared) - 1]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    runs: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in edges.reshape(-1, 2).tolist():
        k = int(np.searchsorted(strings.begins, lo, "right")) - 1
        runs.setdefault(k, []).append((lo - int(strings.begins[k]), hi - int(strings.begins[k])))
    out = []
    for k, found in runs.items():
        members = sorted(rows[k]["members"], key=lambda x: x["off"])
        at = 0
        for x in members:
            lo, hi = x["off"], x["off"] + x["n"]
            while at < len(found) and found[at][1] <= lo:
                at += 1
            for a, b in found[at:]:
                if a >= hi:
                    break
                out.append((x["a"], x["c"], max(a, lo) - lo, min(b, hi) - max(a, lo)))
    return out


def _sorted_out(bodies: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts (a, c, at, n) in the members of bodies (g, o, members, body): bodies of one g are under one
    suffix array, and those with one g and o are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, last = 0, {}

        def result() -> pa.RecordBatch:
            rows = _compared(held, length)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["a", "c", "at", "n"])

        for batch in slices(batches):
            for row in batch.to_pylist():
                if last and all(row[x] == last[x] for x in ("g", "o", "body")):
                    continue
                if size >= TOGETHER and row["g"] != last["g"]:
                    yield result()
                    held.clear()
                    size = 0
                held.append(row)
                size, last = size + len(row["body"]), row
        if held:
            yield result()

    return bodies.select("g", "o", "members", "body").repartition("g").sortWithinPartitions("g", "o").mapInArrow(run, "a long, c long, at long, n long")


MEMBERS = "array<struct<off:bigint,n:bigint,a:bigint,c:bigint>>"


def _bodies(wanted: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """g, o, hot, k, members and body of the wanted runs of starts (id, hash, lo, n), cut from their segments."""
    lists = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("g", "o", "hot", "k", "lo", "n", "members")).alias("cuts"))
    kept = {"g": pa.int64(), "o": pa.int64(), "hot": pa.bool_(), "k": pa.int64(), "members": pa.list_(pa.struct([(x, pa.int64()) for x in ("off", "n", "a", "c")]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            for body, cuts in zip(batch["body"].to_pylist(), batch["cuts"].to_pylist(), strict=True):
                for k in range(0, len(cuts), 2000):
                    part = cuts[k : k + 2000]
                    columns = [pa.array([x[name] for x in part], kind) for name, kind in kept.items()]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([body[x["lo"] : x["lo"] + x["n"] + length - 1] for x in part], pa.binary())], [*kept, "body"])

    return segments.join(lists, ["id", "hash"]).select("body", "cuts").mapInArrow(run, f"g long, o long, hot boolean, k long, members {MEMBERS}, body binary")


def _chains(counted: DataFrame) -> DataFrame:
    """The first and the last place of contexts that recur whole, as wanted runs; contexts that follow each other at both
    places are one run."""
    place = Window.partitionBy("first.id", "first.hash").orderBy("first.lo")
    ahead = lambda x: F.lag(x).over(place)
    follows = (F.col("first.lo") == ahead(F.col("first.lo") + F.col("n"))) & (F.col("last.lo") == ahead(F.col("last.lo") + F.col("n"))) & (F.struct("last.id", "last.hash") == ahead(F.struct("last.id", "last.hash")))
    one = follows & (F.floor(F.col("first.lo") / CHAIN) == ahead(F.floor(F.col("first.lo") / CHAIN)))
    runs = counted.filter("k > 1").withColumn("_fresh", (~F.coalesce(one, F.lit(False))).cast("int")).withColumn("run", F.sum("_fresh").over(place))
    chains = runs.groupBy("first.id", "first.hash", "run").agg(
        F.min("first").alias("first"), F.min_by("last", "first.lo").alias("last"), F.sum("n").alias("n"), F.collect_list(F.struct("first.lo", "n", "a", "c")).alias("all"))
    chains = chains.select("first", "last", "n", F.xxhash64("first", F.lit(1)).alias("g"), F.transform("all", lambda x: F.struct((x["lo"] - F.col("first.lo")).alias("off"), x["n"].alias("n"), x["a"].alias("a"), x["c"].alias("c"))).alias("members"))
    laid = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(0).alias("o"), "members"), F.struct(F.col("last").alias("at"), F.lit(1).alias("o"), F.array().cast(MEMBERS).alias("members"))))
    return chains.select("g", "n", laid.alias("x")).select("g", F.col("x.o").cast("long").alias("o"), F.lit(False).alias("hot"), F.lit(2).cast("long").alias("k"), "x.at.id", "x.at.hash", "x.at.lo", "n", "x.members")


def repeats(segments: DataFrame, length: int = LENGTH, level: int = 0) -> DataFrame:
    """id, hash, lo and n: runs of starts whose `length` bytes also start elsewhere, for segments (id, hash, body)."""
    grams = 64, length - 32, length  # of the anchors at each level; at the last one the whole string
    every = written(_occurrences(segments, grams[level], length), "contexts")
    # A table of its own, so that Spark can split the join where an anchor has very many contexts.
    often = written(every.groupBy("a").agg(F.count("*").alias("total")).filter("total > 1").select("a"), "anchors")
    again = written(every.join(often, "a"), "contexts-again")
    discard(every, often)
    place = F.struct("id", "hash", "lo")
    counted = written(again.groupBy("a", "c").agg(F.count("*").alias("k"), F.min("n").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "contexts-counted")
    several = written(counted.groupBy("a").agg(F.count("*").alias("d")).filter("d > 1"), "anchors-several")
    own = F.array(F.struct(F.lit(0).cast("long").alias("off"), "n", "a", "c"))
    hot = (F.col("d") > HOT) & F.lit(level < len(grams) - 1)
    # Contexts that recur whole stand among their anchor's others, but are decided in their chains.
    members = F.when((F.col("k") == 1) | hot, own).otherwise(F.array().cast(MEMBERS))
    others = counted.join(several, "a").select(F.xxhash64("a").alias("g"), F.col("c").alias("o"), hot.alias("hot"), "k", "first.*", "n", members.alias("members"))
    bodies = written(_bodies(_chains(counted).unionByName(others), segments, length), "bodies")
    found = _sorted_out(bodies.filter("not hot"), length)
    if level < len(grams) - 1:
        hot = bodies.filter("hot").select(F.col("members")[0]["a"].alias("a"), F.col("members")[0]["c"].alias("hash"), "k", "body").dropDuplicates(["a", "hash"]).withColumn("id", F.xxhash64("a", "hash"))
        if not hot.isEmpty():
            inner = repeats(hot, length, level + 1).join(hot.filter("k = 1").select("id", "hash", "a"), ["id", "hash"])
            found = found.union(inner.select("a", F.col("hash").alias("c"), F.col("lo").alias("at"), "n"))
    verdicts = written(found, "repeated").withColumnsRenamed({"n": "many"})
    discard(counted, several, bodies)
    return again.join(verdicts, ["a", "c"]).select("id", "hash", (F.col("lo") + F.col("at")).alias("lo"), F.col("many").alias("n"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "hash": F.xxhash64(text_of()), "body": F.encode(text_of(), "utf-8")})


def spans(cuts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte spans from runs of starts."""
    out: list[tuple[int, int]] = []
    for lo, n in sorted((x["lo"], x["n"]) for x in cuts or ()):
        end = lo + n + length - 1
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((lo, end))
    return out


def _kept(body: bytes, covered: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in covered:
        parts.append(body[at:lo])
        at = hi
    return b"".join([*parts, body[at:]])


def _with_cuts(docs: DataFrame, length: int) -> DataFrame:
    """`docs` (with id, hash, body) and cuts, the runs of repeated starts of each row."""
    cuts = repeats(docs.select("id", "hash", "body"), length).groupBy("id", "hash").agg(F.collect_set(F.struct("lo", "n")).alias("cuts"))
    return docs.join(cuts, ["id", "hash"], "left")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left, less characters that a span cuts through) and
    spans (begin, end) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for body, cuts in zip(batch["body"].to_pylist(), batch["cuts"].to_pylist(), strict=True):
                covered = spans(cuts, length)
                kept = _kept(body, covered)
                rows.append((len(body), sum(b - a for a, b in covered), len(covered), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), [{"begin": a, "end": b} for a, b in covered]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], names)

    cut = _with_cuts(_keyed(docs.select("doc_id", "text")).drop("text"), length)
    return cut.select("doc_id", "body", "cuts").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans array<struct<begin:bigint,end:bigint>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of `docs`, all columns, with text less its repeated spans (and characters that a span cuts through).
    Rows that lose nothing are as they were, null texts included."""

    @F.pandas_udf("string")
    def without(body, cuts):
        return body.combine(cuts, lambda b, c: _kept(b, spans(list(c), length)).decode("utf-8", "ignore"))

    packed = _keyed(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")).select("_row", "id", "hash", "body")
    cut = _with_cuts(packed, length)
    text = F.when(F.col("cuts").isNotNull(), without("body", F.coalesce("cuts", F.array().cast("array<struct<lo:bigint,n:bigint>>")))).otherwise(F.col("_row.text"))
    return cut.withColumn("_text", text).select(*(F.col("_text").alias("text") if x == "text" else F.col("_row")[x].alias(x) for x in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
