"""Near-duplicate documents by n-gram Jaccard similarity: a MinHash LSH forest, then exact verification.

Texts with the same set of five-word shingles (by a 128-bit hash of the set) are one node, named by its first row. A node has a label of `LONGEST`
MinHashes in each of `TREES` trees; in a tree's sorted labels the nodes that share a prefix stand together, and how many
stand under each prefix is counted from whole labels up. Which prefixes are matched is settled in two steps:

1. Every label begins matched in full and is shortened, value by value down to `SHORTEST`, while no more than `WIDE`
   nodes stand under the shorter prefix. Where strangers crowd under a common prefix it stays long.
2. A node's recall is that of a pair at the threshold: 1 - product over trees of (1 - threshold ** matched length). Nodes
   under the `TARGET` are shortened further, in every tree, to `uniform_length()`, at which the target holds by itself;
   so are those that stand under the same prefixes.

Each group of nodes under one matched prefix is verified once, however many trees show the same group. A large group is
cut into blocks of bounded size by a seeded hash and every two blocks meet in one unit of work, so that no pair is lost.
Inside a unit similarities are exact, from the sets of the shingles' 64-bit hashes. A pair counts in the first tree where it meets only. A unit
returns its nodes' numbers of links and a spanning forest of them, not the pairs; classes are connected components.

Defined cases: null, empty and wordless texts have no shingles, link to nothing and are classes of their own; a text of
fewer than five words has one shingle, all its words; repeated rows are copies; an empty table gives an empty result;
other columns of any name are carried by `drop_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import discard, slices, table, text_of, written
from pathwise.llm.components import components

SHINGLE, THRESHOLD, TARGET = 5, 0.8, 0.999
TREES, LONGEST, SHORTEST = 24, 8, 5
#: Nodes under a prefix up to which it is shortened freely.
WIDE = 64
#: Nodes and shingles of a block; a unit of work has two blocks at most.
BLOCK, BLOCK_SHINGLES = 384, 150_000

_rng = np.random.default_rng(20240229)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: What is kept of eight bytes of which the first k belong to a word.
KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
XORS = _rng.integers(1, 1 << 63, TREES * LONGEST, dtype=np.uint64)
ODDS = _rng.integers(1, 1 << 63, TREES * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def weight(length: int, threshold: float = THRESHOLD) -> float:
    """What a tree matched at `length` adds to -log(1 - recall) of a pair at the threshold."""
    return -math.log1p(-(threshold**length))


def uniform_length(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """The longest length that meets the target if every tree is matched at it."""
    length = LONGEST
    while length > SHORTEST and TREES * weight(length, threshold) < -math.log1p(-target):
        length -= 1
    return length


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: mixed from its bytes and length up to 16 bytes, by which words of up to 8 bytes and one
    length never share a hash; xxh3 of longer words."""
    data = np.frombuffer(text, np.uint8)
    word = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    lo, hi = edges[::2], edges[1::2]
    if not len(lo):
        return np.zeros(0, np.uint64)
    at_any = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), 0, (1,))  # the eight bytes from any place on
    size = hi - lo
    out = mix((at_any[lo] & KEPT[np.minimum(size, 8)]) + STEP)
    out = mix((out ^ (at_any[np.minimum(lo + 8, len(text))] & KEPT[np.clip(size - 8, 0, 8)])) * STEP + size.astype(np.uint64))
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(text[lo[k] : hi[k]])
    return out


def shingles(text: str) -> np.ndarray:
    """The sorted different hashes of the text's runs of five words."""
    words = _word_hashes(text.encode())
    if not len(words):
        return words
    if len(words) < SHINGLE:
        words = np.concatenate([words, np.zeros(SHINGLE - len(words), np.uint64)])
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = mix(out * STEP + words[k : n + k])
    return np.unique(out)


def labels(of: np.ndarray) -> np.ndarray:
    """TREES x LONGEST MinHashes of a non-empty set, 16 bits of each."""
    least = np.full(len(XORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(of), 256):
        least = np.minimum(least, ((of[k : k + 256, None] ^ XORS) * ODDS).min(0))
    return (least >> np.uint64(48)).astype(">u2").reshape(TREES, LONGEST)


def _described(texts: pa.Array) -> pa.Array:
    """A 128-bit hash and the size of each text's shingle set and its labels, one tree after another; nulls without words."""
    nodes, words, of = [], [], []
    for k in range(0, len(texts), 256):
        for text in texts[k : k + 256].to_pylist():
            own = shingles(text)
            some = len(own) > 0
            nodes.append(xxhash.xxh3_128_digest(own.tobytes()) if some else None)
            words.append(len(own))
            of.append(labels(own).tobytes() if some else None)
    return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(words, pa.int32()), pa.array(of, pa.binary())], ["node", "words", "labels"])


def _describe(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as _row, with uid (its number), thash (of its text), node, words and labels of its set."""
    described = F.arrow_udf(_described, "struct<node:binary,words:int,labels:binary>")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(text_of()).alias("thash"), F.monotonically_increasing_id().alias("uid"), described(text_of()).alias("d"))
    return written(rows, "forest-rows").select("_row", "uid", "thash", "d.*")


def _nodes(rows: DataFrame) -> DataFrame:
    """node, copies, words, labels, and doc_id, thash and uid of its first row, of every shingle set; uid names it."""
    first = F.min(F.struct(F.col("_row.doc_id").isNull().alias("last"), F.col("_row.doc_id").alias("first_id"), F.col("thash").alias("first_hash"), "uid", "words", "labels"))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), first.alias("f"))
    return written(nodes.select("node", "copies", "f.*").drop("last"), "forest-nodes")


def _cell(tree: Column | str, prefix: Column) -> Column:
    """A number for a prefix in a tree, with the tree in its lowest 5 bits."""
    tree = F.col(tree) if isinstance(tree, str) else tree
    return F.xxhash64(tree, prefix).bitwiseAND(F.lit(~31)).bitwiseOR(tree.cast("long"))


def _prefix(length: int | Column) -> Column:
    return F.substring("label", F.lit(1), F.lit(2 * length) if isinstance(length, int) else length * 2)


def _matched(nodes: DataFrame) -> DataFrame:
    """uid, words, tree, length and cell: where each node's label is matched, for prefixes that two nodes share at least."""
    label = F.substring("labels", F.col("tree") * (2 * LONGEST) + 1, F.lit(2 * LONGEST))
    placed = nodes.select("uid", "words", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    placed = placed.select("uid", "words", "tree", label.alias("label")).withColumn("cell", _cell("tree", _prefix(SHORTEST)))
    shared = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    placed = written(placed.join(shared, "cell"), "forest-placed")
    crowded = placed.filter(F.col("n") > WIDE)

    # Step 1: how many nodes stand under each longer prefix; counts of whole labels make those of shorter ones.
    counts = crowded.groupBy("tree", "label").agg(F.count("*").alias("n8"))
    length = F.lit(LONGEST)
    for k in range(LONGEST - 1, SHORTEST, -1):
        under = counts.groupBy("tree", _prefix(k).alias("_prefix")).agg(F.sum("n8").alias(f"under{k}"))
        counts = counts.withColumn("_prefix", _prefix(k)).join(under, ["tree", "_prefix"]).drop("_prefix")
        length = F.when(F.col(f"under{k}") <= WIDE, k).otherwise(length)
    length = length if LONGEST > SHORTEST else F.lit(SHORTEST)
    stops = counts.select("tree", "label", length.alias("length"))
    deep = stopped = written(crowded.drop("n", "cell").join(stops, ["tree", "label"]), "forest-deep")

    # Step 2: nodes whose recall is under the target.
    uniform = uniform_length()
    lost = sum((F.when(F.col("length") == k, weight(SHORTEST) - weight(k)).otherwise(0.0) for k in range(SHORTEST + 1, LONGEST + 1)), F.lit(0.0))
    short = deep.groupBy("uid").agg(F.sum(lost).alias("lost")).filter(F.col("lost") > TREES * weight(SHORTEST) + math.log1p(-TARGET)).select("uid")
    widened = deep.join(short, "uid").select("tree", _prefix(uniform).alias("_prefix")).distinct().withColumn("_wide", F.lit(uniform))
    deep = deep.withColumn("_prefix", _prefix(uniform)).join(widened, ["tree", "_prefix"], "left")
    deep = deep.select("uid", "words", "tree", "label", F.least("length", F.coalesce("_wide", "length")).alias("length"))
    deep = deep.select("uid", "words", "tree", "length", _cell("tree", F.concat(_prefix(F.col("length")), F.col("length").cast("string").cast("binary"))).alias("cell"))
    near = placed.filter(F.col("n") <= WIDE).select("uid", "words", "tree", F.lit(SHORTEST).alias("length"), "cell")
    matched = written(near.unionByName(deep), "forest-matched")
    discard(placed, stopped)
    return matched


def _groups(matched: DataFrame) -> DataFrame:
    """cell, uid and blocks: the groups of two nodes or more under one prefix, each set of nodes once, in its first tree."""
    stats = matched.groupBy("cell").agg(F.count("*").alias("n"), F.sum("words").alias("shingles"), F.sum(F.xxhash64("uid").cast("decimal(20,0)")).alias("members")).filter("n > 1")
    once = stats.groupBy("n", "members", "shingles").agg(F.min(F.struct(F.expr("cell & 31").alias("tree"), "cell")).alias("at"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return matched.select("cell", "uid").join(once.select(F.col("at.cell").alias("cell"), blocks.alias("blocks")), "cell")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by one product of their 0-1 rows over the shingles that two sets share."""
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = every[counts > 1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 4_000_000 // len(sets))
    for k in range(0, len(shared), step):
        part = shared[k : k + step]
        rows = np.zeros((len(sets), len(part)), np.float32)
        for row, own in zip(rows, sets, strict=True):
            lo, hi = np.searchsorted(own, part[0]), np.searchsorted(own, part[-1], "right")
            at = np.searchsorted(part, own[lo:hi])
            hit = part[at] == own[lo:hi]
            row[at[hit]] = 1
        out += rows @ rows.T
    return out


def _verify(nodes: list[int], sides: list[int], texts: list[str], deep: list, tree: int) -> tuple[list[int], list[int], list[int]]:
    """Nodes with links, their numbers of links found here, and for each the node that it hangs from in the spanning
    forest (itself at a root). sides: 0 and 1 where only pairs across two blocks count, all 0 where all pairs do. deep:
    the trees where a node is matched at another length than SHORTEST, with that length."""
    sets = [shingles(t) for t in texts]
    sizes = np.array([len(x) for x in sets])
    common = _intersections(sets).astype(np.int64)
    linked = common >= THRESHOLD * (sizes[:, None] + sizes - common) - 1e-9
    side = np.array(sides)
    if side.any():
        linked &= side[:, None] != side
    np.fill_diagonal(linked, False)
    if tree and linked.any():  # a pair counts in the first tree where it meets
        a, b = np.nonzero(np.triu(linked))
        used = np.unique(np.concatenate([a, b]))
        own, lengths = np.zeros((len(sets), tree, LONGEST), np.uint16), np.full((len(sets), tree), SHORTEST)
        for k in used.tolist():
            own[k] = labels(sets[k])[:tree]
            for x in deep[k] or ():
                if x["tree"] < tree:
                    lengths[k, x["tree"]] = x["length"]
        met = np.zeros(len(a), bool)
        for j in range(tree):
            same = np.cumprod(own[a, j] == own[b, j], axis=1).sum(1)  # values that their labels share from the front
            met |= (same >= lengths[a, j]) & (lengths[a, j] == lengths[b, j])
        linked[a[met], b[met]] = linked[b[met], a[met]] = False
    degree = linked.sum(1)
    up = np.arange(len(sets))
    seen = degree == 0
    for root in np.flatnonzero(~seen):
        if seen[root]:
            continue
        seen[root], edge = True, [root]
        while edge:
            node = edge.pop()
            new = np.flatnonzero(linked[node] & ~seen)
            up[new], seen[new] = node, True
            edge.extend(new)
    with_links = np.flatnonzero(degree)
    return [nodes[k] for k in with_links], degree[with_links].tolist(), [nodes[up[k]] for k in with_links]


def _links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """uid, links and up from every unit of work."""
    matched = _matched(nodes)
    block = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int")
    # With one block all pairs are its own; with more, block b meets every other one, and itself in the unit (b, b).
    met = _groups(matched).withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.select("cell", "uid", F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi"), (F.col("_block") > F.col("_other")).cast("int").alias("side"))
    deep = matched.filter(F.col("length") > SHORTEST).groupBy("uid").agg(F.collect_list(F.struct("tree", "length")).alias("deep"))
    units = units.join(deep, "uid", "left").join(rows.select("uid", F.coalesce("_row.text", F.lit("")).alias("text")), "uid")
    units = units.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [], [])

        def result() -> pa.RecordBatch:
            found = _verify(*held, tree=unit[0] & 31)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["uid", "links", "up"])

        for batch in slices(batches):
            keys = zip(batch["cell"].to_pylist(), batch["lo"].to_pylist(), batch["hi"].to_pylist(), strict=True)
            for key, *row in zip(keys, *(batch[x].to_pylist() for x in ("uid", "side", "text", "deep")), strict=True):
                if key != unit:
                    if len(held[0]) > 1:
                        yield result()
                    unit, held = key, ([], [], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            yield result()

    links = written(units.select("cell", "lo", "hi", "uid", "side", "text", "deep").mapInArrow(run, "uid long, links long, up long"), "forest-links")
    discard(matched)
    return links


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The described rows, and per node copies, first row, links and root."""
    rows = _describe(docs)
    nodes = _nodes(rows)
    links = _links(rows, nodes)
    counted = links.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(links.filter("uid <> up").select(F.col("uid").alias("a"), F.col("up").alias("b"))).withColumnRenamed("node", "uid")
    nodes = nodes.drop("labels", "words").join(counted, "uid", "left").join(roots, "uid", "left")
    return rows, nodes.withColumns({"links": F.coalesce("links", F.lit(0)), "root": F.coalesce("root", "uid")})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the row's class), n_links (other shingle sets at the threshold or above)
    and n_copies (other rows with the row's own set) of every row."""
    rows, nodes = _classes(docs.select("doc_id", "text"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    verdicts = nodes.join(least, "root").select("node", "class_id", F.col("links").alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    out = rows.select("_row.doc_id", "node").join(verdicts, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns: of each class the first by doc_id, and every row without words."""
    rows, nodes = _classes(docs)
    order = F.struct(F.col("first_id").isNull(), "first_id", "first_hash", "uid")
    kept = nodes.groupBy("root").agg(F.min_by("uid", order).alias("uid")).select("uid", F.lit(True).alias("kept"))
    out = rows.select("_row", "uid", "node").join(kept, "uid", "left").filter("kept or node is null")
    return out.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
