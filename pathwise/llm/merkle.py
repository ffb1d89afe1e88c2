"""A Merkle manifest of a table: contiguous digest matrices in aligned blocks, a proof for every row, tampering shown.

A leaf is the sha256 of a row's columns, each written as length, colon and value. Leaves of a partition value (`lang`)
ascend by `doc_id`; every `FANOUT` consecutive nodes become their digest until one is left, the subroot; subroots in
order of their values give the root in the same way.

Leaves get their places in two small shuffles of digests, not texts: one sorts them by range, the other deals them to
aligned blocks of `FANOUT ** LEVELS` places. A block is one row: its hex digests are one numpy matrix, reshaped by the
fan-out and hashed row by row, level by level; its top is a node of the next round, whose blocks hold as many tops. So
`r` rounds make trees of `r * LEVELS` levels, and no task holds more than a few blocks. Proofs come down the same rounds: a block
row gets its own path from the round above, one row each, and every sibling by index arithmetic from its matrices.

Defined cases: nulls in any column are written `-` (no other value is: those have a colon); a null partition value is the
first one, a null doc_id the first leaf; rows with one doc_id are in order of their leaves, repeated rows are leaves of
their own; empty texts and texts of any length are hashed whole; a partition of one row has its leaf as subroot; one
subroot is the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import discard, slices, table, written

#: Nodes of a run, and levels of a block.
FANOUT, LEVELS = 8, 3
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "group string, block long, total long, names array<bigint>, nodes binary, changed binary, top string"


def digest(data: bytes) -> bytes:
    """sha256 as hex text."""
    return hashlib.sha256(data).hexdigest().encode()


def leaf(**replaced: Column) -> Column:
    """The leaf of a row; `replaced` gives other values for columns."""
    values = [replaced.get(c, F.col(c)).cast("string") for c in COLUMNS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def levels_for(total: int, levels: int) -> int:
    """How many times nodes are folded until one is left; `levels` at most, as a block folds."""
    out = 0
    while total > 1 and out < levels:
        total, out = -(-total // FANOUT), out + 1
    return out


def fold_levels(nodes: bytes, levels: int) -> list[bytes]:
    """The digest matrices of a block from its nodes (contiguous 64-byte hex rows) up to its top, `levels` further ones."""
    out = [nodes]
    for _ in range(levels):
        matrix = np.frombuffer(out[-1], np.uint8).reshape(-1, HEX)
        whole = len(matrix) // FANOUT
        runs = matrix[: whole * FANOUT].reshape(whole, FANOUT * HEX)
        rows = [digest(row) for row in runs]
        if whole * FANOUT < len(matrix):
            rows.append(digest(matrix[whole * FANOUT :].tobytes()))
        out.append(b"".join(rows))
    return out


def siblings(matrices: list[bytes], k: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands before and after node `k`'s ancestors in their runs, from its own level up to below the top."""
    for level in matrices[:-1]:
        at, first = k * HEX, k // FANOUT * FANOUT * HEX
        yield level[first:at], level[at + HEX : first + FANOUT * HEX]
        k //= FANOUT


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _placed(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """`nodes` (group, name, node, changed), sorted by these, with place (within the group, from 0) and total; and the table
    that it reads. The sorted rows are a table, so that the parts' counts belong to the very rows that get their places;
    windows run over groups' parts."""
    ordered = nodes.repartitionByRange("group", "name", "node").sortWithinPartitions("group", "name", "node")
    ordered = written(ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), name)
    parts = ordered.groupBy("group", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    by_group = Window.partitionBy("group")
    before = F.sum("_n").over(by_group.orderBy("_part")) - F.col("_n")
    parts = parts.select("group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_group).alias("total"))
    return ordered.join(parts, ["group", "_part"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift"), ordered


def _blocks(placed: DataFrame, name: str, levels: int) -> DataFrame:
    """The aligned blocks of `placed`, one row each, with what they fold to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, nodes, changed = None, [], [], []

        def block() -> pa.RecordBatch:
            group, number, total = key
            joined = "".join(nodes).encode()
            top = fold_levels(joined, levels_for(total, levels))[-1].decode()
            row = [[group], [number], [total], [list(names)], [joined], ["".join(changed).encode()], [top]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], ["group", "block", "total", "names", "nodes", "changed", "top"])

        for batch in slices(batches, 4096):
            keys = zip(*(batch[c].to_pylist() for c in ("group", "block", "total")), strict=True)
            for new, name_, node, other in zip(keys, *(batch[c].to_pylist() for c in ("name", "node", "changed")), strict=True):
                if new != key:
                    if nodes:
                        yield block()
                    key, names, nodes, changed = new, [], [], []
                names.append(name_)
                nodes.append(node)
                changed.append(other or " " * HEX)
        if nodes:
            yield block()

    dealt = placed.withColumn("block", F.floor(F.col("place") / FANOUT**levels)).repartition("group", "block").sortWithinPartitions("group", "block", "place")
    return written(dealt.select("group", "block", "total", "name", "node", "changed").mapInArrow(run, _BLOCK), name)


def _rounds(placed: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Blocks of the nodes, of their tops, and so on until every group has one block."""
    out = [_blocks(placed, name, levels)]
    while (out[-1].agg(F.max("block")).first()[0] or 0) > 0:
        tops = out[-1].select("group", F.col("block").alias("place"), F.ceil(F.col("total") / FANOUT**levels).alias("total"), F.col("block").alias("name"), F.col("top").alias("node"), F.lit(None).cast("string").alias("changed"))
        out.append(_blocks(tops, f"{name}-{len(out)}", levels))
    return out


def _paths(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """group, place, name and path (sides of every level up to the root, before and after in turn) of the blocks' nodes. above: the
    paths of the blocks themselves, by group and place; one row meets one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                matrices, count = fold_levels(row["nodes"], levels_for(row["total"], levels)), len(row["nodes"]) // HEX
                paths = [[side for pair in siblings(matrices, k) for side in pair] + row["path"] for k in range(count)]
                places = row["block"] * FANOUT**levels + np.arange(count)
                yield pa.RecordBatch.from_arrays([pa.array([row["group"]] * count, pa.string()), pa.array(places), pa.array(row["names"], pa.int64()), pa.array(paths, pa.list_(pa.binary()))], ["group", "place", "name", "path"])

    joined = blocks.join(above.select("group", F.col("place").alias("block"), "path"), ["group", "block"])
    return joined.select("group", "block", "total", "names", "nodes", "path").mapInArrow(run, "group string, place long, name long, path array<binary>")


def _down(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The paths of the first round's blocks."""
    for blocks in rounds[:0:-1]:
        above = _paths(blocks, above, levels)
    return above


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, siblings (how many the proof has), folded_root and verified of every
    row. The tables of blocks that it works with are left, as the manifest to keep: `left_tables()` names them."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    if id_kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("doc_id is to be an integer")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", UPPER, LOWER)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("group"), F.col("doc_id").cast("long").alias("name"),
        leaf().alias("node"), F.when(chosen, leaf(text=lowered)).alias("changed"))
    leaves = written(leaves, "merkle-leaves")  # the texts are read and hashed once
    placed, ordered = _placed(leaves, "merkle-sorted")
    rounds = _rounds(placed, "merkle-blocks", levels)
    discard(leaves, ordered)
    # `top` of a group's only block in the last round is its subroot; groups ascend bytewise, that of null first.
    subroots = rounds[-1].select("group", F.col("top").alias("subroot"))
    heads = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("node"), F.lit(None).cast("string").alias("changed"))
    placed, ordered = _placed(heads, "merkle-groups")
    heads = written(placed.select("place", "total", F.col("name").alias("head"), "node"), "merkle-heads")
    discard(ordered)
    upper = _rounds(heads.select(F.lit("").alias("group"), "place", "total", F.col("place").alias("name"), "node", F.lit(None).cast("string").alias("changed")), "merkle-root", levels)
    root = upper[-1].select(F.col("top").alias("root"))
    start = upper[-1].select("group", F.col("block").alias("place"), F.array().cast("array<binary>").alias("path"))
    ways = _paths(upper[0], _down(upper, start, levels), levels)
    ways = heads.join(ways.select("place", "path"), "place").select(F.col("head").alias("group"), F.lit(0).cast("long").alias("place"), "path")
    above = _down(rounds, ways, levels)
    # One row by construction, the root, hence the broadcast.
    blocks = rounds[0].join(above.select("group", F.col("place").alias("block"), "path"), ["group", "block"]).join(subroots, "group").join(F.broadcast(root), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "siblings", "folded_root", "verified"]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.bool_()]
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(_prove(row, levels), kinds, strict=True)], names)

    return blocks.select("total", "names", "nodes", "changed", "path", "subroot", "root").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, siblings int, folded_root string, verified boolean").withColumn("doc_id", F.col("doc_id").cast(id_kind))


def _prove(row: dict, levels: int) -> list[list]:
    """The result's columns for a block: proofs from its matrices and the path above it, roots folded from its leaves."""
    matrices = fold_levels(row["nodes"], levels_for(row["total"], levels))
    above = list(zip(row["path"][::2], row["path"][1::2], strict=True))
    count, top_sides = len(row["names"]), b"".join(row["path"])
    leaves, proofs, numbers, roots = [], [], [], []
    for k in range(count):
        own = row["nodes"][k * HEX : (k + 1) * HEX]
        sides = list(siblings(matrices, k))
        proof = b"".join(side for pair in sides for side in pair) + top_sides
        changed = row["changed"][k * HEX : (k + 1) * HEX]
        leaves.append(own.decode())
        proofs.append(digest(proof).decode())
        numbers.append(len(proof) // HEX)
        roots.append(folded(own if changed.isspace() else changed, sides + above).decode())
    return [row["names"], leaves, [row["subroot"]] * count, [row["root"]] * count, proofs, numbers, roots, [x == row["root"] for x in roots]]


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _oracle(levels: int = 8) -> str:
    """The same in SQL, for at most `FANOUT ** levels` rows of a value: every level spelled out."""
    chars = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {chars}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    part = lambda c, text: f"coalesce(CAST(strlen(CAST({text} AS VARCHAR)) AS VARCHAR) || ':' || CAST({text} AS VARCHAR), '-')"
    written_ = lambda text: " || ".join(part(c, text if c == "text" else c) for c in COLUMNS)
    steps = []
    for kind, source, group in (("a", "placed", "grp"), ("b", "heads", "one")):
        steps.append(f"{kind}0 AS (SELECT {group} AS g, place, node, total FROM {source})")
        for k in range(levels):
            steps.append(f"{kind}{k + 1} AS (SELECT g, place // 8 AS place, CASE WHEN any_value(total) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node, (any_value(total) + 7) // 8 AS total FROM {kind}{k} GROUP BY g, place // 8)")
            around = lambda side: f"CASE WHEN total > 1 THEN coalesce(string_agg(node, '') OVER (PARTITION BY g, place // 8 ORDER BY place ROWS BETWEEN {side}), '') ELSE '' END"
            steps.append(f"{kind}s{k} AS (SELECT g, place, total > 1 AS live, {around('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS x, {around('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS y FROM {kind}{k})")
        if kind == "a":
            steps.append(f"heads AS (SELECT 1 AS one, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, node, count(*) OVER () AS total, g FROM a{levels})")
    joins = [f"LEFT JOIN as{k} ON as{k}.g IS NOT DISTINCT FROM p.grp AND as{k}.place = p.place // {8**k}" for k in range(levels)]
    joins += [f"LEFT JOIN bs{k} ON bs{k}.place = h.place // {8**k}" for k in range(levels)]
    tables = [f"{kind}s{k}" for kind in "ab" for k in range(levels)]
    proof = " || ".join(f"{t}.x || {t}.y" for t in tables)
    fold = "coalesce(p.changed, p.node)"
    folds = []
    for n, t in enumerate(tables):
        folds.append(f"f{n} AS (SELECT * REPLACE (CASE WHEN live{n} THEN sha256(x{n} || cur || y{n}) ELSE cur END AS cur) FROM {'paths' if n == 0 else f'f{n - 1}'})")
    sides = ", ".join(f"{t}.x AS x{n}, {t}.y AS y{n}, {t}.live AS live{n}" for n, t in enumerate(tables))
    return f"""WITH crct AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
leaves AS (SELECT lang AS grp, doc_id, sha256({written_('text')}) AS node, CASE WHEN {crc} % 3 = 0 THEN sha256({written_(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed FROM documents, crct),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS place, count(*) OVER (PARTITION BY grp) AS total FROM leaves),
{", ".join(steps)},
paths AS (SELECT p.doc_id, p.node AS leaf, h.node AS subroot, (SELECT node FROM b{levels}) AS root, sha256({proof}) AS proof_sha256, CAST(strlen({proof}) // 64 AS INTEGER) AS siblings, {fold} AS cur, {sides}
  FROM placed p JOIN heads h ON h.g IS NOT DISTINCT FROM p.grp {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, siblings, cur AS folded_root, cur = root AS verified FROM f{len(tables) - 1}"""


ORACLE = _oracle(5)
