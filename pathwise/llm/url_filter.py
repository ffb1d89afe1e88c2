"""URL verdicts by rules on hosts and paths, looked up in memory-mapped arrays of sorted digests.

A rule is `host/path`, say `example.net/en/`: it fits its host and all subdomains where the url's path starts with the
rule's; of the rules that fit, the longest decides (then the one with the longer host), and a url that none fits gets
the default. `build` sorts the names of any number of rules by their 64-bit xxhash, in Spark, and writes them in
segments of disjoint key ranges as plain files in the shared folder: keys, offsets, values and the names themselves. A
task maps the files and probes whole batches by binary search; every hit is confirmed against the stored name, so two
names with one key cannot be mistaken. Mapped pages are loaded as they are touched: an index may be larger than memory.

Two arrays are kept: `hosts`, a rule's host with the lengths that its rules' paths have, and `rules`. A url probes its
host's suffixes in the first and, only where one is listed, beginnings of its path in the second; each different host
of a batch is probed once. Urls are neither moved nor sorted.

Defined cases: a null url, or one without `://`, has empty host and path and gets the default; so does an empty host;
urls of any length are read whole; hosts are lower-cased in A-Z only and keep port and user as they stand; repeated rows
get equal verdicts; an empty table gives an empty result; no rules at all give the default; a rule given twice with
different verdicts blocks; an empty rule host is refused; a null page_id is as good as any; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import discard, shared_dir, slices, table, written

#: The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DEFAULT = "allow"
#: Names of a segment, about.
SEGMENT_NAMES = 1 << 20
SEED, MAGIC = 42, b"DIGARR1\0"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "first long, last long, n long, path string"


def key_of(name: bytes) -> int:
    """The signed 64-bit key, as Spark's xxhash64 has it."""
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(name, seed=SEED)))[0]


def pack(keys: np.ndarray, names: list[bytes], values: list[bytes]) -> bytes:
    """One segment: head, keys in order, ends of names and values, names, values."""
    ends = np.cumsum([len(x) for x in names], dtype=np.int64), np.cumsum([len(x) for x in values], dtype=np.int64)
    head = MAGIC + np.array([len(keys)], "<i8").tobytes()
    return b"".join([head, keys.astype("<i8").tobytes(), ends[0].astype("<i8").tobytes(), ends[1].astype("<i8").tobytes(), *names, *values])


class Segment:
    """A mapped segment. Only what a probe touches is read."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        if self.raw[:8].tobytes() != MAGIC:
            raise ValueError(f"no digest array: {path}")
        self.n = n = int(np.frombuffer(self.raw[8:16].tobytes(), "<i8")[0])
        self.keys, self.name_ends, self.value_ends = (self.raw[16 + 8 * n * k : 16 + 8 * n * (k + 1)].view("<i8") for k in range(3))
        self.names_at = 16 + 24 * n
        self.values_at = self.names_at + (int(self.name_ends[-1]) if n else 0)

    def _part(self, ends: np.ndarray, base: int, k: int) -> bytes:
        return self.raw[base + (int(ends[k - 1]) if k else 0) : base + int(ends[k])].tobytes()

    def find(self, keys: np.ndarray, names: list[bytes]) -> list[bytes | None]:
        """The value of each name, None for those that aren't stored. keys: the names' keys."""
        at = np.searchsorted(self.keys, keys, "left")
        hit = np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == keys)) if self.n else np.zeros(0, np.int64)
        out: list[bytes | None] = [None] * len(names)
        for k in hit.tolist():
            place = int(at[k])
            while place < self.n and self.keys[place] == keys[k]:  # names that share a key stand together
                if self._part(self.name_ends, self.names_at, place) == names[k]:
                    out[k] = self._part(self.value_ends, self.values_at, place)
                    break
                place += 1
        return out


class DigestArray:
    """All segments of one array: a key's segment is found by the segments' first keys."""

    def __init__(self, segments: list[tuple[int, int, str]]):
        segments = sorted(segments)
        self.first, self.last = (np.array([s[k] for s in segments], np.int64) for k in range(2))
        self.files = [Segment(_local(s[2])) for s in segments]

    def find(self, names: list[str]) -> list[bytes | None]:
        stored = [x.encode("utf-8", "surrogatepass") for x in names]
        keys = np.array([key_of(x) for x in stored], np.int64)
        of = np.searchsorted(self.first, keys, "right") - 1
        inside = np.flatnonzero((of >= 0) & (keys <= self.last[of])) if len(self.first) else np.zeros(0, np.int64)
        out: list[bytes | None] = [None] * len(names)
        for s in np.unique(of[inside]).tolist():
            own = inside[of[inside] == s]
            for k, value in zip(own.tolist(), self.files[s].find(keys[own], [stored[k] for k in own.tolist()]), strict=True):
                out[k] = value
        return out


def _local(path: str) -> str:
    """A file that can be mapped: the shared one where the folder is mounted, else this executor's copy by Spark."""
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else SparkFiles.get(os.path.basename(parsed.path))


@lru_cache(maxsize=4)
def _opened(segments: tuple) -> DigestArray:
    return DigestArray(list(segments))


def build(named: DataFrame, label: str) -> list[tuple[int, int, str]]:
    """The digest array of `named` (name, value binary; names differ): first key, last key and path of each segment.

    Spark sorts the names by key and range; each task writes its range's file under a name of its own, and only files of
    tasks that succeeded are listed, so a lost executor or a task run twice leaves no half of one."""
    spark = named.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        names: list[bytes] = []
        values: list[bytes] = []
        for batch in batches:
            keys.append(batch["key"].to_numpy())
            names += batch["name"].to_pylist()
            values += batch["value"].to_pylist()
        if names:
            every = np.concatenate(keys)
            target, base = fs.FileSystem.from_uri(folder)
            path = f"{base}/{uuid.uuid4().hex}-{TaskContext.get().partitionId()}"
            target.create_dir(base, recursive=True)
            with target.open_output_stream(path) as out:
                out.write(pack(every, names, values))
            row = [[int(every[0])], [int(every[-1])], [len(every)], [f"{folder}/{path.rsplit('/', 1)[1]}"]]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, [pa.int64()] * 3 + [pa.string()], strict=True)], ["first", "last", "n", "path"])

    keyed = written(named.select(F.xxhash64("name").alias("key"), F.encode("name", "UTF-8").alias("name"), "value"), f"{label}-keys")
    parts = max(1, -(-keyed.count() // SEGMENT_NAMES))
    dealt = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key", "name")
    # One row a segment of about a million names.
    listed = written(dealt.mapInArrow(run, SCHEMA), f"{label}-segments")
    segments = [(r["first"], r["last"], r["path"]) for r in listed.collect()]
    discard(keyed, listed)
    if urlparse(folder).scheme not in ("", "file"):
        for _, _, path in segments:
            spark.sparkContext.addFile(path)
    return segments


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def suffixes(host: str) -> list[str]:
    """The host and those it is a subdomain of, longest first."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if at + 1 < len(host):
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


@dataclass(frozen=True)
class UrlFilter:
    """Rules as two digest arrays in the shared folder: each one's segments, with their keys and paths."""

    hosts: tuple
    rules: tuple
    default: str = DEFAULT

    @classmethod
    def of(cls, rules: DataFrame, default: str = DEFAULT) -> UrlFilter:
        """The filter of a table (rule, verdict) of any size."""
        at = F.instr("rule", "/")
        split = rules.select(
            F.translate(F.when(at > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")), UPPER, LOWER).alias("host"),
            F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("path"), "verdict")
        if split.filter("host is null or host = '' or verdict is null or verdict not in ('allow', 'block')").limit(1).count():
            raise ValueError("a rule needs a host and the verdict allow or block")
        once = split.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        lengths = F.array_join(F.transform(F.sort_array(F.collect_set(F.length("path")), asc=False), lambda x: x.cast("string")), ",")
        hosts = build(once.groupBy(F.col("host").alias("name")).agg(F.encode(lengths, "UTF-8").alias("value")), "url-hosts")
        names = build(once.select(F.concat("host", "path").alias("name"), F.encode("verdict", "UTF-8").alias("value")), "url-rules")
        return cls(tuple(hosts), tuple(names), default)

    def verdicts(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The deciding rule, if any, and the verdict of each url of a batch."""
        listed, rules = _opened(self.hosts), _opened(self.rules)
        around = {h: suffixes(h) for h in set(hosts)}
        every = sorted({x for some in around.values() for x in some})
        lengths = {x: [int(n) for n in found.decode().split(",")] for x, found in zip(every, listed.find(every), strict=True) if found is not None}
        asked: dict[str, None] = {}
        wanted: list[list[tuple[int, int, str]]] = []
        own: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
        for host, path in zip(hosts, paths, strict=True):
            if (host, path) not in own:
                own[host, path] = sorted(((len(s) + n, len(s), s + path[:n]) for s in around[host] for n in lengths.get(s, ()) if n <= len(path)), reverse=True)
                asked.update((name, None) for _, _, name in own[host, path])
            wanted.append(own[host, path])
        names = list(asked)
        verdict = {name: found.decode() for name, found in zip(names, rules.find(names), strict=True) if found is not None}
        first = [next((name for _, _, name in some if name in verdict), None) for some in wanted]
        return first, [verdict.get(name, self.default) for name in first]

    def judge(self, pages: DataFrame) -> DataFrame:
        """page_id, host, path, rule and verdict of every row of `pages`."""
        kind = pages.schema["page_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4096):
                rules, verdicts = self.verdicts(batch["host"].to_pylist(), batch["path"].to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

        host, path = url_parts(F.col("_url"))
        rows = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
        return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return UrlFilter.of(spark.createDataFrame(RULES, "rule string, verdict string")).judge(table(spark, sf_dir, "pages"))


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


ORACLE = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(rule)} THEN '{rule}'" for rule, _ in sorted(RULES, key=lambda x: -len(x[0])))} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for rule, verdict in RULES)} ELSE '{DEFAULT}' END AS verdict FROM r"""
