"""URL filters, whitening and Merkle manifests against plain loops, on the defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pathwise.llm import merkle, url_filter, whitening
from tests.llm.fixtures import documents, empty

# 11 URL filters


def _plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules.items():
        of, slash, under = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + under):
            fits.append((len(rule), len(of), rule, verdict))
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


@pytest.mark.parametrize("names, together", [(40, None), (1 << 20, 7)])
def test_rules_against_a_loop(spark, monkeypatch, names, together):
    """Several segments, and digests of which many are equal so that stored names must tell them apart."""
    monkeypatch.setattr(url_filter, "SEGMENT_NAMES", names)
    rng = random.Random(11)
    label = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 3)))
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice("/abé") for _ in range(rng.randrange(5)))
    rows = [(f"{host()}/{path()}", rng.choice(["allow", "block"])) for _ in range(400)] + [(host(), "block") for _ in range(9)]
    best: dict = {}
    for rule, verdict in rows:
        best[rule] = max(verdict, best.get(rule, verdict))
    urls = [rng.choice(["http://", "x", "HTTPS://"]) + rng.choice(["", "a@", "."]) + host().upper() + rng.choice(["", "/", ":80/", "/" + path(), "?" + path(), "#x", "/a?b#c"]) for _ in range(600)]
    urls += [None, "", "://", "http://", "a://b://c/d", "http://Éa.b/x", "http://a/" + "b/" * 20000, urls[0]]
    table = spark.createDataFrame([(k if k % 9 else None, u, "x") for k, u in enumerate(urls)], "page_id int, url string, host string")
    of = url_filter.UrlFilter.of(spark.createDataFrame(rows, "rule string, verdict string"))
    assert len(of.rules) > 3 or together
    got = sorted((r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in of.judge(table).collect())
    assert got == sorted((h, p, r or "", v) for h, p, r, v in (_plain_verdict(u, best) for u in urls))


def test_names_with_equal_keys(tmp_path):
    names = [b"a", b"bb", b"", "é".encode(), b"z" * 500]
    keys = np.array([-5, 7, 7, 7, 9], np.int64)
    path = tmp_path / "segment"
    path.write_bytes(url_filter.pack(keys, names, [b"1", b"22", b"3", b"", b"5"]))
    of = url_filter.Segment(str(path))
    assert of.find(keys, names) == [b"1", b"22", b"3", b"", b"5"]
    assert of.find(np.array([7, 7, 9, -5, 1 << 62], np.int64), [b"b", b"a", b"", b"bb", b"a"]) == [None] * 5
    path.write_bytes(url_filter.pack(keys[:0], [], []))
    assert url_filter.Segment(str(path)).find(keys[:1], [b"a"]) == [None]


def test_url_filter_cases(spark):
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://www.Example.NET/en/x"), (2, "http://net/"), (3, "http://a.net"), (4, None), (5, "http://x.example.com/de/1?q"), (6, "https://fr.org/fr/"), (7, "http://notnet/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.UrlFilter.of(rules).judge(pages).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.com/de/", "block"), 6: ("org/fr/", "allow"), 7: (None, "allow")}
    assert url_filter.UrlFilter.of(rules).judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.UrlFilter.of(rules.limit(0), "block").judge(pages).collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.UrlFilter.of(spark.createDataFrame([("/en/", "block")], "rule string, verdict string"))


# 12 whitening


def _integers(vector):
    return [math.floor(Fraction(c) * 1024) + 100_000 for c in vector]


@pytest.mark.parametrize("scale", [0.3, 1e6, 1e14])
def test_whitening_against_fractions(spark, monkeypatch, scale):
    monkeypatch.setattr(whitening, "MERGE", 3)
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5)) * scale
    vectors = [v.tolist() for v in mixed] + [mixed[0].tolist(), None, [1.0] * 4, [float("nan")] * 5, [1.0, None, 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], []]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id int, embedding array<double>, n int").repartition(11)
    rows = [r.asDict() for r in whitening.whiten(df).collect()]
    x = {k: _integers(v) for k, v in enumerate(vectors[:121])}
    n, total = len(x), [sum(v[j] for v in x.values()) for j in range(5)]
    assert {(r["vec_id"], r["component"]) for r in rows} == {(k, c) for k in x for c in range(1, 6)} and {r["n"] for r in rows} == {n}
    centred = {k: [Fraction(v[j]) - Fraction(total[j], n) for j in range(5)] for k, v in x.items()}
    cov = np.array([[float(sum(v[i] * v[j] for v in centred.values()) / n) for j in range(5)] for i in range(5)])
    values, basis = np.linalg.eigh(cov)
    assert np.allclose(sorted({r["explained"] for r in rows}), values / np.trace(cov), rtol=1e-9)
    z = np.array([[float(c) for c in centred[k]] for k in x]) @ basis[:, ::-1] / np.sqrt(values[::-1])
    own = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))]).reshape(n, 5)
    assert np.allclose(own * np.sign((own * z).sum(0)), z, atol=1e-8)
    assert max(r["identity_error"] for r in rows) < 1e-9
    for r in rows:
        exact = sum((n * x[r["vec_id"]][j] - total[j]) ** 2 for j in range(5))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
        assert r["deviation_wide"] == (exact if exact < 10**38 else None)


def test_exact_products():
    rng = np.random.default_rng(9)
    for most in (1, 500, 1 << 30, 1 << 61):
        values = rng.integers(-most, most, (5000, 3), endpoint=True)
        assert (whitening.gram(values) == values.astype(object).T @ values.astype(object)).all()
        assert (sum(x.astype(np.int64).astype(object) << (whitening.LIMB_BITS * k) for k, x in enumerate(whitening.limbs(values))) == values).all()


def test_whitening_cases(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], kind)).collect()
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and flat[0]["explained"] == 1.0
    huge = whitening.whiten(spark.createDataFrame([(k, [1e308 * (-1) ** k, 0.5 * k]) for k in range(6)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in huge} == {1} and {r["deviation"] for r in huge} == {None}


# 13 Merkle manifest


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _fold(nodes):
    """The levels from `nodes` to their single top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def _sides(levels, k):
    for level in levels[:-1]:
        first = k // 8 * 8
        yield "".join(level[first:k]), "".join(level[k + 1 : first + 8])
        k //= 8


def _plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h("".join(map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    by_lang: dict = {}
    for r in rows:
        lower = None if r["text"] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
        other = leaf(r, lower) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else None
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), other))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [_fold([x[2] for x in sorted(by_lang[g], key=lambda x: x[:3])]) for g in langs]
    top = _fold([t[-1][0] for t in trees])
    for place, (g, tree) in enumerate(zip(langs, trees, strict=True)):
        for k, (there, doc_id, own, other) in enumerate(sorted(by_lang[g], key=lambda x: x[:3])):
            sides = [*_sides(tree, k), *_sides(top, place)]
            node = other or own
            for before, after in sides:
                node = _h(before + node + after)
            yield doc_id if there else None, own, tree[-1][0], top[-1][0], _h("".join(a + b for a, b in sides)), node, node == top[-1][0]


@pytest.mark.parametrize("levels, copies", [(3, 1), (1, 5)])
def test_manifest_against_a_loop(spark, levels, copies):
    """Blocks of three levels, and of one so that trees need several rounds; 3 partition values and 40."""
    docs = documents(spark, clashing=True)
    if copies > 1:
        from pyspark.sql import functions as F

        docs = docs.crossJoin(spark.range(copies).withColumnRenamed("id", "_c")).withColumn("doc_id", F.col("doc_id") * 7 + F.col("_c")).withColumn("text", F.concat("text", F.lit("QRS"))).drop("_c")
        docs = docs.unionByName(docs.withColumn("lang", F.concat(F.lit("é"), (F.coalesce("doc_id", F.lit(3)) % 40).cast("string"))))
    rows = [r.asDict() for r in docs.collect()]
    got = [tuple(r)[:5] + tuple(r)[6:] for r in merkle.manifest(docs, levels).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(_plain_manifest(rows), key=key)
    assert any(not x[-1] for x in got) or copies == 1


def test_manifest_cases(spark):
    assert merkle.manifest(empty(spark)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(7, "Only")], "doc_id int, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "4 n_chars")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == _h("1:7--1:44:Only") and one["proof_sha256"] == _h("") and one["siblings"] == 0
    matrices = merkle.fold_levels(b"".join(merkle.digest(bytes([k])) for k in range(19)), 3)
    assert [len(m) // 64 for m in matrices] == [19, 3, 1, 1]
