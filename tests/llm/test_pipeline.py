"""The whole pipeline on a small table against a brute-force version of its stages."""

from __future__ import annotations

import collections
import hashlib
import random
import tempfile

import numpy as np

import corpus_pipeline
from tests.llm.fixtures import DOCS, documents
from tests.llm.test_operators import WORD, _brute_classes, rows_of


def base_failed(text: str) -> bool:
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    again = {k for i, w in enumerate(windows) if seen[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words) < 50 or 100 * len(again) > 50 * len(words)


def without_repeats(texts: dict, length: int) -> dict:
    raw = {k: t.encode() for k, t in texts.items()}
    seen = collections.Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out[k] = bytes(b for b, x in zip(t, gone, strict=True) if not x).decode("utf-8", "ignore")
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinorstu") for _ in range(rng.randrange(3, 9)))
    passage = " ".join(word() for _ in range(70))
    rows = [" ".join(word() for _ in range(60 + k)) + (" " + passage + " " + " ".join(word() for _ in range(30)) if k % 5 == 0 else "") for k in range(40)]
    near = rows[1].split()
    near[30] = "changed"
    rows += [rows[0], rows[2], " ".join(near), "too short", "", "same words again " * 60]
    return [(k, t, "en", ("a", "b", None)[k % 3], len(t)) for k, t in enumerate(rows)]


def test_pipeline_against_brute_force(spark):
    folder = tempfile.mkdtemp(prefix="pathwise-test-")
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    got = rows_of(corpus_pipeline.run(spark, folder))

    kept = {k: t for k, t, *_ in rows if not base_failed(t)}  # no host fails in most of its documents here
    first = {c for c, _ in _brute_classes(kept).values()}
    texts = without_repeats({k: kept[k] for k in first}, corpus_pipeline.PASSAGE_BYTES)
    texts = {k: t for k, t in texts.items() if WORD.search(t)}
    digest = {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    times = collections.Counter(r["doc_id"] for r in got)
    assert set(times) <= set(texts) and max(times.values()) <= 2
    assert all(r["decoded_sha256"] == digest[r["doc_id"]] and r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    sizes = {k: len(WORD.findall(t)) for k, t in texts.items()}
    source = {k: s for k, _, _, s, _ in rows}
    total, taken = collections.Counter(), collections.Counter()
    for k, n in sizes.items():
        total[source[k]] += n
    for k, n in times.items():
        taken[source[k]] += n * sizes[k]
    budget, weights = 1.5 * sum(total.values()), {"a": 5, "b": 2, None: 1}
    target, open_ = {}, set(total)
    while open_:  # cap, then share the rest again
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * total[s]}
        target |= {s: 2 * total[s] if s in full else level * weights[s] for s in (full or open_)}
        open_ = open_ - full if full else set()
    assert all(abs(taken[s] - target[s]) <= max(sizes.values()) for s in total)


def test_stages_keep_columns_and_defined_cases(spark):
    docs = documents(spark, clashing=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
