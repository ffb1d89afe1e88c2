"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Each passage becomes shares of pairs of character classes and
of its word statistics, a small tanh layer encodes it, and gated attention, exp(w . (tanh(V h) * sigmoid(U h))) over
the document's passages, weighs the encodings; a logistic layer scores the weighted sum. Only document labels are
known; layer, attention and score are learned from them together in numpy, on a bounded sample with as many documents
of either label, and the score's intercept is then moved to the labels' true ratio, so that a score estimates the share
of label 1.

Defined cases: a null or empty text is one passage without words and is scored like any other; without labelled rows
every score is 0.5; texts of any length are read whole; repeated rows count as often as they occur; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import held_out, table, text_of
from pathwise.llm.sampling import sampled

#: Bound of the training sample: documents of each label. Every passage of them is read.
DOCS_PER_LABEL = 2000
PASSAGE_WORDS, WIDTH, GATE = 64, 16, 8
EPOCHS, BATCH, RATE, SEED = 30, 32, 0.02, 7
PREDICT_FROM = 0.3

CLASSES = 9
CLASS_OF = np.full(256, 8, np.uint8)  # other marks
CLASS_OF[[9, 10, 13, 32]] = 0
CLASS_OF[97:123] = 1
CLASS_OF[65:91] = 2
CLASS_OF[48:58] = 3
CLASS_OF[128:] = 4
CLASS_OF[[46, 44, 59, 58, 39, 45]] = 5
CLASS_OF[[33, 63]] = 6
CLASS_OF[[35, 42, 36, 37, 38, 124, 60, 62]] = 7
#: Buckets of hashed subwords, runs of three bytes.
HASHED = 256
FEATURES = CLASSES * CLASSES + 6 + HASHED


def passages(text: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The passages of a text and of each its words, different words, and words not seen in the text before."""
    words, out, stats, seen = text.split(), [], [], set()
    for k in range(0, max(1, len(words)), PASSAGE_WORDS):
        part = words[k : k + PASSAGE_WORDS]
        different = set(part)
        stats.append((len(part), len(different), len(different - seen)))
        seen |= different
        out.append(" ".join(part).encode())
    return out, stats


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage of each text, and where each text's rows begin."""
    parts: list[bytes] = []
    stats: list[tuple[int, int, int]] = []
    begins = []
    for text in texts:
        begins.append(len(parts))
        own, numbers = passages(text)
        parts += own
        stats += numbers
    lengths = np.array([len(x) for x in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    kinds = CLASS_OF[data].astype(np.int64)
    of = np.repeat(np.arange(len(parts)), lengths)
    pairs = of[1:] * (CLASSES * CLASSES) + kinds[:-1] * CLASSES + kinds[1:]
    pairs = pairs[of[1:] == of[:-1]]
    out = np.zeros((len(parts), FEATURES), np.float32)
    out[:, : CLASSES * CLASSES] = np.bincount(pairs, minlength=len(parts) * CLASSES * CLASSES).reshape(len(parts), -1) / np.maximum(1, lengths - 1)[:, None]
    n, different, new = np.array(stats, float).reshape(-1, 3).T
    runs = (data[:-2].astype(np.uint32) << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
    buckets = of[2:] * HASHED + ((runs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64)
    buckets = buckets[of[2:] == of[:-2]]
    own = slice(CLASSES * CLASSES, CLASSES * CLASSES + HASHED)
    out[:, own] = np.bincount(buckets, minlength=len(parts) * HASHED).reshape(len(parts), -1) / np.maximum(1, lengths - 2)[:, None]
    out[:, -6:] = np.stack([n / PASSAGE_WORDS, different / np.maximum(1, n), new / np.maximum(1, n), lengths / np.maximum(1, n) / 10, n == 0, np.minimum(1, n / 8)], 1)
    return np.sqrt(out), np.array(begins)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(begins, len(x)))
    of = np.repeat(np.arange(len(begins)), sizes)
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, begins)[of])
    a /= np.add.reduceat(a, begins)[of]
    z = np.add.reduceat(a[:, None] * h, begins)
    return {"of": of, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, x, begins)
    up = (_sigmoid(f["logit"]) - y) / len(y)
    dz = up[:, None] * p["c"]
    dh = f["a"][:, None] * dz[f["of"]]
    da = (f["h"] * dz[f["of"]]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, begins)[f["of"]])
    gate = de[:, None] * p["w"]
    dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
    dh = dh + dt @ p["V"].T + ds @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ up, "d": up.sum()}


def train(texts: list[str], labels: list[int], ratio: float) -> dict[str, np.ndarray]:
    """Parameters from document labels; `ratio` is the labels' true count of 1 over that of 0, and moves the intercept."""
    rng = np.random.default_rng(SEED)
    parts = [features(texts[k : k + 128]) for k in range(0, len(texts), 128)]  # what `features` holds per byte stays small
    x = np.concatenate([own for own, _ in parts])
    offsets = np.cumsum([0, *(len(own) for own, _ in parts[:-1])])
    begins = np.concatenate([first + at for (_, first), at in zip(parts, offsets, strict=True)])
    del parts
    ends, y = np.append(begins[1:], len(x)), np.array(labels, float)
    scale = {"W": (FEATURES, WIDTH), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "w": (GATE,), "c": (WIDTH,)}
    p = {k: rng.normal(0, 0.3, v) for k, v in scale.items()} | {"b": np.zeros(WIDTH), "d": np.zeros(())}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    total = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            bag = np.concatenate([np.arange(begins[r], ends[r]) for r in rows])
            sizes = ends[rows] - begins[rows]
            step += 1
            for name, g in _gradients(p, x[bag], np.cumsum(sizes) - sizes, y[rows]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = p[name] - RATE * (1 - step / (total + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    sampled_ratio = max(y.sum(), 0.5) / max((1 - y).sum(), 0.5)
    p["d"] = p["d"] + np.log(ratio) - np.log(sampled_ratio)
    return p


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """Parameters from the labels whose documents are not held out; None where there are none."""
    known = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # At most 2 * DOCS_PER_LABEL ids, hence the broadcast: the documents stay where they are.
    picked = F.broadcast(sampled(known, "quality", DOCS_PER_LABEL, labels=2))
    rows = docs.select("doc_id", text_of().alias("text")).join(picked, "doc_id")
    sample = rows.toPandas().sort_values(["doc_id", "text", "quality"])
    if not len(sample):
        return None
    return train(sample["text"].tolist(), sample["quality"].tolist(), max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5))


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score, predicted, passages and top_passage (the one with most attention) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                x, begins = features(part["text"].to_pylist())
                sizes = np.diff(np.append(begins, len(x)))
                if model is None:
                    scores, top = np.full(part.num_rows, 0.5), np.zeros(part.num_rows, np.int64)
                else:
                    f = _forward(model, x, begins)
                    scores = _sigmoid(f["logit"])
                    best = np.flatnonzero(f["a"] == np.maximum.reduceat(f["a"], begins)[f["of"]])
                    top = best[np.searchsorted(f["of"][best], np.arange(len(begins)))] - begins
                columns = [part["doc_id"], part["held_out"], pa.array(scores), pa.array((scores >= PREDICT_FROM).astype(np.int32)), pa.array(sizes), pa.array(top)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "passages", "top_passage"])

    whole = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages long, top_passage long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
