"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is lower-cased ASCII and UTF-8 bytes with everything that is no letter turned into single blanks; its subwords
are the runs of 2, 3 and 4 bytes. Each hashes to a row of an embedding table, the rows are averaged, and a linear layer
gives the languages. Table and layer are trained together by stochastic gradient descent in numpy on pieces of whole
texts, a bounded sample of each language that occurs; a temperature fitted on texts kept aside calibrates the score, and the lowest score
that keeps the accepted ones' error under a bound becomes the threshold for `accepted`. At prediction the table times
the layer is one matrix, so that the whole text costs one look-up a subword.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled text everything is
`und`; texts of any length are read whole; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import held_out, table, text_of
from pathwise.llm.sampling import sampled

#: Bound of the training sample: texts of each language. They are whole, and every language is in.
TEXTS_PER_LANGUAGE = 1500
ROWS, WIDTH, ORDERS = 1 << 14, 16, (2, 3, 4)
STEPS, BATCH, RATE, SEED = 700, 64, 0.5, 11
#: Error that the accepted predictions of the calibration texts may have.
MAX_ERROR = 0.01
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}").search
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def clean(text: str) -> bytes:
    return b" " + b" ".join(text.encode().translate(CLEAN).split()) + b" "


def subwords(data: np.ndarray, order: int) -> np.ndarray:
    """The table row of the run of `order` bytes at each position but the last order - 1."""
    packed = np.zeros(max(0, len(data) - order + 1), np.uint32)
    for k in range(order):
        packed = (packed << np.uint32(8)) | data[k : len(data) - order + 1 + k]
    return (((packed + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


def _counts(pieces: list[bytes]) -> np.ndarray:
    """A row of shares of subwords for each piece."""
    out = np.zeros((len(pieces), ROWS), np.float32)
    for row, piece in zip(out, pieces, strict=True):
        data = np.frombuffer(piece, np.uint8)
        for order in ORDERS:
            row += np.bincount(subwords(data, order), minlength=ROWS)
        row /= max(1.0, row.sum())
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # rows x languages: embedding table times layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, one row for each cleaned text, from every subword of it."""
        lengths = np.array([len(x) for x in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(lengths) - lengths
        total = np.zeros((len(texts), len(self.languages)), np.float64)
        for order in ORDERS:
            rows = self.table[subwords(np.append(data, np.zeros(order - 1, np.uint8)), order)]
            edge = ((begins + lengths)[:, None] - np.arange(1, order)).ravel()  # runs that reach into the next text
            rows[edge[edge >= 0]] = 0
            total += np.add.reduceat(rows, begins)
        count = np.maximum(1, sum(np.maximum(0, lengths - order + 1) for order in ORDERS))
        return _softmax((total / count[:, None] + self.bias) / self.temperature)


def train(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    of = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(SEED)
    cleaned = [clean(x) for x in texts]
    y = np.array([of[x] for x in labels])
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    aside[np.unique(y, return_index=True)[1]] = False  # each language has a text to learn from
    learn = np.flatnonzero(~aside)
    embed = rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    pools = [learn[y[learn] == k] for k in range(len(languages))]
    pools = [x for x in pools if len(x)]
    # Batches go round all pools; more than BATCH of them get as many draws each as BATCH pools do.
    steps = STEPS * max(1, -(-len(pools) // BATCH))
    for step in range(steps):
        rows = np.array([rng.choice(pools[k % len(pools)]) for k in range(step * BATCH, (step + 1) * BATCH)])
        pieces = []
        for r in rows:
            n = int(rng.integers(20, 600))
            at = int(rng.integers(0, max(1, len(cleaned[r]) - n)))
            pieces.append(cleaned[r][at : at + n])
        share = _counts(pieces)
        hidden = share @ embed
        p = _softmax(hidden @ layer + bias)
        p[np.arange(BATCH), y[rows]] -= 1
        p /= BATCH
        rate = np.float32(RATE * (1 - step / steps))
        down = p @ layer.T
        layer -= rate * 20 * (hidden.T @ p)
        bias -= rate * p.sum(0)
        embed -= rate * 2000 * (share.T @ down)
    model = Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if aside.any():
        _calibrate(model, [cleaned[k] for k in np.flatnonzero(aside)], y[aside])
    return model


def _calibrate(model: Model, texts: list[bytes], y: np.ndarray) -> None:
    logits = np.log(np.maximum(model.scores(texts), 1e-30))
    grid = np.geomspace(0.2, 5, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()))
    p = _softmax(logits / model.temperature)
    order = np.argsort(-p.max(1), kind="stable")
    wrong = np.cumsum(p.argmax(1)[order] != y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= MAX_ERROR)
    model.threshold = float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0


def fit(docs: DataFrame) -> Model | None:
    """A model from the rows of `docs` that are not held out and have text and lang; None where there are none."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sample = sampled(rows, "lang", TEXTS_PER_LANGUAGE, labels=None).toPandas().sort_values(["doc_id", "text"])
    return train(sample["text"].tolist(), sample["lang"].tolist()) if len(sample) else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part["text"].to_pylist()
                known = [k for k, t in enumerate(texts) if model is not None and LETTER(t)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    p = model.scores([clean(texts[k]) for k in known])
                    score[known] = p.max(1)
                    for k, best in zip(known, p.argmax(1), strict=True):
                        lang[k] = model.languages[best]
                accepted = (score > 0) & (score >= (model.threshold if model else 1))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(lang), pa.array(score), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    whole = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    return whole.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
