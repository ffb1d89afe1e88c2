"""Operators on inputs whose every part has to count."""

from __future__ import annotations

import random
from array import array

import numpy as np

from pathwise.llm import jpeg_media, language_id, quality_mil, sampling, token_shards


def test_mixed_white_space_is_encoded_as_the_library_does():
    rng = random.Random(3)
    of = token_shards.Encoder(token_shards.VOCABULARY)
    texts = ["x\ty\tz a\n\n", "x\u00a0y a\n", "x\u3000y b  c", "x\ry\n", "one two", "one two ", " one two", "one\n two", "one \ntwo", "", "one", "one  two"]
    pieces = ["x", "one", "word,", "z.", "7", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\r", "  ", "\n\n"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    whole = [array("H", x.ids).tobytes() for x in of.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time all words are known
        for k in range(0, len(texts), 200):
            assert of.encode(texts[k : k + 200]) == whole[k : k + 200]


def test_thumbnail_hash_reads_every_sample():
    for high, wide in ((1, 1), (1, 3), (5, 7), (8, 8), (31, 17), (130, 126)):
        thumb = np.random.default_rng(high).integers(0, 256, (high, wide))
        cells = thumb.repeat(8, 0).repeat(8, 1).reshape(8, high, 8, wide).sum((1, 3))
        assert jpeg_media.thumbnail_hash(thumb) == np.packbits(cells.ravel() * 64 > cells.sum()).tobytes().hex()
        # Each sample alone decides in which cells the hash has a bit.
        for r, c in {(0, 0), (high // 3, wide // 2), (high - 1, wide - 1)}:
            one = np.zeros((high, wide), np.int64)
            one[r, c] = 255
            assert (jpeg_media.thumbnail_hash(one) != "0" * 16) == (high * wide > 1)


def test_images_are_nearly_square():
    for n in (1, 500, 20_000, 1_000_000):
        image = jpeg_media.parse(jpeg_media.encode(b"a" * n))
        assert image["width"] <= image["height"] + 8 <= image["width"] + 32
    # Texts of one size that differ in a part that a stride of the thumbnail would not meet.
    text = bytearray(b"a" * 64 * 900)
    other = text.copy()
    for k in range(64, 64 * 13, 64):
        other[k] = ord("z")
    assert jpeg_media.decode([jpeg_media.encode(bytes(text))])[0][2] != jpeg_media.decode([jpeg_media.encode(bytes(other))])[0][2]


def test_every_language_is_learned_from_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 100)
    words = [f"{a}{b}{a}{a}{b}" for a in "bcdfghklm" for b in "aeiou"] + [f"{b}{a}{a}{b}" for a in "bcdfghklm" for b in "aeiou"]
    langs = {f"l{k:02}": w for k, w in enumerate(words[:70])}
    # The last language is the rarest, and its letters come after more than 8,000 other characters.
    rows = [(k * 1000 + j, " ".join([w] * 30), x) for k, (x, w) in enumerate(langs.items()) for j in range(8)]
    rows += [(10**6 + j, "1 " * 5000 + "quüx " * 100, "late") for j in range(6)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted([*langs, "late"])
    texts = [*(" ".join([w] * 30) for w in langs.values()), "quüx " * 100]
    best = model.scores([language_id.clean(t) for t in texts]).argmax(1)
    assert [model.languages[k] for k in best] == [*langs, "late"]


def test_a_language_with_one_text_is_learned(monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 50)
    model = language_id.train(["quüx " * 50 if k == 4 else "aba " * 50 for k in range(30)], ["b" if k == 4 else "a" for k in range(30)])
    assert model.languages[model.scores([language_id.clean("quüx " * 50)]).argmax()] == "b"


def test_a_sample_keeps_every_label_at_its_bound(spark):
    rows = [(k, f"l{k % 100:02}") for k in range(20_000)] + [(10**6, "rare")]
    got = sampling.sampled(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", 5, labels=None).groupBy("lang").count().collect()
    assert len(got) >= 99 and "rare" in {r["lang"] for r in got} and sum(r["count"] for r in got) <= 505


def test_attention_learns_from_late_passages(spark):
    good = "the quiet river ran past the old mill and on to the sea " * 500  # over 20,000 characters
    bad = "$$ ## %% && || << >> " * 300
    rows = [(k, good + (bad if k % 2 else good[: len(bad)])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)], "doc_id long, quality int")
    got = quality_mil.score(docs, quality_mil.fit(docs, labels)).collect()
    assert min(r["score"] for r in got if r["doc_id"] % 2 == 0) > max(r["score"] for r in got if r["doc_id"] % 2)
