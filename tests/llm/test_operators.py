"""Every operator on the defined cases, against brute force, round trips or held-out accuracy."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from pathwise.llm import bpe_codec, html_extract, jaccard_join, jpeg_media, language_id, mixing, quality_mil, quality_rules, suffix_dedup, token_shards, two_stage
from pathwise.llm.two_stage import Strings, common_prefixes, suffix_array
from tests.llm.fixtures import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def keyed(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def ordered(df):
    return sorted(rows_of(df), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


# 1 Re-Pair token shards


def test_shards_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_shards.VOCABULARY))
    docs = documents(spark)
    got = sorted(rows_of(token_shards.read_documents(token_shards.write_shards(docs))), key=lambda r: r["start"])
    start = 0
    for (doc_id, text), row in zip(keyed(docs), got, strict=True):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert row == {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)
    assert token_shards.read_documents(token_shards.write_shards(empty(spark))).count() == 0


def _thue_morse(n: int) -> tuple[str, str]:
    """Two words with equal sums of letters times powers of any odd base modulo 2^64."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_pieces_are_told_apart_by_their_bytes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_shards.VOCABULARY))
    rng = random.Random(8)
    piece = lambda: "".join(rng.choice("abcdeé1.,'😀-") for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 18, 70])))
    texts = [x for n in (1024, 2048, 4096) for a, b in [_thue_morse(n)] for x in (a, b, f"{a} {b}", f"{b}\n{a}")]
    texts += [rng.choice([" ", "\n"]).join(piece() for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    own = token_shards.Encoder(token_shards.VOCABULARY)
    clashing = token_shards.Encoder(token_shards.VOCABULARY)
    named = clashing._named
    monkeypatch.setattr(clashing, "_named", lambda *a: (named(*a)[0], named(*a)[1] & np.uint64(3 << 44)))  # all pieces in one slot, with four hashes
    for some in (texts, texts[::-1], texts[:12]):
        ids = [np.array(x.ids, "<u2").tobytes() for x in library.encode_batch(some, add_special_tokens=False)]
        assert own.encode(some) == ids and clashing.encode(some) == ids


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n, most in ((1, 5), (50, 2), (5000, 3), (60000, 40)):
        ids = rng.integers(0, most, n).astype(np.uint16)
        first = np.unique(np.concatenate([[0], rng.integers(0, n, 5)]))
        lengths = np.diff(np.append(first, n))
        record = token_shards.pack(ids, lengths, first, 50257)
        shard = token_shards.Shard(record)
        assert (shard.expand(shard.symbols) == ids).all()
        for k in range(len(first)):
            assert (shard.document(k) == ids[first[k] : first[k] + lengths[k]]).all()
        for _ in range(20):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a, n)) + 1
            assert (shard.ids(a, b) == ids[a:b]).all()
    assert len(record) < 2 * 60000  # fewer bytes than the ids themselves, even of random ids


def test_repair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(6)
    for base, n in ((50257, 30000), ((1 << 16) - 40, 30000), (200, 1000)):
        ids = np.minimum(rng.geometric(0.05, n), base - 1).astype(np.uint16)
        first = np.unique(np.concatenate([[0], rng.integers(0, n, 9)]))
        symbols, rules, starts = token_shards.compress(ids, first, base)
        bounds = [*starts.tolist(), len(symbols)]
        left = collections.Counter()
        for a, b in itertools.pairwise(bounds):
            pairs, k = symbols[a:b].tolist(), 0
            for k in range(len(pairs) - 1):
                left[pairs[k], pairs[k + 1]] += pairs[k] != pairs[k + 1]
        full = base + len(rules) == 1 << 16
        assert full == (base > 60000) and (full or max(left.values()) < token_shards.LEAST)
        counts = collections.Counter(symbols.tolist()) + collections.Counter(rules.ravel().tolist())
        assert all(counts[base + k] for k in range(len(rules)))


# 2 suffix arrays


def _brute_repeats(texts: list[bytes], length: int):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone, [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("near", [80, 3])
def test_two_stage_suffix_array(monkeypatch, near):
    monkeypatch.setattr(two_stage, "NEAR", near)
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([b"ab", b"a", b"abcdefgh", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(rng.randrange(1, 8))]
        of = Strings(strings + strings[:2])
        order = suffix_array(of)
        suffix = lambda p, of=of: of.raw[p : of.close[p]]
        assert order.tolist() == sorted(range(len(of.data)), key=lambda p: (suffix(p), of.close[p]))
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(suffix(a), suffix(b), strict=False)) if x != y), min(len(suffix(a)), len(suffix(b)))) for a, b in itertools.pairwise(order)]
        assert common_prefixes(of, order).tolist() == shared


def test_suffixes_of_a_long_repeat_are_not_laid_out_each():
    """Groups of suffixes moved on by a few bytes have one order: a long repeat costs one comparison, not one for each start."""

    class Counted(bytes):
        cuts = 0

        def __getitem__(self, at):
            Counted.cuts += 1
            return bytes.__getitem__(self, at)

    rng = random.Random(9)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    of = Strings([x + passage[:2990] + y for x, y in ((b"a", b"zz"), (b"bb", b"y"), (b"", b""), (b"c", b"zz"))] + [passage[1000:], b"ab" * 300, b"\0" * 90])
    ends = of.close
    at = np.setdiff1d(np.arange(len(of.data)), of.marks)
    order = two_stage._compared(Counted(of.raw), at, ends[at])
    assert at[order].tolist() == sorted(at.tolist(), key=lambda p: (of.raw[p : ends[p]], p))
    assert Counted.cuts < len(at) / 5


@pytest.mark.parametrize("hot", [192, 4])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = documents(spark)
    got = ordered(suffix_dedup.repeated_spans(docs))
    expected = list(_brute_repeats([t.encode() for _, t in keyed(docs)], 400))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(expected)
    assert sum(r["n_removed"] for r in got) > 0


def test_repeats_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage = word(700)
    texts = [word(rng.randrange(60)) + passage[rng.randrange(200) : rng.randrange(450, 700)] + word(rng.randrange(80)) for _ in range(60)]
    texts += ["ab" * rng.randrange(100, 400) for _ in range(4)] + [word(3000) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in ordered(suffix_dedup.repeated_spans(df))]
    assert got == list(_brute_repeats([t.encode() for t in texts], 400))


def test_the_suffix_array_decides():
    rng = random.Random(8)
    text = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    one, other = text(900), text(900)
    member = lambda off, n, c: {"off": off, "n": n, "a": 7, "c": c}
    chain = [{"g": 1, "o": 0, "members": [member(0, 200, 1), member(200, 301, 2)], "body": one}, {"g": 1, "o": 1, "members": [], "body": one}]
    assert sorted(suffix_dedup._compared(chain, 400)) == [(7, 1, 0, 200), (7, 2, 0, 301)]
    chain[1]["body"] = other  # were the hashes wrong, the bytes would tell
    assert suffix_dedup._compared(chain, 400) == []
    chain[1]["body"] = other[:50] + one[150:700] + other[:9]
    assert sorted(suffix_dedup._compared(chain, 400)) == [(7, 1, 150, 50), (7, 2, 0, 101)]


def test_remove_repeats_keeps_columns(spark):
    docs = documents(spark, clashing=True)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in rows_of(out)}
    assert texts[0] is None and texts[3] == "one" and texts[5] == "" == texts[6]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0 == suffix_dedup.repeated_spans(empty(spark)).count()


# 3 languages


def _language_rows(n: int):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "and", "th", "er"], "fr": ["eau", "é", "le", "oi", "ent"], "de": ["sch", "ung", "ü", "ein", "ie"]}
    for k in range(n):
        lang = ("en", "fr", "de")[k % 3]
        yield k, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang


def test_language_held_out(spark):
    rows = [*_language_rows(300), (1000, None, "en"), (1001, "123 ... !!", "en"), (1002, "", None), (None, "the and thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(language_id.predict(docs, language_id.fit(docs)))}
    aside = [k for k, _, _ in rows[:300] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in aside) for k, _, _ in rows[:300])
    assert sum(got[k]["lang_pred"] == rows[k][2] for k in aside) >= 0.95 * len(aside)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1001]["score"] == 0
    assert got[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    none = empty(spark)
    assert language_id.fit(none) is None and language_id.predict(none, None).count() == 0
    unlabelled = rows_of(language_id.predict(documents(spark, clashing=True), None))
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_language_scores_by_plain_loops(spark):
    docs = spark.createDataFrame(list(_language_rows(200)), "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    very_long = "the ing and " * 40_000
    texts = ["the ing", "a", "é", "Schön IST 3 die-Welt!", "the the the", very_long]
    rows = [(k, t, None) for k, t in enumerate([*texts, *texts])]  # repeated rows
    got = {r["doc_id"]: r for r in rows_of(language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model))}
    for k, text in enumerate(texts):
        kept = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text)
        data = b" " + b" ".join(kept.encode().split()) + b" "
        counts: collections.Counter = collections.Counter()
        for order in (2, 3, 4):
            for i in range(len(data) - order + 1):
                counts[((int.from_bytes(data[i : i + order], "big") + order) * 0x9E3779B1 % 2**32) >> 18] += 1
        total = sum(counts.values())
        logits = [(sum(float(model.table[row, j]) * n for row, n in counts.items()) / total + model.bias[j]) / model.temperature for j in range(len(model.languages))]
        top = max(logits)
        p = [math.exp(x - top) for x in logits]
        best = max(range(len(p)), key=p.__getitem__)
        for row in (got[k], got[k + len(texts)]):
            assert row["lang_pred"] == model.languages[best] and abs(row["score"] - p[best] / sum(p)) < 1e-4
            assert row["accepted"] == (row["score"] >= model.threshold)


# 4 byte-level BPE


def test_bpe_matches_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe_codec.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, clashing=True)
    got = sorted((r["ids"], r["decoded"], r["n_tokens"]) for r in rows_of(bpe_codec.decode(bpe_codec.encode(docs))))
    expected = sorted((np.array(ids := library.encode_ordinary(t), "<u4").tobytes(), t.encode(), len(ids)) for _, t in keyed(docs))
    assert [(bytes(a), bytes(b), n) for a, b, n in got] == expected
    once = sorted((bytes(r["ids"]), bytes(r["decoded"]), r["n_tokens"]) for r in rows_of(bpe_codec.round_trip(docs)))
    assert once == expected
    of, rng = bpe_codec.codec(bpe_codec.RANKS), random.Random(4)
    for text in ["ab" * 5000, "theth" * 3000, "".join(rng.choice("abeinrst") for _ in range(30000)), *("".join(rng.choices("abeinrst é\n1'", k=rng.randrange(30))) for _ in range(2000))]:
        assert np.frombuffer(of.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert bpe_codec.encode(empty(spark)).count() == 0


# 5 pages


def test_pages(spark):
    beside = '<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice"><p>we use cookies for long reasons told at length</p></div>'
    page = lambda text, k: f'<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body>{beside}<div class="post-{k}"><h1>Head &amp; line</h1><p>{text}<br>two<p>three</div><section class="comments"><p>a very long reader comment that goes on and on and on</p></section><footer>f</footer>'
    rows = [(k, f"http://h.example.com/{k}", page("word " * 30, k)) for k in range(6)]
    rows += [(10, None, "plain <b>text</b>"), (11, "http://h.example.com/z", None), (12, "not a url", ""), (13, "http://h.example.com/y", "<p>only &lt;this&gt;"), (0, rows[0][1], rows[0][2])]
    out = rows_of(html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    texts = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    assert all(texts[k] == "Head & line\n\n" + "word " * 30 + "two\n\nthree" for k in range(6))
    assert (texts[10], texts[11], texts[12], texts[13]) == ("plain text", "", "", "only <this>")
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _plain_text(page: str) -> list[str]:
    """Blocks of well-formed pages by Python's own parser, without elements that are known by tag."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        out, run, skip, articles = None, "", 0, 0

        def handle_starttag(self, tag, attrs):
            self.flush(tag)
            own = tag == "header" and self.articles > 0  # the article's own
            self.skips.append((tag in html_extract.ASIDE_TAGS and not own) or tag in html_extract.RAW)
            self.skip += self.skips[-1]
            self.articles += tag == "article"

        def handle_endtag(self, tag):
            self.flush(tag)
            self.skip -= self.skips.pop()
            self.articles -= tag == "article"

        def handle_data(self, data):
            if not self.skip:
                self.run += data

        def flush(self, tag=None):
            if tag is None or tag in html_extract.BLOCKS:
                if self.run.split():
                    self.out.append(" ".join(self.run.split()))
                self.run = ""

    reader = Reader()
    reader.out, reader.skips = [], []
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.out


def test_pages_against_another_parser():
    rng = random.Random(12)
    words = lambda: " ".join(rng.choice(["alpha", "beta &amp; more", "gamma", "d&eacute;j&agrave;", "x\n y"]) for _ in range(rng.randrange(1, 9)))

    def element(depth: int) -> str:
        tag = rng.choice("div section article ul p h2 blockquote table nav footer aside header script span b".split())
        inner = "".join(rng.choice([words, lambda: element(depth - 1) if depth and tag not in ("p", "h2", "span", "b", "script") else words()])() for _ in range(rng.randrange(1, 4)))
        inner = {"ul": f"<li>{inner}</li>", "table": f"<tr><td>{inner}</td></tr>"}.get(tag, inner)
        return f"<{tag} class='c{rng.randrange(3)}'>{inner}</{tag}>"

    for _ in range(300):
        page = "<html><body>" + "".join(element(4) for _ in range(4)) + "</body></html>"
        assert html_extract.extract(page, None, None).split("\n\n") == (_plain_text(page) or [""])


def test_pages_of_any_shape_take_linear_time():
    n = 30_000
    for page in ("<p>" + "<b>" * n + "x", "<div>" * n + "x", "<a " * 300_000, "<a '" * n + "<b \"" * n, "<span>" * n + "<h1>x" * n, "<noscript>" * n + "x", "<li>" * n, "<div class=c>x" * n, "<ul><li>" * n + "x", "<!--" * n, "<b></div></i>" * n):
        began = time.process_time()
        text, seen = html_extract.extract(page, 1, [2]), html_extract.votes(page)
        assert time.process_time() - began < 6, page[:20]
        assert text.count("x") == page.count("x") and len(seen) <= n


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_pages_by_consensus(spark, monkeypatch, sent):
    monkeypatch.setattr(html_extract, "SENT_BYTES", sent)
    words = lambda k, n: " ".join(f"word{k}a{j}" for j in range(n))
    lines, rows = {}, []
    for k in range(8):  # the lead, unequal sections, a long list and a table belong to the article; what repeats does not
        parts = [words(k, 4), words(k + 100, 30), words(k + 200, 80), *[words(k + 300 + j, 9) for j in range(5)], words(k + 400, 6)]
        lines[k] = parts
        listed = "".join(f"<li>{x}</li>" for x in parts[3:8])
        body = f"<article><h1>{parts[0]}</h1><p>{parts[1]}</p><section class='s{k}'><p>{parts[2]}</p></section><section><ul>{listed}</ul></section><table><tr><td>{parts[8]}</td></tr></table></article>"
        rows.append((k, f"http://a.example/{k}", f"<body><div class='box'>Always the same words here, on every page of the host.</div><div class='links'><a href=x>{words(k, 9)}</a></div>{body}<div class='box2'><p>And these.</p></div></body>", "x"))
    for k in range(8, 12):  # another template of the same host
        lines[k] = [words(k, 50)]
        rows.append((k, f"http://A.example/{k}", f"<div class='story'><p>{words(k, 50)}</p></div><div class='sidebar'>{words(k + 500, 90)}</div>", "x"))
    for k in range(12, 16):  # a host whose texts stand in an element named like a banner
        lines[k] = [words(k + 600, 3), words(k, 50)]
        rows.append((k, f"http://d.example/{k}", f"<h1>{words(k + 600, 3)}</h1><div class='banner-story'><p>{words(k, 50)}</p></div><div class='sidebar'>{words(k + 500, 9)}</div>", "x"))
    rows += [rows[0], rows[0], rows[0], (None, "http://b.example/", "<p>alone</p>", "x"), (20, "http://c.example/", "<p>" + "long text " * 100_000, "x")]
    out = rows_of(html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host_key string")))
    texts = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and texts[None] == "alone" and texts[20] == ("long text " * 100_000).strip()
    assert {k: texts[k].split("\n\n") for k in lines} == lines


def test_whole_articles_stay(spark):
    """Pages inside a form, an article's own header, formulas, and names whose words have other uses."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    form = lambda k: f"<body><form action=x><div class='nav-bar'>menu</div><h1>{words(k, 3)}</h1><p>{words(k, 40)}</p><input><select><option>no</select></form></body>"
    assert all(html_extract.extract(form(k), None, None) == f"{words(k, 3)}\n\n{words(k, 40)}" for k in range(3))
    assert html_extract.extract(f"<p>{words(1, 30)}</p><form><p>Your name</p></form>", None, None) == words(1, 30)
    rows = [(k, f"http://f.example/{k}", form(k)) for k in range(6)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"{words(k, 3)}\n\n{words(k, 40)}" for k in range(6)}
    page = f"<header>site</header><article><header class='entry-header'><h1>Title</h1><p>Lead.</p></header><p>{words(1, 9)}</p><footer>by us</footer></article><header>more</header>"
    assert html_extract.extract(page, None, None) == f"Title\n\nLead.\n\n{words(1, 9)}"
    assert html_extract.extract("<main><p>Since <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></main>", None, None) == "Since x=2 holds."
    for name in ("share-price", "notice-period", "alert-levels-explained", "related-party-rules", "commentary", "adsorption", "table-header-note"):
        assert html_extract.extract(f"<p>a</p><div class='{name}'>b</div>", None, None) == "a\n\nb", name
    for name in ("share", "share-buttons", "notice", "cookie-law-info", "related_posts", "comments", "comment-list-2", "ad", "ad-slot-3", "page-header", "main-menu", "top-banner", "x newsletter-signup"):
        assert html_extract.extract(f"<p>a</p><div class='{name}'>b</div>", None, None) == "a", name


def _plain_host(pages: list[str]) -> tuple[set, set, set]:
    """Rejected, released and won paths of a host's pages, by loops over all votes."""
    votes, said, named = collections.Counter(), collections.defaultdict(dict), collections.Counter()
    seen_named, total = collections.defaultdict(set), 0
    for one in {(tuple(sorted(html_extract.votes(p))), n) for n, p in enumerate(pages)}:
        for path, score, what, page, is_named in one[0]:
            total += score
            if is_named:
                named[path] += score
                seen_named[path].add(page)
            else:
                votes[path] += score
                said[path].setdefault(what, set()).add(page)
    count = {p: sum(map(len, said[p].values())) for p in said}
    same = {p for p in said if max(map(len, said[p].values())) >= 3 and 2 * max(map(len, said[p].values())) > count[p]}
    free = {p: votes[p] for p in said if p not in same}
    first = max(free or votes, key=lambda p: (votes[p], p))
    won = {p for p, n in free.items() if n and (100 * n >= max(free.values()) or 2 * count[p] >= max(count.values()))}
    return same - {first}, {p for p, n in named.items() if len(seen_named[p]) >= 3 and 2 * n > total}, won if max(count.values()) >= 3 else None


def test_votes_select_paths_against_a_loop(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(99)) for _ in range(n))
    hosts = {}
    for h in range(6):
        pages = []
        for k in range(rng.choice([2, 5, 9])):
            stray = f"<div class='stray{chr(97 + k)}'>{text(1)}</div>" if k == 1 else ""
            side = f"<div class='box'>{'Same words.' if h % 2 else text(3)}</div>" if rng.random() < 0.8 else ""
            pages.append(f"<body>{side}<div class='title'>{text(2)}</div><div class='story'><p>{text(60)}</p><ul class='in'><li>{text(2)}</ul></div>{stray}<div class='sidebar'>{text(rng.choice([3, 400]))}</div></body>")
        hosts[f"h{h}.example"] = pages
    rows = [(n, f"http://{host}/{k}", page) for host, pages in hosts.items() for n, (k, page) in enumerate([*enumerate(pages), (0, pages[0])])]
    got = {r["host_key"]: r for r in html_extract.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    dropped = 0
    for host, pages in hosts.items():
        rejected, released, won = _plain_host([*pages, pages[0]])
        r = got[host]
        assert (set(r["rejected"]), set(r["released"]), r["won"] and set(r["won"])) == (rejected, released, won)
        for page in pages:
            text_ = html_extract.extract(page, r["path"], r["rejected"], r["released"], r["won"])
            whole = html_extract.extract(page, r["path"], r["rejected"], r["released"])
            dropped += text_ != whole
            assert ("stray" in page and won is not None) or text_ == whole
    assert dropped


# 6 quality


def test_quality_held_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(5))
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(rng.randrange(5, 300)))
        rows.append((k, text))
        labels.append((k, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(quality_mil.score(docs, quality_mil.fit(docs, known)))}
    aside = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k]["predicted"] == labels[k][1] for k in aside) >= 0.95 * len(aside)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows)
    assert quality_mil.fit(docs, known.limit(0)) is None
    assert {r["score"] for r in rows_of(quality_mil.score(documents(spark, clashing=True), None))} == {0.5}
    assert quality_mil.score(empty(spark), None).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, begins = quality_mil.features(["a b c " * 60, "", "LOUD!! " * 90, "x | y"])
    sizes = {"W": (quality_mil.FEATURES, quality_mil.WIDTH), "V": (quality_mil.WIDTH, quality_mil.GATE), "U": (quality_mil.WIDTH, quality_mil.GATE), "w": (quality_mil.GATE,), "c": (quality_mil.WIDTH,), "b": (quality_mil.WIDTH,), "d": ()}
    p, y = {k: rng.normal(0, 0.3, v) for k, v in sizes.items()}, np.array([1, 0, 0, 1.0])
    grads = quality_mil._gradients(p, x, begins, y)
    loss = lambda q: np.mean(np.log1p(np.exp(z := quality_mil._forward(q, x, begins)["logit"])) - y * z)
    for name in p:
        move = rng.normal(0, 1, sizes[name])
        slope = (loss(p | {name: p[name] + 1e-6 * move}) - loss(p | {name: p[name] - 1e-6 * move})) / 2e-6
        assert abs(slope - float(np.sum(move * grads[name]))) < 1e-6


def test_quality_scores_by_plain_loops(spark):
    rng = np.random.default_rng(4)
    sizes = {"W": (quality_mil.FEATURES, quality_mil.WIDTH), "V": (quality_mil.WIDTH, quality_mil.GATE), "U": (quality_mil.WIDTH, quality_mil.GATE), "w": (quality_mil.GATE,), "c": (quality_mil.WIDTH,), "b": (quality_mil.WIDTH,), "d": ()}
    p = {k: rng.normal(0, 0.5, v) for k, v in sizes.items()}
    docs = documents(spark, clashing=True)
    got = collections.defaultdict(list)
    for r in rows_of(quality_mil.score(docs, p)):
        got[r["doc_id"]].append(r)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for doc_id, text in keyed(docs):
        words, seen, bag = text.split(), set(), []
        for k in range(0, max(1, len(words)), 64):
            part = words[k : k + 64]
            data = " ".join(part).encode()
            x = [0.0] * quality_mil.FEATURES
            kind = [int(quality_mil.CLASS_OF[b]) for b in data]
            for a, b in itertools.pairwise(kind):
                x[9 * a + b] += 1 / (len(data) - 1)
            for i in range(len(data) - 2):
                x[81 + ((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1 % 2**32) >> 24)] += 1 / (len(data) - 2)
            n, different = len(part), len(set(part))
            x[-6:] = [n / 64, different / max(1, n), len(set(part) - seen) / max(1, n), len(data) / max(1, n) / 10, float(n == 0), min(1, n / 8)]
            seen |= set(part)
            h = [math.tanh(sum(math.sqrt(v) * p["W"][i, j] for i, v in enumerate(x) if v) + p["b"][j]) for j in range(16)]
            gate = [math.tanh(sum(h[j] * p["V"][j, g] for j in range(16))) * sigmoid(sum(h[j] * p["U"][j, g] for j in range(16))) for g in range(8)]
            bag.append((math.exp(sum(a * b for a, b in zip(gate, p["w"], strict=True))), h))
        whole = sum(a for a, _ in bag)
        z = [sum(a * h[j] for a, h in bag) / whole for j in range(16)]
        expected = sigmoid(sum(z[j] * p["c"][j] for j in range(16)) + p["d"])
        assert min(abs(r["score"] - expected) for r in got[doc_id]) < 1e-4 and all(r["passages"] == len(bag) or len(got[doc_id]) > 1 for r in got[doc_id])


# 7 near duplicates


def _brute_classes(texts: dict):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links: dict = {k: set() for k in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            up[root(a)] = root(b)
            if sets[a] != sets[b]:
                links[a].add(sets[b])
                links[b].add(sets[a])
    least: dict = {}
    for k in sets:
        least[root(k)] = min(k, least.get(root(k), k))
    return {k: (least[root(k)], len(links[k])) for k in sets}


@pytest.mark.parametrize(("block", "wide"), [(384, 64), (5, 64), (384, 3), (7, 3)])
def test_near_duplicates(spark, monkeypatch, block, wide):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = {}
    for k in range(40):  # one loose group, so that links are not all of its pairs
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(200)] = word()
        texts[k] = " ".join(w)
    texts |= {100 + k: " ".join(base) for k in range(5)} | {200 + k: " ".join(word() for _ in range(80)) for k in range(10)}
    texts |= {300: None, 301: "", 302: "a b", 303: "a b", 304: "a b c"}
    df = spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string")
    got = rows_of(jaccard_join.near_duplicates(df))
    expected = _brute_classes(texts)
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == expected
    assert next(r["n_copies"] for r in got if r["doc_id"] == 101) >= 4
    kept = sorted(r["doc_id"] for r in rows_of(jaccard_join.drop_near_duplicates(df)))
    assert kept == sorted({c for c, _ in expected.values()})


def test_different_words_make_different_shingles(spark):
    """Words with equal sums of letters times powers stay different: neither copies nor links, and both documents stay."""
    for n in (1024, 4096):
        a, b = _thue_morse(n)
        assert set(jaccard_join.shingles(f"w x y z {a}").tolist()).isdisjoint(jaccard_join.shingles(f"w x y z {b}").tolist())
    shared = "one two three four five six seven"
    df = spark.createDataFrame([(k, f"{shared} {word}") for k, word in enumerate(_thue_morse(1024))], "doc_id long, text string")
    assert {(r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.near_duplicates(df).collect()} == {(0, 0, 0), (1, 0, 0)}
    assert jaccard_join.drop_near_duplicates(df).count() == 2
    rng = random.Random(3)
    words = list({"".join(rng.choice("ab") for _ in range(rng.choice([3, 8, 9, 16, 17, 40]))) for _ in range(4000)})
    assert len(set(jaccard_join._word_hashes(" ".join(words).encode()).tolist())) == len(words)
    assert jaccard_join._word_hashes(b" a  a\taa\n").tolist()[:2] == jaccard_join._word_hashes(b"a a").tolist()


def test_recall_just_above_the_threshold(spark):
    """Pairs of 0.8 to 0.85 among texts of which many begin alike: all that brute force finds are linked."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(6))
    shared, texts = [word() for _ in range(40)], []
    for _ in range(150):
        own = shared + [word() for _ in range(160)]
        other = list(own)
        for at in rng.sample(range(45, 200), rng.choice([3, 4])):
            other[at] = word()
        texts += [" ".join(own), " ".join(other)]
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    ratio = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(sets), 2)]
    close = [k for k, x in enumerate(ratio) if 0.8 <= x <= 0.85]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = {r["doc_id"]: r["n_links"] for r in jaccard_join.near_duplicates(df).collect()}
    found = sum(links[2 * k] for k in close)
    assert len(close) > 40 and found >= 0.99 * len(close)
    assert sum(links.values()) <= 2 * sum(x >= 0.8 for x in ratio)


def test_near_duplicates_defined_cases(spark):
    docs = documents(spark, clashing=True)
    out = jaccard_join.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in rows_of(out)]
    assert ids.count(5) == 1 and 6 not in ids and {0, 1, 2, 3} <= set(ids) and None in ids
    assert jaccard_join.near_duplicates(docs).count() == docs.count()
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0 == jaccard_join.drop_near_duplicates(empty(spark)).count()


# 8 mixing


def test_mix(spark):
    docs = documents(spark, clashing=True)
    got = rows_of(mixing.mix(docs))
    sizes = collections.Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted((x for x in sizes if x is not None)) + [None]
    budget, capped = 1.5 * sum(sizes.values()), set()
    weights = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    while True:
        rest = [n for n in names if n not in capped]
        left = budget - sum(2 * sizes[n] for n in capped)
        level = left / sum(weights[n] for n in rest) if rest else 0
        over = {n for n in rest if level * weights[n] > 2 * sizes[n]}
        if not over:
            break
        capped |= over
    targets = {n: 2.0 * sizes[n] if n in capped else level * weights[n] for n in names}
    by_target = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    own = collections.defaultdict(list)
    for r in docs.select("source", "text").collect():
        own[r["source"]].append(len(WORD.findall(r["text"] or "")))
    for n in names:  # near the best that whole takes and a subset of the documents reach
        whole = int(targets[n] // sizes[n]) * sizes[n] if sizes[n] else 0
        sums = 1
        for size in own[n]:
            sums |= sums << size
        best = max(k for k in range(round(targets[n]) - whole + 1) if sums >> k & 1)
        assert whole + best - max(1, 0.02 * targets[n]) <= by_target[(sizes[n], round(targets[n], 6))] <= targets[n] + 1
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs))))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and sum(len(WORD.findall(r["text"])) for r in rows_of(out)) == sum(r["taken"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0 == mixing.mix_documents(empty(spark)).count()


def test_fit_counts_reaches_sums():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 300, 40))
        counts = rng.integers(1, 30, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 10))
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert min(budget, int((sizes * counts).sum())) - int((sizes * take).sum()) in range(0, 3)


def test_fit_counts_of_small_sources_against_all_sums():
    """Sources of a few documents: within one part in a thousand of the best sum that any choice reaches."""
    rng = np.random.default_rng(6)
    for _ in range(600):
        sizes = np.unique(np.maximum(1, (rng.pareto(1.1, rng.integers(2, 30)) * rng.choice([3, 40, 700])).astype(np.int64)))
        sizes = sizes[sizes < 20_000]
        if not len(sizes):
            continue
        counts = rng.integers(1, rng.choice([2, 4, 9]), len(sizes), endpoint=True)
        total = int((sizes * counts).sum())
        budget = int(rng.integers(1, total + 1))
        sums = 1
        for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
            for _ in range(count):
                sums |= sums << size
        best = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert best - budget / 1000 <= int((sizes * take).sum()) <= budget


def test_targets_of_many_sources(spark):
    """Against filling level by level, with sources that tie and one without words."""
    rng = random.Random(12)
    sizes = {(None if k == 0 else f"s{k:03d}"): rng.choice([0, 5, 10, 1000, 70_000]) for k in range(60)}
    rows = [("" if s is None else "=" + s, s, n) for s, n in sizes.items()]
    got = {r["skey"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "skey string, source string, source_size long").repartition(7)).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(got["" if s is None else "=" + s] - target[s]) < 1e-6 * max(1, target[s]) for s in order)


# 9 quality rules


def test_rules_against_brute_force(spark):
    docs = documents(spark, clashing=True)
    got = {(r["doc_id"], r["n_words"]): r for r in rows_of(quality_rules.apply_rules(docs))}
    for doc_id, text in keyed(docs):
        words = WORD.findall(text)
        seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[(doc_id, len(words))]
        assert (r["word_chars"], r["n_symbols"]) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows_of(quality_rules.apply_rules(docs)))
    assert quality_rules.apply_rules(empty(spark)).count() == 0 == quality_rules.keep_documents(empty(spark)).count()


def test_host_verdicts(spark):
    rows = [("good", k % 10 == 0) for k in range(200)] + [("bad", k % 10 != 0) for k in range(200)] + [("small", True), (None, False)] + [(f"h{k}", False) for k in range(20)]
    verdicts = {r["host_key"]: r for r in rows_of(quality_rules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")))}
    assert verdicts["good"]["host_kept"] and not verdicts["bad"]["host_kept"] and verdicts[None]["host_kept"]
    assert verdicts["small"]["host_rate"] < 1  # one failure is shrunk towards the other hosts


# 10 images


def test_images(spark):
    docs = documents(spark, clashing=True)
    got = rows_of(jpeg_media.read_images(jpeg_media.store_images(docs)))
    payloads = [jpeg_media.pad(t.encode()) for _, t in keyed(docs)]
    assert sorted((r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for p in payloads)
    assert sorted(r["n_bytes"] for r in got) == sorted(len(t.encode()) for _, t in keyed(docs))
    assert jpeg_media.store_images(empty(spark)).count() == 0
    by_payload = {r["payload_sha256"]: r for r in got}
    for _, text in keyed(docs):  # what is stored, bit by bit, and its thumbnail by plain loops
        if len(text) > 20_000:
            continue
        media = jpeg_media.encode(text.encode())
        image = jpeg_media.parse(media)
        (blocks,) = jpeg_media._decode_bits(image)
        assert (blocks == jpeg_media.decode_scans([jpeg_media.parse(media)])[0]).all()
        row = by_payload[hashlib.sha256(jpeg_media.pad(text.encode())).hexdigest()]
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        wide, high, step = image["width"] // 8, image["height"] // 8, int(image["quant"][0][0])
        samples = [[min(255, max(0, round(int(blocks[y * wide + x, 0]) * step / 8 + 128))) for x in range(wide)] for y in range(high)]
        cells = [sum(max(0, min((r + 1) * high, (y + 1) * 8) - max(r * high, y * 8)) * max(0, min((c + 1) * wide, (x + 1) * 8) - max(c * wide, x * 8)) * samples[y][x] for y in range(high) for x in range(wide)) for r in range(8) for c in range(8)]
        bits = "".join("1" if v * 64 > sum(cells) else "0" for v in cells)
        assert row["feature"] == f"{8 * wide}x{8 * high}:{int(bits, 2):016x}"


def test_lanes_read_any_scan_of_one_component():
    """Images of many sizes together, restarts or none, zero runs, ends of blocks, stuffed bytes; broken scans are refused."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("eeeeetaoin \u00e9\u20ac\U0001f600~") for _ in range(rng.choice([0, 5, 190, 700, 9000]))).encode() for _ in range(40)]
    media = [jpeg_media.encode(x) for x in texts]
    assert any(b"\xff\x00" in x for x in media) and any(b"\xff\xd7" in x for x in media)
    assert [(p, n) for p, n, _ in jpeg_media.decode(media)] == [(jpeg_media.pad(x), len(x)) for x in texts]
    assert jpeg_media.decode([]) == []
    dc, ac = [(2, 0), (2, 3), (3, 7)], [(1, 0x01), (3, 0x00), (3, 0x21), (4, 0xF0), (5, 0x14)]
    codes = {0: jpeg_media._canonical(dc), 1: jpeg_media._canonical(ac)}
    term = lambda t, s, amplitude="": format(codes[t][s][0], f"0{codes[t][s][1]}b") + amplitude
    blocks = [term(0, 3, "101") + term(1, 0x21, "1") + term(1, 0xF0) + term(1, 0x01, "0") + term(1, 0x14, "1111") + term(1, 0), term(0, 0) + term(1, 0x01, "1") * 63, term(0, 7, "1111111") + term(1, 0)]
    for restart in (0, 1, 2):
        parts = ["".join(blocks[k : k + (restart or 3)]) for k in range(0, 3, restart or 3)]
        coded = [int(x.ljust(-(-len(x) // 8) * 8, "1"), 2).to_bytes(-(-len(x) // 8), "big").replace(b"\xff", b"\xff\x00") for x in parts]
        scan = b"".join(x + (bytes([0xFF, 0xD0 + k]) if k + 1 < len(coded) else b"") for k, x in enumerate(coded))
        data = jpeg_media.HEAD + jpeg_media._dht(0, dc) + jpeg_media._dht(0x10, ac) + (jpeg_media._segment(0xDD, bytes([0, restart])) if restart else b"") + jpeg_media._segment(0xC0, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])) + jpeg_media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
        slow, (fast,) = jpeg_media._decode_bits(jpeg_media.parse(data))[0], jpeg_media.coefficients(jpeg_media.parse(data))
        assert (slow == fast).all() and fast[0, [0, 3, 20, 22]].tolist() == [5, 1, -1, 15] and fast[:, 0].tolist() == ([5, 0, 127] if restart == 1 else [5, 5, 127] if restart else [5, 5, 132])
        with pytest.raises(ValueError):
            jpeg_media.coefficients(jpeg_media.parse(data) | {"restart": 1 if restart != 1 else 0})
    for counts in ([3], [0, 1, 1, 2, 3, 5, 8, 13, 21], [5, 0, 0, 5]):
        table_ = jpeg_media.fitted_lengths(counts)
        assert [s for s, n in enumerate(counts) if n] == sorted(s for _, s in table_) and sum(2.0**-n for n, _ in table_) < 1


def test_scans_decode_alike_and_by_hand():
    for text in (b"", b"hello " * 70, "é€😀".encode() * 99, b"x" * (64 * 8192 * 3 + 5)):
        ((payload, n, _),) = jpeg_media.decode([jpeg_media.encode(text)])
        assert payload == jpeg_media.pad(text) and n == len(text)
    image = jpeg_media.parse(jpeg_media.encode(b"hello world " * 40))
    assert (jpeg_media._decode_bits(image)[0] == jpeg_media.decode_scans([image])[0]).all()
    assert len({length for length, _ in image["huffman"][0x10]}) > 1  # codes of several lengths
    # Two components, 2x1 sampling, restarts, zero runs: tables DC {0: "0", 2: "10"}, AC {EOB: "0", 0x21: "10"}.
    bits = lambda s: int(s.ljust(-(-len(s) // 8) * 8, "1"), 2).to_bytes(-(-len(s) // 8), "big")
    head = b"\xff\xd8" + jpeg_media._segment(0xDB, bytes([0] + [16] * 64)) + jpeg_media._dht(0, [(1, 0), (2, 2)]) + jpeg_media._dht(0x10, [(1, 0), (2, 0x21)])
    frame = bytes([8, 0, 8, 0, 32, 2, 1, 0x21, 0, 2, 0x11, 0])
    unit = "10" + "11" + "10" + "1" + "0" + "0" + "0" + "0" + "0"  # Y: dc 3, ac[3] = 1, end; Y: dc +0, end; C: dc 0, end
    data = head + jpeg_media._segment(0xDD, b"\0\1") + jpeg_media._segment(0xC0, frame) + jpeg_media._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + bits(unit) + b"\xff\xd0" + bits(unit) + b"\xff\xd9"
    image = jpeg_media.parse(data)
    y, c = jpeg_media.coefficients(image)
    assert y[:, 0].tolist() == [3, 3, 3, 3] and y[0, 3] == 1 and not c.any()
    assert jpeg_media.thumbnail(image, [y, c]).tolist() == [[134, 134, 134, 134]]
