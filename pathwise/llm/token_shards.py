"""Token-id files under Re-Pair grammar compression, with random access.

Documents in ascending doc_id order are encoded, an end id closes each, and shards of about `SHARD_TOKENS` ids are
compressed on their own: frequent pairs of neighbouring ids are replaced by nonterminals, round after round, until no
pair pays for its rule or a shard's 16-bit ids are used up. A round counts all pairs of the shard and replaces the most
frequent ones together; where occurrences overlap, the more frequent pair wins, and a pair left with too few waits. A shard's record holds its rules with
the lengths they expand to, its symbols, and for each document where its symbols and its ids begin, so one document
(`Shard.document`) or any run of ids (`Shard.ids`) is decoded without the rest.

Encoding is the tokenizers library's: a text is cut at single blanks and line breaks between words, where this
vocabulary's own splitting always cuts; each different piece is encoded by the library once and kept by a worker, and a text
with any other white space, wherever it stands, is encoded whole.

Defined cases: a null or empty text has the end id alone; a text of any length lies in one shard; a null doc_id comes
before all others; rows that share a doc_id follow each other in order of their texts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.bpe_codec import vocabulary_path
from pathwise.llm.common import table, text_of, written

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
SHARD_TOKENS = 400_000
#: Pairs replaced together in a round, and the least occurrences that pay for a rule: it takes 8 bytes, a replacement saves 2.
PAIRS, LEAST = 2048, 5
#: Slots of a worker's table of pieces, the most ids of a piece in it, and bytes encoded at a time.
SLOT_BITS = 20
SLOTS, INLINE, TOGETHER = 1 << SLOT_BITS, 8, 1 << 20
#: Unicode white space but for blanks and line breaks, and where these don't stand single between words.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBLE = "  ", " \n", "\n ", "\n\n"
#: How the vocabulary writes a blank at the start of a token, and marks that end a word.
BLANK, MARKS = "\u0120", ",.;:"

#: Bytes up to which a piece is its own name in the table; longer ones are looked up as bytes, kept up to `LONG_BYTES` and `LONG` of them.
NAMED, LONG_BYTES, LONG = 16, 64, 1 << 15
#: What is kept of eight bytes of which the first k belong to a piece.
KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Texts to ids, by pieces: a word after a blank, or one at the start of a text or after a line break, by which its ids
    differ. A worker keeps pieces of up to `NAMED` bytes and `INLINE` ids in a table by hash, in which a later piece takes
    an older one's slot. The table holds a piece's bytes themselves, its length and what it follows, so that only equal
    pieces agree."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        tokens = self.tokenizer.get_vocab()
        self.begins = {" ": np.zeros(self.size, bool), "\n": np.zeros(self.size, bool)}  # ids whose token begins with it
        for token, k in tokens.items():
            self.begins[" "][k] = token[:1] == BLANK
        *marks, line_break = (self._encode([x])[0] for x in [*MARKS, "\n"])
        self.mark, self.line_break = np.zeros(256, np.uint16), line_break[0]
        self.mark[[ord(x) for x in MARKS]] = [x[0] for x in marks]
        self.begins["\n"][self.line_break] = True
        self.names = np.zeros((SLOTS, 3), np.uint64)
        self.ids, self.count = np.zeros((SLOTS, INLINE), np.uint16), np.zeros(SLOTS, np.int64)
        self.long: dict[tuple[bytes, bool], np.ndarray] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint16) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each after `between`, and where each word's begin: encoded as one text and cut where a
        token begins with `between`."""
        ids = np.concatenate([np.zeros(0, np.uint16), *(self._encode([between + between.join(words[k : k + 5000])])[0] for k in range(0, len(words), 5000))])
        return ids, np.append(np.flatnonzero(self.begins[between][ids]), len(ids))

    def _named(self, raw: bytes, lo: np.ndarray, hi: np.ndarray, after_blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names of the pieces (their first 16 bytes as two integers; length and what stands before) and a hash of each
        name. Of a longer piece the name is that of its beginning."""
        at_any = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8 + NAMED), 0, (1,))  # the eight bytes from any place on
        size = hi - lo
        names = np.empty((len(lo), 3), np.uint64)
        names[:, 0] = at_any[lo] & KEPT[np.minimum(size, 8)]
        names[:, 1] = at_any[np.minimum(lo + 8, len(raw))] & KEPT[np.clip(size - 8, 0, 8)]
        names[:, 2] = (size.astype(np.uint64) << np.uint64(1)) | after_blank
        x = (names[:, 0] + names[:, 2]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29)) ^ names[:, 1]) * np.uint64(0x94D049BB133111EB)
        return names, (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)

    def _long_pieces(self, pieces: list[tuple[bytes, bool]]) -> list[np.ndarray]:
        """The ids of pieces too long for the table, by their bytes and whether a blank stands before."""
        known = {x: self.long[x] for x in pieces if x in self.long}
        new = [x for x in dict.fromkeys(pieces) if x not in known]
        for after in (True, False):
            words = [x for x in new if x[1] == after]
            flat, begin = self._joined([x[0].decode() for x in words], " " if after else "\n")
            start = begin[:-1] + (not after)
            for word, a, b in zip(words, start.tolist(), begin[1:].tolist(), strict=True):
                known[word] = flat[a:b]
        if len(self.long) > LONG:
            self.long.clear()
        self.long.update((x, known[x].copy()) for x in new if len(x[0]) <= LONG_BYTES)
        return [known[x] for x in pieces]

    def _pieces(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of words between single blanks or line breaks, and how many each text has."""
        raw = b"\n" + b"\n".join(bodies) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        space = np.flatnonzero((data == 32) | (data == 10))
        lo, hi = space[:-1] + 1, space[1:].copy()
        heads = np.cumsum([1, *(len(x) + 1 for x in bodies[:-1])])
        first = np.searchsorted(lo, heads)
        before = data[space[:-1]] == 10
        before[first] = False  # line breaks of their own
        after_blank = data[space[:-1]] == 32
        # A letter before a closing mark ends a piece of this vocabulary's splitting.
        closed = (self.mark[data[hi - 1]] > 0) & (((data[hi - 2] | 32) - ord("a")) < 26) & (hi - lo > 1)
        hi -= closed
        names, hashes = self._named(raw, lo, hi, after_blank)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        ids, count = self.ids[slot], self.count[slot]
        missing = np.flatnonzero((count == 0) | (self.names[slot] != names).any(1))
        _, some, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        alone = (hi[missing] - lo[missing] > NAMED) | (names[missing] != names[missing[some[which]]]).any(1)  # or another piece has the hash
        beyond, missing = missing[alone], missing[~alone]
        long: list[tuple[np.ndarray, np.ndarray]] = []
        if len(beyond):
            spans = zip(lo[beyond].tolist(), hi[beyond].tolist(), after_blank[beyond].tolist(), strict=True)
            for k, own in zip(beyond.tolist(), self._long_pieces([(raw[a:b], after) for a, b, after in spans]), strict=True):
                count[k] = len(own)
                if len(own) <= INLINE:
                    ids[k, : len(own)] = own
                else:
                    long.append((np.array([k]), own))
        if len(missing):
            _, some, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            some = missing[some]
            for between in (" ", "\n"):
                new = np.flatnonzero(after_blank[some] == (between == " "))
                words = [raw[a:b].decode() for a, b in zip(lo[some[new]].tolist(), hi[some[new]].tolist(), strict=True)]
                flat, begin = self._joined(words, between)
                start, n = begin[:-1] + (between == "\n"), np.diff(begin) - (between == "\n")
                inline = np.zeros((len(new), INLINE), np.uint16)
                for k in range(INLINE):
                    has = n > k
                    inline[has, k] = flat[start[has] + k]
                ids_new, at = inline, some[new]
                fits = n <= INLINE
                self.names[slot[at[fits]]], self.ids[slot[at[fits]]], self.count[slot[at[fits]]] = names[at[fits]], ids_new[fits], n[fits]
                place = np.full(len(some), -1)
                place[new] = np.arange(len(new))
                mine = place[which] >= 0
                to, of = missing[mine], place[which][mine]
                ids[to], count[to] = ids_new[of], n[of]
                long += [(to[of == k], flat[start[k] : start[k] + n[k]]) for k in np.flatnonzero(~fits)]
        # A row is a line break of its own, the piece's ids and a closing mark, of which the mask has what there is.
        rows, there = np.empty((len(lo), INLINE + 2), np.uint16), np.empty((len(lo), INLINE + 2), bool)
        rows[:, 0], rows[:, 1:-1], rows[:, -1] = self.line_break, ids, self.mark[data[hi]]
        there[:, 0], there[:, -1] = before, closed
        np.less(np.arange(INLINE), np.where(count > INLINE, 0, count)[:, None], out=there[:, 1:-1])
        total = count + before + closed
        out = rows[there]
        if long:
            ends = np.cumsum(total)
            short, out, rest = out, np.empty(int(ends[-1]), np.uint16), np.ones(int(ends[-1]), bool)
            at = ends - total + before
            for which, whole in long:
                for k in at[which].tolist():
                    out[k : k + len(whole)], rest[k : k + len(whole)] = whole, False
            out[rest] = short
        return out, np.add.reduceat(total, first)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit integers."""
        whole = [k for k, x in enumerate(texts) if is_odd(x)]
        out: list = [None] * len(texts)
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            out[k] = ids.tobytes()
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            flat, lengths = self._pieces([x for _, x in held])
            ends = np.cumsum(lengths).tolist()
            for (k, _), a, b in zip(held, [0, *ends[:-1]], ends, strict=True):
                out[k] = flat[a:b].tobytes()
            held.clear()

        for k, text in enumerate(texts):
            if out[k] is None:
                held.append((k, text.encode()))
                size += len(held[-1][1])
                if size > TOGETHER:
                    flush()
                    size = 0
        if held:
            flush()
        return out


def is_odd(text: str) -> bool:
    """Whether a text can't be cut at its blanks and line breaks: there is other white space, some stand together or at an
    end, or a special token may be spelled out."""
    return text[:1] in ("", " ", "\n") or text[-1] in " \n" or "<|" in text or any(x in text for x in DOUBLE) or any(x in text for x in OTHER_SPACE)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def compress(ids: np.ndarray, first: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and where each document begins among the symbols, for `ids` whose documents begin
    at `first`. Symbols from `base` on are rules; no rule crosses documents. Each round sorts the pairs to count them."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    begins = np.zeros(len(seq), bool)
    begins[first] = True
    is_left, is_right = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    while len(seq) > 1 and len(rules) < (1 << 16) - base:
        packed = (seq[:-1] << np.uint32(16)) | seq[1:]
        ordered = np.sort(packed[~begins[1:]])
        edges = np.flatnonzero(ordered[LEAST - 1 :] == ordered[: len(ordered) - LEAST + 1])  # inside runs of LEAST or more
        if not len(edges):
            break
        at = edges[np.concatenate([[True], ordered[edges[1:]] != ordered[edges[:-1]]])]
        chosen, counts = ordered[at], np.searchsorted(ordered, ordered[at], "right") - at
        if len(chosen) > PAIRS:
            most = np.argsort(-counts, kind="stable")[:PAIRS]
            most.sort()
            chosen, counts = chosen[most], counts[most]
        rank = np.empty(len(chosen), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(chosen))
        is_left[:], is_right[:] = False, False
        is_left[chosen >> np.uint32(16)], is_right[chosen & np.uint32(0xFFFF)] = True, True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]] & ~begins[1:])
        where = np.searchsorted(chosen, packed[at])
        where[where == len(chosen)] = 0
        hit = chosen[where] == packed[at]
        at, rank = at[hit], rank[where[hit]]
        # of occurrences that overlap the more frequent pair wins, of one pair's the first
        while True:
            over = np.flatnonzero(np.diff(at) == 1)
            if not len(over):
                break
            ahead = rank[over] <= rank[over + 1]
            lost = np.zeros(len(at), bool)
            lost[over[~ahead]] = True
            lost[over[ahead] + 1] = True
            # one that lost to another that lost too may come again
            at, rank = at[~lost], rank[~lost]
        uses = np.bincount(rank, minlength=len(chosen))
        paying = np.flatnonzero(uses >= LEAST)[: (1 << 16) - base - len(rules)]
        if not len(paying):
            break
        name = np.full(len(chosen), -1)
        name[paying] = np.arange(len(paying))
        name = name[rank]
        at, name = at[name >= 0], name[name >= 0]
        new = np.zeros((len(paying), 2), np.uint32)
        new[name, 0], new[name, 1] = seq[at], seq[at + 1]
        seq[at] = (base + len(rules) + name).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, begins = seq[keep], begins[keep]
        rules = np.concatenate([rules, new])
    return seq.astype(np.uint16), rules.astype(np.uint16), np.flatnonzero(begins)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to. A rule refers to ids and to rules of earlier rounds; each pass takes the rules
    whose parts are known."""
    out = np.ones(base + len(rules), np.int64)
    known = base
    while known < len(out):
        later = np.flatnonzero((rules[known - base :] >= known).any(1))
        upto = known + int(later[0]) if len(later) else len(out)
        out[known:upto] = out[rules[known - base : upto - base]].sum(1)
        known = upto
    return out[base:]


def pack(ids: np.ndarray, lengths: np.ndarray, doc_first: np.ndarray, base: int) -> bytes:
    """One shard's record: head, rules, expansion lengths, first symbol and first id of each document, symbols."""
    symbols, rules, starts = compress(ids, doc_first, base)
    head = np.array([base, len(lengths), len(rules), len(symbols), int(lengths.sum())], "<i8")
    return b"".join(x.tobytes() for x in (head, rules.astype("<u2"), rule_lengths(rules, base).astype("<u4"), starts.astype("<u4"), doc_first.astype("<u4"), symbols.astype("<u2")))


class Shard:
    """Reads one record."""

    def __init__(self, record: bytes):
        self.base, docs, rules, symbols, self.n = (int(x) for x in np.frombuffer(record, "<i8", 5))
        at = 40
        self.rules = np.frombuffer(record, "<u2", 2 * rules, at).reshape(-1, 2)
        self.wide = np.frombuffer(record, "<u4", rules, at := at + 4 * rules).astype(np.int64)
        self.starts = np.frombuffer(record, "<u4", docs, at := at + 4 * rules).astype(np.int64)
        self.first = np.frombuffer(record, "<u4", docs, at := at + 4 * docs).astype(np.int64)
        self.symbols = np.frombuffer(record, "<u2", symbols, at + 4 * docs)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), self.wide])
        self.offset = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.wide) - self.wide])
        self.flat = np.empty(self.base + int(self.wide.sum()), np.uint16)
        self.flat[: self.base] = np.arange(self.base)
        known, written_ = self.base, self.base
        while known < len(self.lengths):  # what each rule expands to, all rules of a round at once
            rest = self.rules[known - self.base :]
            later = np.flatnonzero((rest >= known).any(1))
            upto = known + int(later[0]) if len(later) else len(self.lengths)
            ids = self.expand(rest[: upto - known].ravel())
            self.flat[written_ : written_ + len(ids)] = ids
            known, written_ = upto, written_ + len(ids)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        wide = self.lengths[symbols]
        ends = np.cumsum(wide)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.offset[symbols] - (ends - wide), wide) + np.arange(total)]

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        return self.expand(self.symbols[self.starts[k] : end])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the shard: documents before are skipped by their first id, symbols by their lengths."""
        k = int(np.searchsorted(self.first, start, "right")) - 1
        ends = self.first[k] + np.cumsum(self.lengths[self.symbols[self.starts[k] :]])
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - (int(ends[lo - 1]) if lo else int(self.first[k]))
        return self.expand(self.symbols[self.starts[k] + lo : self.starts[k] + hi])[skip : skip + stop - start]


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """part, seq, n_docs, n_tokens, before (ids in the part's shards before), doc_ids and record of every shard, as a table in the shared folder. Shards in order
    of part and seq hold the documents in ascending doc_id order."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int"):
        raise ValueError("doc_id is to be an integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        names: list = []
        texts: list[bytes] = []
        held = before = 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // 2 for x in texts], np.int64)
            record = pack(np.frombuffer(b"".join(texts), "<u2"), lengths, np.cumsum(lengths) - lengths, of.size)
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([record], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_docs", "n_tokens", "before", "doc_ids", "record"])

        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for k in range(0, len(rows), 200):
                for name, encoded in zip(ids[k : k + 200], of.encode(rows[k : k + 200]), strict=True):
                    names.append(name)
                    texts.append(encoded + end)
                    held += len(encoded) // 2 + 1
                    if held >= SHARD_TOKENS:
                        yield shard()
                        seq, before, held = seq + 1, before + held, 0
                        names.clear()
                        texts.clear()
        if names:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, before long, doc_ids array<bigint>, record binary"), "token-shards")


def _placed(shards: DataFrame) -> DataFrame:
    """`shards` with base, the number of ids in all shards before. There are at most as many parts as partitions of the
    writing shuffle, hence the window over them and the broadcast."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return shards.join(F.broadcast(parts), "part").withColumn("base", F.col("_before") + F.col("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, base = Shard(batch["record"][k].as_py()), batch["base"][k].as_py()
                ids = shard.expand(shard.symbols).astype("<u4")
                bounds = np.append(shard.first, shard.n).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                columns = [batch["doc_ids"][k].values, pa.array(shard.first + base), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(shards).select("base", "doc_ids", "record").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents")))
