"""Texts as baseline JPEG images: the coefficients are the payload, the DC terms the thumbnail.

A payload of whole 64-byte blocks becomes one grey baseline image. A block's first byte is its DC term (minus 128), the
other 63 are AC terms in zigzag order, mapped to the non-zero values up to 7 bits. Each image's Huffman tables are fitted
to its own terms, and a restart marker follows every `RESTART` blocks. That is an ordinary baseline file.

The reader parses the markers, takes out stuffed bytes, and decodes the restart intervals of all images of a batch side
by side: one lane each, a symbol of every lane at a time, by tables on the next bits (`decode_scans`). It reads any scan
of one component, with zero runs and without restarts, too; several components are read term by term. The luminance
thumbnail is rebuilt from the DC terms alone. Blocks are laid out nearly square, and the thumbnail's hash averages all of
its samples.

Defined cases: a null text is empty; an empty text is one unit of 192 spaces; a text of any length is one image; equal texts give equal files; an empty table gives an empty result;
other columns are ignored. Bytes that no UTF-8 text contains are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathwise.llm.common import slices, table, text_of, written

UNIT, BLOCK = 192, 64
#: The byte values that occur in UTF-8, in order; 0xC0, 0xC1 and 0xF5 to 0xFF never do.
USED = np.array([b for b in range(256) if b not in (0xC0, 0xC1) and b < 0xF5])


def _amplitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and amplitude bits of coefficients."""
    size = np.zeros(values.shape, np.int64)
    for k in range(12):
        size[np.abs(values) >= 1 << k] = k + 1
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def _canonical(table_: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) from (length, symbol) in file order."""
    codes, code, last = {}, 0, 0
    for length, symbol in table_:
        code <<= length - last
        codes[symbol] = (code, length)
        code, last = code + 1, length
    return codes


def fitted_lengths(counts: list[int]) -> list[tuple[int, int]]:
    """A Huffman table for symbols by their counts, as (length, symbol) in file order. A symbol more, the rarest, keeps the
    code of ones free, as the format asks."""
    heap = [(n, s, (s,)) for s, n in enumerate(counts) if n] + [(0, len(counts), (len(counts),))]
    heapq.heapify(heap)
    length = dict.fromkeys(range(len(counts) + 1), 0)
    while len(heap) > 1:
        (n, s, some), (m, t, more) = heapq.heappop(heap), heapq.heappop(heap)
        for k in some + more:
            length[k] += 1
        heapq.heappush(heap, (n + m, max(s, t), some + more))
    return sorted((length[s], s) for s, n in enumerate(counts) if n)


#: Fixed values of this format: categories of DC differences and AC terms, blocks between restart markers.
DC_SIZES, AC_SIZES, RESTART = 9, 8, 8
RANK = np.zeros(256, np.int64)
RANK[USED] = np.arange(len(USED))
#: Rank of a byte -> AC term: -121 to -1 and 1 to 122.
AC_VALUE = np.where(np.arange(len(USED)) < 121, np.arange(len(USED)) - 121, np.arange(len(USED)) - 120)
#: Category and amplitude bits of each byte as an AC term, and of each DC difference from -244 on.
AC_SIZE, AC_BITS = (np.zeros(256, np.int64) for _ in range(2))
AC_SIZE[USED], AC_BITS[USED] = _amplitude(AC_VALUE)
DC_SIZE, DC_BITS = _amplitude(np.arange(-244, 245))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, table_: list[tuple[int, int]]) -> bytes:
    lengths = [x for x, _ in table_]
    return _segment(0xC4, bytes([kind, *(lengths.count(k) for k in range(1, 17)), *(s for _, s in table_)]))


HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64))


def _codes(table_: list[tuple[int, int]], sizes: int) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(sizes, np.int64), np.zeros(sizes, np.int64)
    for s, (c, n) in _canonical(table_).items():
        code[s], length[s] = c, n
    return code, length


def _scan(words: np.ndarray, widths: np.ndarray) -> bytes:
    """The scan of terms (code and amplitude, and how many bits) in rows of one block: intervals padded with ones to whole
    bytes, stuffed, with restart markers between."""
    blocks = len(words)
    ends = np.cumsum(widths.ravel())
    last = np.minimum(np.arange(RESTART, blocks + RESTART, RESTART), blocks) * BLOCK - 1  # each interval's last term
    bits = np.diff(ends[last], prepend=0)
    size = -(-bits // 8)
    starts = 8 * (np.cumsum(size) - size)
    at = ends - widths.ravel() + np.repeat(starts - (ends[last] - bits), np.diff(last, prepend=-1))
    # A term is less than 32 bits wide: it lies in a word of 32 and the next. Sums below 2^32 are exact in doubles.
    word, spread = at >> 5, words.ravel() << (64 - widths.ravel() - (at & 31)).astype(np.uint64)
    n = int(size.sum() * 8 >> 5) + 2
    whole = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = whole.astype(np.uint32).astype(">u4").view(np.uint8)[: int(size.sum())].copy()
    byte_ends = np.cumsum(size)
    data[byte_ends - 1] |= ((1 << (8 * size - bits)) - 1).astype(np.uint8)
    full = data == 0xFF
    interval = np.repeat(np.arange(len(size)), size)
    to = np.arange(len(data)) + np.cumsum(full) - full + 2 * interval
    out = np.zeros(len(data) + int(full.sum()) + 2 * (len(size) - 1), np.uint8)
    out[to] = data
    marks = (to + full)[byte_ends[:-1] - 1] + 1
    out[marks], out[marks + 1] = 0xFF, 0xD0 + np.arange(len(size) - 1) % 8
    return out.tobytes()


def pad(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode(text: bytes) -> bytes:
    """The image of one text's padded payload; the text's length is in a comment segment."""
    payload = pad(text)
    blocks = len(payload) // BLOCK
    wide = isqrt(blocks)
    high = -(-blocks // wide)
    body = np.frombuffer(payload.ljust(wide * high * BLOCK), np.uint8).reshape(-1, BLOCK)
    if (body >= 0xF5).any() or ((body == 0xC0) | (body == 0xC1)).any():
        raise ValueError("the payload has bytes that no UTF-8 text contains")
    dc = np.diff(body[:, 0].astype(np.int64), prepend=128)
    dc[::RESTART] = body[::RESTART, 0].astype(np.int64) - 128  # prediction begins anew
    dc_table = fitted_lengths(np.bincount(DC_SIZE[dc + 244], minlength=DC_SIZES).tolist())
    byte_counts = np.bincount(body[:, 1:].ravel(), minlength=256)
    ac_table = fitted_lengths(np.bincount(AC_SIZE, byte_counts, AC_SIZES).astype(np.int64).tolist())
    words, widths = np.empty(body.shape, np.uint64), np.empty(body.shape, np.int64)
    code, length = _codes(dc_table, DC_SIZES)
    size = DC_SIZE[dc + 244]
    words[:, 0], widths[:, 0] = (code[size] << size) | DC_BITS[dc + 244], length[size] + size
    code, length = _codes(ac_table, AC_SIZES)
    words[:, 1:], widths[:, 1:] = ((code[AC_SIZE] << AC_SIZE) | AC_BITS).astype(np.uint64)[body[:, 1:]], (length[AC_SIZE] + AC_SIZE)[body[:, 1:]]
    frame = struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)
    tables = _dht(0x00, dc_table) + _dht(0x10, ac_table) + _segment(0xDD, struct.pack(">H", RESTART))
    return HEAD + tables + _segment(0xFE, b"%d" % len(text)) + _segment(0xC0, frame) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + _scan(words, widths) + b"\xff\xd9"


def parse(data: bytes) -> dict:
    """Markers of a baseline file: height, width, components, tables, restart interval, comment and the scan's bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out: dict = {"quant": {}, "huffman": {}, "restart": 0, "comment": b"", "components": []}
    at = 2
    while True:
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                out["quant"][name] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                lengths = [k + 1 for k, c in enumerate(counts) for _ in range(c)]
                out["huffman"][body[0]] = list(zip(lengths, body[17 : 17 + n], strict=True))
                body = body[17 + n :]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["components"] = [{"id": c, "h": s >> 4, "v": s & 15, "quant": q} for c, s, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            for c in out["components"]:
                c["dc"], c["ac"] = tables[c["id"]] >> 4, 0x10 | (tables[c["id"]] & 15)
            end = data.rindex(b"\xff\xd9")
            out["scan"] = data[at:end]
            return out


def _lookup(table_: list[tuple[int, int]], bits: int) -> np.ndarray:
    """For each pattern of the next `bits` bits the symbol and, in the lowest 8 bits, its code's length; 0 where no code fits."""
    out = np.zeros(1 << bits, np.int32)
    for s, (code, length) in _canonical(table_).items():
        out[code << (bits - length) : (code + 1) << (bits - length)] = s << 8 | length
    return out


def decode_scans(images: list[dict]) -> list[np.ndarray]:
    """The blocks of each image of one component, coefficients in zigzag order.

    Every restart interval is a lane with its place in the bits, its block and its term. A step decodes one symbol of every
    lane: a table on the next bits gives its length and category, the bits after it the amplitude."""
    raw = np.frombuffer(b"".join(x["scan"] for x in images), np.uint8)
    sizes = np.array([len(x["scan"]) for x in images], np.int64)
    begin = np.cumsum(sizes) - sizes
    mark = np.flatnonzero((raw[:-1] == 0xFF) & ((raw[1:] == 0) | ((raw[1:] & 0xF8) == 0xD0)))  # a stuffed byte goes, a marker goes whole
    restart = raw[mark + 1] != 0
    keep = np.ones(len(raw), bool)
    keep[mark + 1] = False
    keep[mark[restart]] = False
    place = np.append(0, np.cumsum(keep))
    data = np.append(raw[keep], np.zeros(16, np.uint8))
    view = np.ndarray((len(data) - 8,), ">u8", data.tobytes(), 0, (1,))  # the eight bytes from any place on
    blocks = np.array([-(-x["width"] // 8) * -(-x["height"] // 8) for x in images], np.int64)
    step = np.array([x["restart"] or n for x, n in zip(images, blocks.tolist(), strict=True)], np.int64)
    lanes = -(-blocks // step)
    first_row = np.cumsum(blocks) - blocks
    image = np.repeat(np.arange(len(images)), lanes)
    number = np.arange(len(image)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = np.sort(np.concatenate([begin, mark[restart] + 2]))
    if len(starts) != len(image):
        raise ValueError("restart markers don't fit the image")
    bit = place[starts] * 8
    row, left = first_row[image] + number * step[image], np.minimum(step[image], blocks[image] - number * step[image])
    deep = max(length for x in images for t in x["huffman"].values() for length, _ in t)
    table_ = np.concatenate([_lookup(x["huffman"][x["components"][0][kind]], deep) for x in images for kind in ("dc", "ac")])
    base, index, last = image * 2 << deep, np.zeros(len(image), np.int64), np.zeros(len(image), np.int64)
    out = np.zeros((int(blocks.sum()), BLOCK), np.int32)
    top, one = np.uint64(64 - deep), np.uint64(1)
    while len(bit):
        if (bit >> 3).max() >= len(view):
            raise ValueError("the scan ends early")
        bits = view[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)
        is_dc = index == 0
        found = table_[base + (~is_dc << deep) + (bits >> top).astype(np.int64)]
        if not found.all():
            raise ValueError("no such Huffman code")
        length, symbol = found & 255, found >> 8
        size = symbol & 15
        amplitude = ((bits << length.astype(np.uint64)) >> one >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(amplitude < (1 << size) >> 1, amplitude - (1 << size) + 1, amplitude)
        bit += length + size
        last = np.where(is_dc, last + value, last)
        index += np.where(is_dc, 0, symbol >> 4)
        has = is_dc | (size > 0)
        if has.all():
            out[row, index] = np.where(is_dc, last, value)
        else:
            out[row[has], index[has]] = np.where(is_dc, last, value)[has]
        index = np.where(~is_dc & (symbol == 0), BLOCK, index + 1)
        done = index >= BLOCK
        if done.any():
            row, left, index = row + done, left - done, np.where(done, 0, index)
            if not left.all():
                going = left > 0
                bit, row, left, base, index, last = (x[going] for x in (bit, row, left, base, index, last))
    return [out[a : a + n] for a, n in zip(first_row.tolist(), blocks.tolist(), strict=True)]


def _decode_bits(image: dict) -> list[np.ndarray]:
    """Any baseline scan, term by term: the blocks of each component in scan order, coefficients in zigzag order."""
    comps = image["components"]
    hmax, vmax = max(c["h"] for c in comps), max(c["v"] for c in comps)
    if len(comps) == 1:
        comps[0]["h"] = comps[0]["v"] = hmax = vmax = 1
    units = -(-image["width"] // (8 * hmax)) * -(-image["height"] // (8 * vmax))
    codes = {k: {(length, code): s for s, (code, length) in _canonical(t).items()} for k, t in image["huffman"].items()}
    step = image["restart"] or units
    parts, data = [], image["scan"]
    at = start = 0
    while at < len(data) - 1:  # restart markers split the scan; stuffed zeros go
        if data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            start = at = at + 2
        else:
            at += 1
    parts.append(data[start:])
    out: list[list[list[int]]] = [[] for _ in comps]
    for k, part in enumerate(parts):
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        pos, last = 0, [0] * len(comps)

        def symbol(codes_: dict) -> int:
            nonlocal pos
            for n in range(1, 17):
                if (s := codes_.get((n, int(bits[pos : pos + n], 2)))) is not None:
                    pos += n
                    return s
            raise ValueError("no such Huffman code")

        def receive(n: int) -> int:
            nonlocal pos
            if not n:
                return 0
            v = int(bits[pos : pos + n], 2)
            pos += n
            return v if v >= 1 << (n - 1) else v - (1 << n) + 1

        for _ in range(min(step, units - k * step)):
            for j, c in enumerate(comps):
                for _ in range(c["h"] * c["v"]):
                    block = [0] * BLOCK
                    last[j] += receive(symbol(codes[c["dc"]]))
                    block[0], i = last[j], 1
                    while i < BLOCK:
                        s = symbol(codes[c["ac"]])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[i] = receive(s & 15)
                        i += 1
                    out[j].append(block)
    return [np.array(x) for x in out]


def coefficients(image: dict) -> list[np.ndarray]:
    return decode_scans([image]) if len(image["components"]) == 1 else _decode_bits(image)


def thumbnail(image: dict, blocks: list[np.ndarray]) -> np.ndarray:
    """One luminance sample per 8 x 8 block of the first component, from DC terms alone."""
    c = image["components"][0]
    dc = np.clip(np.round(blocks[0][:, 0] * image["quant"][c["quant"]][0] / 8 + 128), 0, 255).astype(np.uint8)
    across = -(-image["width"] // 8)
    if c["h"] == c["v"] == 1:
        return dc.reshape(-1, across)
    units = -(-image["width"] // (8 * c["h"]))  # the first component has the largest factors
    return dc.reshape(-1, units, c["v"], c["h"]).transpose(0, 2, 1, 3).reshape(-1, units * c["h"])


@lru_cache(maxsize=256)
def _cells(n: int) -> np.ndarray:
    """How much of each of `n` samples lies in each of 8 cells, in eighths of a sample."""
    cell, sample = np.arange(8)[:, None], np.arange(n)
    return np.maximum(0, np.minimum((cell + 1) * n, (sample + 1) * 8) - np.maximum(cell * n, sample * 8)).astype(np.float64)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which of the thumbnail's 8 x 8 cells, each the average of all samples in it, are above their mean."""
    # Whole numbers below 2^53, hence exact.
    small = (_cells(thumb.shape[0]) @ thumb @ _cells(thumb.shape[1]).T).astype(np.int64)
    return np.packbits(small.ravel() * 64 > small.sum()).tobytes().hex()


BYTE_OF = np.zeros(256, np.uint8)
BYTE_OF[AC_VALUE + 128] = USED


def decode(media: list[bytes]) -> list[tuple[bytes, int, str]]:
    """Payload, text length and feature (width x height : thumbnail hash) of stored images, decoded together."""
    images, out = [parse(x) for x in media], []
    for image, blocks in zip(images, decode_scans(images) if images else [], strict=True):
        body = np.empty(blocks.shape, np.uint8)
        body[:, 0] = blocks[:, 0] + 128
        body[:, 1:] = BYTE_OF[blocks[:, 1:] + 128]
        n = int(image["comment"])
        payload = body.tobytes()[: max(UNIT, -(-n // UNIT) * UNIT)]
        out.append((payload, n, f"{image['width']}x{image['height']}:{thumbnail_hash(thumbnail(image, [blocks]))}"))
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        media = pa.array([encode(x.encode()) for x in batch["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], media], ["doc_id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in slices(batches):
        rows, every = [], batch["media"].to_pylist()
        for media, (payload, n, feature) in zip(every, decode(every), strict=True):
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])


def store_images(docs: DataFrame) -> DataFrame:
    """doc_id and media, one stored image for each row's whole text, as a table in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    images = docs.select("doc_id", text_of().alias("text")).mapInArrow(_store, f"doc_id {kind}, media binary")
    return written(images, "jpeg-media")


def read_images(images: DataFrame) -> DataFrame:
    """Sizes, digests and feature of every stored image, from its bytes alone."""
    kind = images.schema["doc_id"].dataType.simpleString()
    return images.mapInArrow(_read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return read_images(store_images(table(spark, sf_dir, "documents")))
