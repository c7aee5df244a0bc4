"""TIFF as a media column: write samples losslessly, and walk a file's directories to one row per page.

The reader takes either byte order, strips or tiles, 8-bit samples with one or more chunky channels, no compression,
PackBits, LZW and deflate, and horizontal differencing. Pages come in the order of the chain of directories.

Defined results: null media gives no page. Bytes that are no TIFF, or a page of another kind, give one row whose
error says why; the pages before it stay.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.frames import map_rows, whole_text

# fixed values of the format: tags, compressions, field sizes by type
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, CHANNELS, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD = {1: "B", 3: "H", 4: "I"}

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class BadTiff(ValueError):
    """The bytes are no TIFF that this reader takes."""


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def plain(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        plain(m.start())
        out.append(257 - (m.end() - m.start()))
        out.extend(m[1])
        at = m.end()
    plain(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def _pack_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first."""
    code, width = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(width)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for k in range(12):  # the k-th bit from a code's end
        has = width > k
        bits[ends[has] - 1 - k] = (code[has] >> k) & 1
    return np.packbits(bits).tobytes()


_SINGLES = {bytes([i]): i for i in range(256)}


def lzw(data: bytes) -> bytes:
    codes, widths = [256], [9]
    table, free, width, now = dict(_SINGLES), 258, 9, b""
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        codes.append(table[now])
        widths.append(width)
        table[longer] = free
        free += 1
        if free == 4095:
            codes.append(256)
            widths.append(12)
            table, free, width = dict(_SINGLES), 258, 9
        elif free in (512, 1024, 2048):  # one code early, as the format has it
            width += 1
        now = data[i : i + 1]
    if now:
        codes.append(table[now])
        widths.append(width)
        free += 1
        if free in (512, 1024, 2048):
            width += 1
    codes.append(257)
    widths.append(width)
    return _pack_codes(codes, widths)


_FIRST = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, size: int) -> bytes:
    """Codes are read in runs of one width; a clear code starts a new table."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at = 8 * len(data), 0
    table, before, out, held = list(_FIRST), None, [], 0
    while held < size and at + 9 <= total:
        free = len(table)
        width = 9 if free < 511 else 10 if free < 1023 else 11 if free < 2047 else 12
        # codes until the table reaches the next width; the first code after a clear adds no entry
        ahead = max(1, {9: 511, 10: 1023, 11: 2047, 12: 4097}[width] - free)
        start = at + width * np.arange(min(ahead, (total - at) // width))
        if not len(start):
            break
        byte = start >> 3
        window = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
        run = ((window >> (24 - width - (start & 7)).astype(np.uint32)) & ((1 << width) - 1)).tolist()
        for code in run:
            at += width
            if code == 256:
                table, before = list(_FIRST), None
                break
            if code == 257:
                return b"".join(out)[:size]
            if before is None:
                if code > 255:
                    raise BadTiff("LZW: a table entry right after a clear code")
                now = table[code]
            elif code < len(table):
                now = table[code]
                table.append(before + now[:1])
            elif code == len(table):
                now = before + before[:1]
                table.append(now)
            else:
                raise BadTiff("LZW: a code beyond the table")
            before = now
            out.append(now)
            held += len(now)
    return b"".join(out)[:size]


def _squeeze(rows: np.ndarray, compression: int, predictor: int) -> bytes:
    """rows: height, width, channels."""
    if predictor == 2:
        rows = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1)
    data = np.ascontiguousarray(rows).tobytes()
    if compression == PACKBITS:
        line = rows.shape[1] * rows.shape[2]
        return b"".join(packbits(data[k : k + line]) for k in range(0, len(data), line))
    return {NONE: lambda: data, LZW: lambda: lzw(data), DEFLATE: lambda: zlib.compress(data, 4)}[compression]()


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """pages of (height, width, channels) uint8; strips of `strip_rows` rows or tiles of (height, width)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width, channels = page.shape
        parts = []
        if tile:
            th, tw = tile
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    cell = np.zeros((th, tw, channels), np.uint8)
                    own = page[y : y + th, x : x + tw]
                    cell[: own.shape[0], : own.shape[1]] = own
                    parts.append(_squeeze(cell, compression, predictor))
        else:
            parts = [_squeeze(page[y : y + strip_rows], compression, predictor) for y in range(0, height, strip_rows)]
        places = []
        for p in parts:
            places.append(len(out))
            out += p + b"\0" * (len(p) & 1)
        sizes = [len(p) for p in parts]
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * channels), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if channels == 3 else 1]), (CHANNELS, 3, [channels]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_W, 4, [tile[1]]), (TILE_H, 4, [tile[0]]), (TILE_AT, 4, places), (TILE_SIZE, 4, sizes)] if tile else [(STRIP_AT, 4, places), (STRIP_ROWS, 4, [strip_rows]), (STRIP_SIZE, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    page: int
    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    tiled: bool
    samples: bytes


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        e = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, e)
        if kind not in FIELD:
            continue
        size = struct.calcsize(FIELD[kind]) * count
        place = e + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, e + 8)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, place)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _open(part: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return part[:size]
    if compression == PACKBITS:
        return unpackbits(part, size)
    if compression == LZW:
        return unlzw(part, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(part, size)
    raise BadTiff(f"compression {compression}")


def _page(data: bytes, number: int, tags: dict[int, tuple[int, ...]]) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        value = tags.get(tag, (default,))[0]
        if value is None:
            raise BadTiff(f"tag {tag} is missing")
        return value

    width, height, channels = one(WIDTH), one(HEIGHT), one(CHANNELS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise BadTiff("only 8-bit chunky samples, plain or differenced")
    tiled = TILE_AT in tags
    th, tw = (one(TILE_H), one(TILE_W)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    places, sizes = tags.get(TILE_AT if tiled else STRIP_AT, ()), tags.get(TILE_SIZE if tiled else STRIP_SIZE, ())
    whole = np.zeros((height, width, channels), np.uint8)
    cells = [(y, x) for y in range(0, height, th) for x in range(0, width, tw)]
    if len(places) < len(cells) or len(sizes) < len(cells):
        raise BadTiff("fewer parts than the page needs")
    for (y, x), at, size in zip(cells, places, sizes, strict=False):
        rows = th if tiled else min(th, height - y)
        got = _open(data[at : at + size], compression, rows * tw * channels)
        if len(got) != rows * tw * channels:
            raise BadTiff("a part is too short")
        cell = np.frombuffer(got, np.uint8).reshape(rows, tw, channels)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=np.uint8)
        whole[y : y + rows, x : x + tw] = cell[: height - y, : width - x]
    return Page(number, width, height, channels, compression, predictor, tiled, whole.tobytes())


def read_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    (at,), seen, number = struct.unpack_from(f"{order}I", data, 4), set(), 0
    while at:
        if at in seen:
            raise BadTiff("the directories form a loop")
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
            yield _page(data, number, tags)
        except (struct.error, zlib.error) as e:
            raise BadTiff(str(e)) from e
        number += 1


LINE, PAGE_LINES = 576, 256


def payload_of(data: bytes) -> bytes:
    """The bytes, with 255 appended up to a positive multiple of a line."""
    return data + b"\xff" * (-len(data) % LINE if data else LINE)


def tiff_of(payload: bytes) -> bytes:
    """The payload as grey lines of 576 samples or colour lines of 192, at most 256 lines a page.

    The payload's checksum picks the layout, so that equal payloads give equal files.
    """
    kind = zlib.crc32(payload) & 3
    grey = kind in (1, 2)
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE if grey else LINE // 3, 1 if grey else 3)
    pages = [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)]
    if kind == 0:
        return write_tiff(pages, DEFLATE, predictor=2)
    if kind == 1:
        return write_tiff(pages, PACKBITS)
    if kind == 2:
        return write_tiff(pages, LZW)
    return write_tiff(pages, DEFLATE, tile=(16, 64))


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a TIFF that holds the whole text's UTF-8 bytes, padded); null text is empty."""

    def f(row: tuple) -> Iterator[tuple]:
        data = row[1].encode()
        yield row[0], len(data), tiff_of(payload_of(data))

    return map_rows(docs.select("doc_id", whole_text("text")), "doc_id long, n_bytes long, media binary", lambda: f, weigh=2)


PAGES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, pages int, width int, height int, channels int, compression int, predictor int, tiled boolean, samples binary, error string"


def media_pages(media: DataFrame) -> DataFrame:
    """One row per page, a file's pages next to each other and in order; pages counts those of the file."""
    import hashlib

    def f(row: tuple) -> Iterator[tuple]:
        doc_id, n_bytes, data = row
        if data is None:
            return
        head = (doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest())
        found, error = [], None
        try:
            for p in read_pages(data):
                found.append(p)
        except BadTiff as e:
            error = str(e)
        n = len(found) + (error is not None)
        for p in found:
            yield (*head, p.page, n, p.width, p.height, p.channels, p.compression, p.predictor, p.tiled, p.samples, None)
        if error is not None:
            yield (*head, len(found), n, None, None, None, None, None, None, None, error)

    return map_rows(media.select("doc_id", "n_bytes", "media"), PAGES, lambda: f, flush_rows=1024, weigh=12)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def page_digests(pages: DataFrame) -> DataFrame:
    """One row per file from its page rows as media_pages leaves them, without a shuffle.

    feature: pages, largest page, compression, then mean and standard deviation of all samples in thousandths.
    """
    import hashlib

    columns = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pages", "width", "height", "channels", "compression", "samples", "error"]

    def make() -> object:
        state: dict = {}

        def f(row: tuple) -> Iterator[tuple]:
            doc_id, n_bytes, media_bytes, media_sha, page, pages, width, height, channels, compression, samples, error = row
            if error is not None:
                raise BadTiff(f"document {doc_id}: {error}")
            if page == 0:
                state.update(sha=hashlib.sha256(), size=0, tail=b"", total=0, square=0, shape=f"{height}x{width}x{channels}")
            s = np.frombuffer(samples, np.uint8)
            count = np.bincount(s, minlength=256)
            state["sha"].update(samples)
            state["size"] += len(samples)
            state["tail"] = (state["tail"] + samples[-32:])[-32:]
            state["total"] += int(count @ np.arange(256))
            state["square"] += int(count @ np.arange(256) ** 2)
            if page == pages - 1:
                n = state["size"]
                mean = state["total"] / n
                spread = max(0.0, state["square"] / n - mean * mean) ** 0.5
                yield doc_id, n_bytes, n, state["sha"].hexdigest(), zlib.crc32(state["tail"]), media_bytes, media_sha, f"{pages}p {state['shape']} c{compression} {mean:.3f} {spread:.3f}"

        return f

    return map_rows(pages.select(*columns), DIGEST, make)
