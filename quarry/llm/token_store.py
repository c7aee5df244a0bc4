"""Token ids in a content-addressed store.

A text's ids, with an end id appended, are cut into chunks where a rolling hash of the last ids meets a condition, so
that equal passages give equal chunks. A chunk's name is the BLAKE2b digest of its bytes (ids as little-endian 16-bit
integers), and it is stored once. A recipe lists a document's chunk names, its number of ids and the Merkle root over
its chunk names; recipes lie in ascending doc_id order with the number of ids before each document.

Reading checks every chunk against its name and every recipe against its root. `document_checksums` combines the
chunks' checksums, so that the ids themselves are not moved; `read_documents` puts the ids together again.

Defined results: null or empty text is the end id alone. Repeated rows are documents of their own; a null doc_id comes
first in order. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.frames import delete_path, free_shuffles, map_rows, small_batches, whole_text
from quarry.llm.ranges import with_running_start

END = 0
#: What an entry of a dictionary of short strings takes besides its characters, about.
ENTRY = 200
LEAST, MOST, MASK = 128, 2048, np.uint64((1 << 9) - 1 << 40)  # a cut every 512 ids or so
_CUT = re.compile(r"(?<=\S)(?= )")
_ANY_GAP, _RARE_GAP = re.compile(r"\s"), re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = ("  ", "\n ", "\n\n", " \n", "\t", "\r", "\x0b", "\x0c", "\x01")
_MARKS = (".", ",", ";", ":", "!", "?")
_GAPS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
# fixed value: the pattern by which byte-level tokenizers of the library split a text, where their file asks for it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _mixed(n: int) -> np.ndarray:
    """n well spread 64-bit numbers."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = _mixed(1 << 16)


class Encoder:
    """Byte-level BPE through the tokenizers library, with the ids of what was met before kept.

    The tokenizer first splits a text by a pattern and then works on each split apart. A space after a non-space always
    starts a split, so texts are cut there; pieces not met before are split by the same pattern, and splits not met
    before go to the library together, a newline after each. This holds for tokenizers whose file asks for that pattern
    and nothing else before it; texts go to any other as they are. What is kept is forgotten once it holds `most` bytes.
    """

    def __init__(self, path: str, most: int = 192 << 20):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.held = Tokenizer.from_file(path), most, 0
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.by_pattern = kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PATTERN)
        self.splits: dict[str, bytes] = {}
        self.newline = self._whole("\n").tolist()[0]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _learn(self, splits: list[str]) -> dict[str, bytes]:
        """Ids of splits; those with white space other than a leading space go to the library one by one."""
        plain = [x for x in splits if not _ANY_GAP.search(x, 1) and x[0] not in _GAPS]
        out = {x: self._whole(x).tobytes() for x in set(splits).difference(plain)}
        if plain:
            ids = self._whole("\n".join(plain) + "\n")
            ends = np.nonzero(ids == self.newline)[0].tolist()
            if len(ends) != len(plain):
                return out | {x: self._whole(x).tobytes() for x in plain}
            start = 0
            for x, end in zip(plain, ends, strict=True):
                out[x] = ids[start:end].tobytes()
                start = end + 1
        if self.held > self.most:
            self.splits, self.held = {}, 0
        self.splits.update(out)
        self.held += sum(2 * len(x) + len(ids) + ENTRY for x, ids in out.items())
        return out

    def _parts(self, piece: str) -> list[str]:
        """The splits of a piece; words, also with one mark after them, need no pattern."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return [piece]
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the tokenizer works on apart."""
        splits = self.splits
        out = list(map(splits.get, pieces))
        open_ = [k for k, ids in enumerate(out) if ids is None]
        if open_:
            parts = [self._parts(pieces[k]) if pieces[k] else [] for k in open_]
            missing = list(dict.fromkeys(x for own in parts for x in own if x not in splits))
            fresh = self._learn(missing) if missing else {}
            for k, own in zip(open_, parts, strict=True):  # of what was known before, also if it was forgotten meanwhile
                out[k] = b"".join([splits[x] if x in splits else fresh[x] for x in own])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian 16-bit integers."""
        if not self.by_pattern or any(s in text for s in self.special):
            return self._whole(text).tobytes()
        return b"".join(self.look_up(_CUT.split(text))) if text else b""

    def _is_plain(self, text: str) -> bool:
        """White space is single spaces and newlines only, and nothing stands for a special id."""
        return not (any(x in text for x in _ODD) or (not text.isascii() and _RARE_GAP.search(text)) or any(s in text for s in self.special))

    def encode_many(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text. Pieces are cut, and equal ones found, in Arrow; each is looked up once."""
        rows = texts.to_pylist()
        plain = np.array([self.by_pattern and self._is_plain(t) for t in rows], bool)
        out: list[bytes] = [b""] * len(rows)
        for k in np.nonzero(~plain)[0]:
            out[k] = self.encode(rows[k])
        if not plain.any():
            return out
        # spaces lead pieces, newlines stand alone
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(plain)), "\n", "\x01\n\x01"), " ", "\x01 ")
        cut = pc.split_pattern(marked, "\x01")
        coded = cut.flatten().dictionary_encode()
        found = self.look_up(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u2")
        size = np.fromiter(map(len, found), np.int32, len(found)) // 2
        first = np.cumsum(size, dtype=np.int32) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n, dtype=np.int32)
        ids = flat[np.repeat(first[at] - ends + n, n) + np.arange(len(n) and ends[-1], dtype=np.int32)]
        edges = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        for k, s, e in zip(np.nonzero(plain)[0], edges[:-1], edges[1:], strict=True):
            out[k] = ids[s:e].tobytes()
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker: what a task has met helps the next."""
    return Encoder(path)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of chunks: where the rolling hash of the last 16 ids allows one, LEAST to MOST ids after the last."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = _GEAR[ids]
    for s in (1, 2, 4, 8):
        older = np.zeros(n, np.uint64)
        older[s:] = h[:-s] << np.uint64(s)
        h = h + older
    out, last = [], 0
    for c in (np.nonzero((h & MASK) == 0)[0] + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST and c < n:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def merkle_root(names: list[bytes]) -> bytes:
    level = names
    while len(level) > 1:
        level = [blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() for i in range(0, len(level), 2)]
    return level[0]


def name_of(payload: bytes) -> bytes:
    return blake2b(payload, digest_size=16).digest()


ROWS = "kind string, key binary, doc_id long, n long, root binary, payload binary"


def _rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Chunk rows (each name once a task, as far as it remembers) and recipe rows."""

    def of(doc_id: int | None, data: bytes, seen: set[bytes]) -> Iterator[tuple]:
        names, last = [], 0
        for c in cuts(np.frombuffer(data, "<u2")):
            payload = data[2 * last : 2 * c]
            name = name_of(payload)
            names.append(name)
            if name not in seen:
                if len(seen) < 200_000:
                    seen.add(name)
                yield "chunk", name, None, c - last, None, payload
            last = c
        root = merkle_root(names)
        yield "recipe", root + (doc_id or 0).to_bytes(8, "big", signed=True), doc_id, last, root, b"".join(names)

    end = END.to_bytes(2, "little")
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(tokenizer), set()
        for b in batches:
            if b.num_rows:
                encoded = encoder.encode_many(b.column(1))
                rows = [r for i, data in zip(b.column(0).to_pylist(), encoded, strict=True) for r in of(i, data + end, seen)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    small_batches(docs.sparkSession, "8m")
    return docs.select("doc_id", whole_text("text")).mapInArrow(run, ROWS)


class TokenStore:
    """The written store: chunks, and recipes in doc_id order with start (ids before)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.schema("key binary, n long, payload binary").parquet(f"{self.path}/rows/kind=chunk")

    @property
    def recipes(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, n long, start long, root binary, names binary").parquet(f"{self.path}/recipes")

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str) -> TokenStore:
        spark = docs.sparkSession
        rows = _rows(docs, tokenizer).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        # of equal chunks, which lie in one partition by now, one stays
        first = Window.partitionBy("kind", "key").orderBy("n")
        rows = rows.withColumn("_n", F.row_number().over(first)).where((F.col("kind") == "recipe") | (F.col("_n") == 1)).drop("_n")
        rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/rows")
        free_shuffles(spark)
        if spark.read.schema(f"{ROWS}").parquet(f"{path}/rows").limit(1).count():
            recipes = spark.read.schema("doc_id long, n long, root binary, payload binary").parquet(f"{path}/rows/kind=recipe")
        else:
            recipes = spark.createDataFrame([], "doc_id long, n long, root binary, payload binary")
        placed = with_running_start(recipes.withColumnRenamed("payload", "names"), ["doc_id", "root"], "n")
        placed.select("doc_id", "n", "start", "root", "names").write.option("compression", "zstd").parquet(f"{path}/recipes")
        delete_path(spark, f"{path}/rows/kind=recipe")
        return cls(spark, path)

    def _empty(self) -> bool:
        return not self.recipes.limit(1).count()

    def _named(self) -> DataFrame:
        """A row for each place in each recipe: number (of the recipe), at, name."""
        return map_rows(self.recipes, "doc_id long, start long, n long, root binary, at int, name binary", lambda: lambda r: ((r[0], r[2], r[1], r[3], k, r[4][16 * k : 16 * k + 16]) for k in range(len(r[4]) // 16)))

    def _checked(self) -> DataFrame:
        def f(row: tuple) -> Iterator[tuple]:
            key, n, payload = row
            if name_of(payload) != key or 2 * n != len(payload):
                raise ValueError(f"chunk {key.hex()} does not match its name")
            yield key, n, crc32(np.frombuffer(payload, "<u2").astype("<u4").tobytes())

        return map_rows(self.chunks, "name binary, size long, crc long", lambda: f)

    def document_checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""
        if self._empty():
            return self.spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        parts = self._named().join(self._checked(), "name", "left")
        whole = parts.groupBy("start", "doc_id", "n", "root").agg(F.collect_list(F.struct("at", "name", "size", "crc")).alias("parts"))
        flat = whole.select("doc_id", "start", "n", "root", F.array_sort("parts").alias("parts"))
        flat = flat.select("doc_id", "start", "n", "root", *(F.col(f"parts.{c}").alias(c) for c in ("name", "size", "crc")))

        def f(row: tuple) -> Iterator[tuple]:
            doc_id, start, n, root, names, sizes, crcs = row
            if None in sizes or sum(sizes) != n or merkle_root(names) != root:
                raise ValueError(f"document {doc_id} cannot be rebuilt from the store")
            yield doc_id, start, n, combined_crc(crcs, [4 * s for s in sizes])

        return map_rows(flat, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda: f)

    def read_documents(self) -> DataFrame:
        """doc_id, start, ids (array of int, with the end id)."""
        if self._empty():
            return self.spark.createDataFrame([], "doc_id long, start long, ids array<int>")
        parts = self._named().join(self.chunks.select(F.col("key").alias("name"), "payload"), "name", "left")
        whole = parts.groupBy("start", "doc_id", "n", "root").agg(F.array_sort(F.collect_list(F.struct("at", "name", "payload"))).alias("parts"))
        flat = whole.select("doc_id", "start", "n", "root", "parts.name", "parts.payload")

        def f(row: tuple) -> Iterator[tuple]:
            doc_id, start, n, root, names, payloads = row
            if None in payloads or any(name_of(p) != k for k, p in zip(names, payloads, strict=True)) or merkle_root(names) != root:
                raise ValueError(f"document {doc_id} cannot be rebuilt from the store")
            yield doc_id, start, np.frombuffer(b"".join(payloads), "<u2").astype(np.int32)

        return map_rows(flat, "doc_id long, start long, ids array<int>", lambda: f, flush_rows=64)


def _times(matrix: list[int], x: int) -> int:
    out, k = 0, 0
    while x:
        if x & 1:
            out ^= matrix[k]
        x >>= 1
        k += 1
    return out


@lru_cache(maxsize=64)
def _zeros(power: int) -> tuple[int, ...]:
    """The linear map that 2^power zero bytes apply to a CRC-32 register."""
    if power == 0:
        one = [0xEDB88320, *(1 << k for k in range(31))]
        for _ in range(3):  # one zero bit, squared three times: eight
            one = [_times(one, c) for c in one]
        return tuple(one)
    half = _zeros(power - 1)
    return tuple(_times(half, c) for c in half)


@lru_cache(maxsize=8192)
def _shift(size: int) -> tuple[int, ...]:
    out, k = [1 << b for b in range(32)], 0
    while size >> k:
        if size >> k & 1:
            out = [_times(_zeros(k), c) for c in out]
        k += 1
    return tuple(out)


def combined_crc(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of a whole from those of its parts and their sizes in bytes."""
    out = crcs[0]
    for c, n in zip(crcs[1:], sizes[1:], strict=True):
        out = _times(_shift(n), out) ^ c
    return out
