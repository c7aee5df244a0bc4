"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Candidate merges wait in an agenda by the model's scores. When one comes up, a hash keyed by the seed, the document,
the word's place in it, its place in the word and the merged piece decides whether it is skipped; a skipped candidate
never comes back. With dropout 0 the result is the model's own segmentation. Every occurrence of a word has hashes of
its own and an agenda of its own: numpy works through the agendas of thousands of words of one length at once, and
nothing is kept from one batch to the next but the vocabulary.

Defined results: null or empty text has no ids. Text is restored exactly: what the vocabulary lacks, and the mark that
stands for a space inside pieces, go through byte pieces. Rows with null or repeated ids are encoded like others; any
length of text or word is taken. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.frames import map_rows, small_batches, whole_text

MARK = "▁"
_LITERAL = "\0" + MARK  # a mark in the text itself; never part of a piece
_M64 = (1 << 64) - 1
SHORT, LONGEST, ROWS = 48, 32, 8192
_NONE = np.int32(2**31 - 1)
_ODD = ("  ", " \n", "\x01", MARK)
_WORD = re.compile(r" *[^ \n]+| *\n| +")


def _hash(*parts: int) -> int:
    x = 0x243F6A8885A308D3
    for p in parts:
        x = ((x ^ (p & _M64)) * 0x9E3779B97F4A7C15) & _M64
        x ^= x >> 29
    return x


_PLACE = 0xD1B54A32D192ED03


def _key(at: int, merged: int) -> int:
    return (at * _PLACE + merged) & _M64


def _hash_on(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """`_hash` with one part more, for arrays of 64-bit integers."""
    x = (x ^ part) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _low(base: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """`_skipped` for arrays."""
    x = (base ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) < np.uint64(limit)


def _skipped(base: int, at: int, merged: int, limit: int) -> bool:
    x = ((base ^ _key(at, merged)) * 0xBF58476D1CE4E5B9) & _M64
    return ((x ^ (x >> 31)) * 0x94D049BB133111EB) & _M64 < limit


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes_at, self.raw, self.score = {}, [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.score.append(-sp.get_score(i))
            if sp.is_byte(i):
                self.bytes_at[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses a word's start; words cannot be encoded apart")
                self.ids[piece] = i
                self.raw.append(piece.replace(MARK, " ").encode())
        if len(self.bytes_at) != 256:
            raise ValueError("the model has no byte pieces")
        order = {x: k for k, x in enumerate(sorted(set(self.score)))}
        self.rank = {p: order[self.score[i]] for p, i in self.ids.items()}

    def word(self, symbols: list[str], base: int, limit: int) -> list[int]:
        """Ids of one unit. A merge is skipped where its hash is below `limit` of 2^64."""
        return (self._short if len(symbols) <= SHORT else self._long)(symbols, base, limit)

    def _ids(self, live: list[str]) -> list[int]:
        out = []
        for s in live:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes_at[b] for b in (MARK if s == _LITERAL else s).encode())
        return out

    def _short(self, symbols: list[str], base: int, limit: int) -> list[int]:
        """The agenda as a list with the merged piece's rank at each place: the smallest, then the leftmost, comes first."""
        get, none = self.rank.get, len(self.score)
        live, at = list(symbols), list(range(len(symbols)))
        agenda = [get(a + b, none) for a, b in pairwise(live)]
        while agenda:
            m = min(agenda)
            if m == none:
                break
            k = agenda.index(m)
            if limit and _skipped(base, at[k], m, limit):
                agenda[k] = none
                continue
            live[k] += live.pop(k + 1)
            del at[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = get(live[k] + live[k + 1], none)
            if k:
                agenda[k - 1] = get(live[k - 1] + live[k], none)
        return self._ids(live)

    def _long(self, symbols: list[str], base: int, limit: int) -> list[int]:
        """The agenda as a heap."""
        rank = self.rank.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (m := rank(symbols[i] + symbols[i + 1])) is not None:
                agenda.append((m, i, i + 1, len(symbols[i]), len(symbols[i + 1])))
        heapify(agenda)
        live: list[str | None] = list(symbols)
        while agenda:
            m, i, j, li, lj = heappop(agenda)
            left, right = live[i], live[j] if j < n else None
            if left is None or right is None or after[i] != j or len(left) != li or len(right) != lj:
                continue  # one side was merged meanwhile
            if limit and _skipped(base, i, m, limit):
                continue
            joined = left + right
            live[i], live[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := rank(joined + live[k])) is not None:
                    heappush(agenda, (m, i, k, len(joined), len(live[k])))
            h = before[i]
            if h >= 0 and (m := rank(live[h] + joined)) is not None:
                heappush(agenda, (m, h, i, len(live[h]), len(joined)))
        return self._ids([s for s in live if s is not None])


class Table:
    """What two neighbouring pieces merge into, for arrays of ids: an open table over pairs of ids."""

    BITS = 20

    def __init__(self, pieces: Pieces):
        ids = pieces.ids
        split = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        if len(split) * 3 > 1 << self.BITS or len(pieces.score) > 1 << 16:
            raise ValueError("the vocabulary is too large for the table")
        left, right, into = (np.array(x, np.int64) for x in zip(*split, strict=True))
        self.keys, self.into = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int32)
        key = left << 16 | right
        at = self._place(key)
        while len(key):  # of those that want one place the first has it, the others move on
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(key), bool)
            mine[first] = True
            mine &= free
            self.keys[at[mine]], self.into[at[mine]] = key[mine], into[mine]
            key, into, at = key[~mine], into[~mine], (at[~mine] + 1) & ((1 << self.BITS) - 1)
        #: rank by id; the last stands for no piece
        self.rank = np.full(len(pieces.score) + 1, _NONE, np.int32)
        self.rank[list(ids.values())] = [pieces.rank[p] for p in ids]
        #: id of a character that is a piece, else -1
        self.chars = np.full(0x110000, -1, np.int32)
        one = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.chars[list(one)] = list(one.values())

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that the two make, or -1."""
        key = left.astype(np.int64) << 16 | right
        at = self._place(key)
        found = self.keys[at]
        out = np.where(found == key, self.into[at], np.int32(-1))
        on = np.nonzero((found != key) & (found >= 0))[0]
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[on]]
            hit = found == key[on]
            out[on[hit]] = self.into[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def agenda(self, symbols: np.ndarray, base: np.ndarray, limit: int) -> np.ndarray:
        """Words of one length as rows of ids: the ids that are left at their first places, -1 elsewhere."""
        n, width = symbols.shape
        out = np.empty_like(symbols)
        if width == 1:
            return symbols
        sym, rank = symbols.copy(), np.full((n, width), _NONE, np.int32)
        rank[:, :-1] = self.rank[self.merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())].reshape(n, -1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        row = np.arange(n)
        while True:
            k = rank.argmin(axis=1)
            start = np.arange(len(row)) * width
            m = rank.reshape(-1)[start + k]
            live = m != _NONE
            left = np.count_nonzero(live)
            if left < 0.75 * len(row) or not left:
                out[row[~live]] = sym[~live]
                sym, rank, after, before, row, base, k, m = (x[live] for x in (sym, rank, after, before, row, base, k, m))
                if not len(row):
                    return out
                start = np.arange(len(row)) * width
                on = np.arange(len(row))
            else:
                on = np.nonzero(live)[0]
            k, m = k[on], m[on]
            start = start[on]
            flat_sym, flat_rank, flat_after, flat_before = (x.reshape(-1) for x in (sym, rank, after, before))
            if limit:
                skip = _low(base[on], k.astype(np.uint64) * np.uint64(_PLACE) + m.astype(np.uint64), limit)
                flat_rank[(start + k)[skip]] = _NONE
                k, start = k[~skip], start[~skip]
            at = start + k
            gone = start + flat_after[at]
            made = flat_sym[at] = self.merged(flat_sym[at], flat_sym[gone])
            flat_sym[gone], flat_rank[gone], flat_rank[at] = -1, _NONE, _NONE
            then = flat_after[at] = flat_after[gone]
            more = then < width
            right = (start + then)[more]
            flat_before[right] = k[more]
            flat_rank[at[more]] = self.rank[self.merged(made[more], flat_sym[right])]
            past = flat_before[at]
            more = past >= 0
            left_at = (start + past)[more]
            flat_rank[left_at] = self.rank[self.merged(flat_sym[left_at], made[more])]


class DropoutEncoder:
    """Encodes texts."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 11):
        self.pieces, self.table, self.seed = pieces_of(path), table_of(path), seed
        self.limit = int(dropout * 2**64)

    def encode(self, text: str, doc_id: int) -> bytes:
        """Ids of one text of any kind as 16-bit integers, word by word."""
        out = array("H")
        for place, w in enumerate(_WORD.findall(" " + text) if text else ()):  # the model puts a space first
            body = w.lstrip(" ")
            symbols = [MARK] * (len(w) - len(body)) + [_LITERAL if c == MARK else c for c in body]
            out.extend(self.pieces.word(symbols, _hash(self.seed, doc_id, place), self.limit))
        return out.tobytes()

    def encode_many(self, texts: pa.StringArray, doc_ids: list[int]) -> list[np.ndarray]:
        """Ids of each text. Words are cut, and equal ones found, in Arrow; hashes are those of `encode`."""
        rows = texts.to_pylist()
        plain = np.array([bool(t) and not (t[0] == " " or any(x in t for x in _ODD)) for t in rows], bool)
        out = [np.frombuffer(b"" if p else self.encode(t or "", i), np.uint16) for t, i, p in zip(rows, doc_ids, plain, strict=True)]
        own = np.nonzero(plain)[0]
        if not len(own):
            return out
        marked = pc.replace_substring(pc.binary_join_element_wise(MARK, texts.filter(pa.array(plain)), ""), "\n", "\x01\n\x01")
        cut = pc.split_pattern(pc.replace_substring(marked, " ", "\x01" + MARK), "\x01")
        coded = cut.flatten().dictionary_encode()
        words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        edges = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        symbols = self.table.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        size[np.unique(np.repeat(np.arange(len(words)), size)[symbols < 0])] = LONGEST + 1  # a character without a piece: one by one
        # the empty words between line ends have no place
        filled = np.concatenate([[0], np.cumsum(size[word] > 0)])
        owner = np.repeat(np.arange(len(own)), np.diff(edges))
        start = np.array([_hash(self.seed, doc_ids[k]) for k in own], np.uint64)
        base = _hash_on(start[owner], (filled[:-1] - filled[edges[owner]]).astype(np.uint64))
        made, counts = self._words(words, word, first, size, symbols, base)
        ends = np.concatenate([[0], np.cumsum(counts)])[edges]
        for k, s, e in zip(own, ends[:-1], ends[1:], strict=True):
            out[k] = made[s:e]
        return out

    def _words(self, words: list[str], word: np.ndarray, first: np.ndarray, size: np.ndarray, symbols: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences one after the other, and how many each has."""
        counts, done = np.zeros(len(word), np.int64), []
        width = size[word]
        order = np.argsort(width, kind="stable")
        bounds = np.searchsorted(width[order], np.arange(LONGEST + 2))
        for w in range(1, LONGEST + 1):
            for s in range(bounds[w], bounds[w + 1], ROWS):
                at = order[s : min(s + ROWS, bounds[w + 1])]
                ids = self.table.agenda(symbols[first[word[at]][:, None] + np.arange(w)], base[at], self.limit)
                there = ids >= 0
                counts[at] = there.sum(axis=1)
                done.append((at, ids[there].astype(np.uint16)))
        for j in order[bounds[LONGEST + 1] :].tolist():
            ids = np.array(self.pieces.word(list(words[word[j]]), int(base[j]), self.limit), np.uint16)
            counts[j] = len(ids)
            done.append((np.array([j]), ids))
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint16)
        for at, ids in done:
            n = counts[at]
            out[np.arange(len(ids)) + np.repeat(begins[at] - (np.cumsum(n) - n), n)] = ids
        return out, counts


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One vocabulary a Python worker; its size is the model's."""
    return Pieces(path)


@lru_cache(maxsize=1)
def table_of(path: str) -> Table:
    return Table(pieces_of(path))


def _encoded(encoder: DropoutEncoder, b: pa.RecordBatch) -> list[np.ndarray]:
    return encoder.encode_many(b.column(1), [i or 0 for i in b.column(0).to_pylist()])


def encode_documents(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 11, as_array: bool = False) -> DataFrame:
    """doc_id, ids: 16-bit little-endian integers in a binary column, or an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DropoutEncoder(model, dropout, seed)
        for b in batches:
            if b.num_rows:
                ids = _encoded(encoder, b)
                if as_array:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                else:
                    held = pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), held], names=["doc_id", "ids"])

    small_batches(docs.sparkSession, "2m")
    return docs.select("doc_id", whole_text("text")).mapInArrow(run, f"doc_id long, ids {'array<int>' if as_array else 'binary'}")


def decode(ids: np.ndarray, raw: list[bytes]) -> str:
    return b"".join([raw[i] for i in ids.tolist()])[1:].decode()


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids (binary)."""

    def make() -> object:
        raw = pieces_of(model).raw
        return lambda row: ((row[0], decode(np.frombuffer(row[1], "<u2"), raw)),)

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", make, weigh=1)


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 11) -> DataFrame:
    """doc_id, ids (binary) and the text decoded from those ids, in one pass through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DropoutEncoder(model, dropout, seed)
        for b in batches:
            if b.num_rows:
                ids = [x.astype("<u2").tobytes() for x in _encoded(encoder, b)]
                texts = [decode(np.frombuffer(x, "<u2"), encoder.pieces.raw) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    small_batches(docs.sparkSession, "2m")
    return docs.select("doc_id", whole_text("text")).mapInArrow(run, "doc_id long, ids binary, text string")
