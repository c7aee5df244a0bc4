"""Scoring text with an n-gram model whose counts lie in a log-frequency Bloom filter.

Counts of n-grams of two words and more are quantised to levels (level j stands for counts from 2^(j-1) to 2^j - 1), and
an n-gram enters the filter once for each level up to its own. Its level is found again by repeated membership probes,
level after level until one is missing; so levels are never too low, and too high only where a Bloom filter errs. The
estimate of a count is the middle of its level. The filter is cut into segments by hash, each as long as what it holds
needs, so that it grows with the corpus; what it takes is counted before it is broadcast, and above `broadcast_bytes` the
n-grams of a block go to the segments and their levels come back, with the same levels.

Probabilities are interpolated from the unigram estimate (c + 1) / (N + V + 1) upwards: at each order the estimated count
over that of the history, clipped to one, weighs as much as is best for the training documents when each token is taken
out of the counts that score it. There is a weight for each order and power of two of the history's count. Counts of
single words are exact.

Documents are worked on in blocks bounded by bytes: a block lists its distinct words once, counts of words are summed
over blocks in Spark and come back to the blocks, and its n-grams are summed before they move.

Defined results: a null or empty text is an end alone. A row without doc_id teaches the model. Rows that repeat are
documents of their own. Words of more than 40 bytes are told apart by SHA-256, n-grams by 64 bits of hash. Columns
other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm.frames import Bucketed, Stored, ascii_lower, map_rows, map_stream, packed, stored, unpacked, whole_text

SLICE, BLOCK = 1 << 20, 16 << 20
#: Tokens whose n-grams are worked on at once.
STEP = 1 << 19
LONG_WORD = 40
PROBES = 5
#: Weights that are tried.
GRID = np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])
POWERS = 64
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_START = np.uint64(0x9AE16A3B2F90404F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice and a word at a time."""
    at = 0
    while len(text) - at > SLICE and (gap := _SPACE.search(text, at + SLICE)):
        yield text[at : gap.start()].split()
        at = gap.start()
    yield (text[at:] if at else text).split()


def word_key(word: bytes) -> bytes:
    return b"w" + word if len(word) <= LONG_WORD else b"h" + hashlib.sha256(word).digest()


END = b"e"


def steps(seqs: list[np.ndarray]) -> Iterator[slice]:
    """Documents in stretches of `STEP` tokens or one document."""
    first = taken = 0
    for k, s in enumerate(seqs):
        taken += len(s)
        if taken >= STEP:
            yield slice(first, k + 1)
            first, taken = k + 1, 0
    if first < len(seqs):
        yield slice(first, len(seqs))


def gram_hashes(words: np.ndarray, seqs: list[np.ndarray], order: int) -> np.ndarray:
    """A hash for the n-gram that ends at each token; before a text there are start marks."""
    if not seqs:
        return np.zeros(0, np.uint64)
    size = np.array([len(s) for s in seqs])
    own = words[np.concatenate(seqs)]
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(len(own), order, np.uint64)
    for back in range(order - 1, -1, -1):
        word = np.where(place >= back, np.roll(own, back), _START) if back else own
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]


def estimates(levels: np.ndarray) -> np.ndarray:
    """The middle of each level's counts; level 0 is none."""
    low = np.exp2(levels - 1.0)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


def _places(grams: np.ndarray, level: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram lies at a level: a word of the segment, of `words`, and `PROBES` bits of that word, so that a probe of all reads one place."""
    one = _mix(grams + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    word = (one >> np.uint64(32)) * words >> np.uint64(32)
    two, mask = _mix(one ^ np.uint64(0xA0761D6478BD642F)), np.zeros(len(grams), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (two >> np.uint64(6 * k) & np.uint64(63))
    return word, mask


def segment_bits(grams: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """One segment of the filter, for distinct n-grams and their counts, with so many bits for each level of each."""
    levels = levels_of(counts)
    held = np.zeros(bits * int(levels.sum()) // 64 + 1, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _places(grams[levels >= level], level, np.uint64(len(held)))
        np.bitwise_or.at(held, at.astype(np.int64), mask)
    return held.tobytes()


class Segments:
    """Segments of the filter by number; what is not there holds nothing. The top `power` bits of a hash are its segment."""

    def __init__(self, power: int, parts: Iterable[tuple[int, bytes]]):
        self.power = power
        self.first, self.words = np.zeros(1 << power, np.uint64), np.zeros(1 << power, np.uint64)
        self.data = bytearray()
        for number, data in parts:
            self.first[number], self.words[number] = len(self.data) // 8, len(data) // 8
            self.data += data

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 where it is not held: membership probes for one level more until one fails."""
        out, data = np.zeros(len(grams), np.int8), np.frombuffer(self.data, np.uint64)
        number = segment_of(grams, self.power)
        alive = np.nonzero(self.words[number])[0]
        level = 0
        while len(alive):
            level += 1
            segment = number[alive]
            at, mask = _places(grams[alive], level, self.words[segment])
            alive = alive[data[(self.first[segment] + at).astype(np.int64)] & mask == mask]
            out[alive] = level
        return out


def segment_of(grams: np.ndarray, power: int) -> np.ndarray:
    return (grams >> np.uint64(64 - power)).astype(np.int64)


BLOCKS = "block long, doc_ids array<long>, held array<boolean>, seqs array<binary>, hashes binary, words array<binary>, times array<int>, tokens long"


class _Numbers(dict):
    """Words by their number, in order of appearance; the end stands as the empty word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(rows: Iterator[tuple], block_bytes: int) -> Iterator[tuple]:
    """Blocks of documents as word numbers, with the distinct words and how often training documents hold them."""
    number = TaskContext.get().partitionId() << 32
    at, docs, taken = _Numbers({b"": 0}), [], 0

    def block() -> tuple:
        times = np.zeros(len(at), np.int32)
        for _, held, seq in docs:
            if not held:
                times += np.bincount(seq, minlength=len(at)).astype(np.int32)
        words = [END, *map(word_key, list(at)[1:])]
        return number, [d for d, _, _ in docs], [h for _, h, _ in docs], [packed(s) for _, _, s in docs], np.array([xxh64_intdigest(w, 29) for w in words], np.uint64).tobytes(), words, times.tolist(), int(times.sum(dtype=np.int64))

    for doc_id, held, text in rows:
        parts = []
        for words in word_lists(text.encode()):
            parts.append(np.fromiter(map(at.__getitem__, words), np.int32, len(words)))
        docs.append((doc_id, held, np.concatenate([*parts, np.zeros(1, np.int32)])))
        taken += len(text)
        if taken >= block_bytes:
            yield block()
            number, at, docs, taken = number + 1, _Numbers({b"": 0}), [], 0
    if docs:
        yield block()


def _hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _seqs(raw: list[bytes]) -> list[np.ndarray]:
    return [unpacked(s) for s in raw]


def _sliced(block: int, grams: np.ndarray, power: int, *more: np.ndarray) -> Iterator[tuple]:
    """Sorted n-grams with what goes with them, a row for each segment."""
    number = segment_of(grams, power)
    cuts = np.concatenate([[0], np.nonzero(np.diff(number))[0] + 1, [len(grams)]]) if len(grams) else np.zeros(1, np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(number[low]), block, *(x[low:high].tobytes() for x in (grams, *more))


def filter_segments(blocks: DataFrame, order: int, power: int, bits: int) -> DataFrame:
    """segment, bits: the filter over n-grams of 2 to `order` words in training documents.

    A segment gathers the n-grams of one range of hashes, each once a block; there are as many ranges as keep it small.
    """

    def slices(row: tuple) -> Iterator[tuple]:
        block, held, seqs, hashes = row
        own, taught = _hashes(hashes), [s for s, h in zip(_seqs(seqs), held, strict=True) if not h]
        for n in range(2, order + 1):
            parts = [np.unique(gram_hashes(own, taught[part], n), return_counts=True) for part in steps(taught)]
            if parts:
                grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                times = np.bincount(back, np.concatenate([c for _, c in parts]), len(grams))
                yield from _sliced(block, grams, power, times.astype(np.int32))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(table["grams"].to_pylist()), np.uint64)
        times = np.frombuffer(b"".join(table["times"].to_pylist()), np.int32)
        distinct, back = np.unique(grams, return_inverse=True)
        held = segment_bits(distinct, np.bincount(back, times, len(distinct)), bits)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([held], pa.binary())})

    rows = map_rows(blocks.select("block", "held", "seqs", "hashes"), "segment long, block long, grams binary, times binary", lambda: slices, weigh=2)
    return rows.groupBy("segment").applyInArrow(one, "segment long, bits binary")


def _levels_by_segment(blocks: DataFrame, segments: DataFrame, order: int, power: int) -> DataFrame:
    """block, levels (one array for each order, an entry a token): n-grams go to their segments and levels come back."""

    def asked(row: tuple) -> Iterator[tuple]:
        block, seqs, hashes = row
        own = _hashes(hashes)
        for n in range(2, order + 1):
            given = _seqs(seqs)
            grams = np.unique(np.concatenate([np.unique(gram_hashes(own, given[part], n)) for part in steps(given)]))
            for part in _sliced(block, grams, power):
                yield n, *part

    def probed(row: tuple) -> Iterator[tuple]:
        n, block, number, raw, bits = row
        grams = np.frombuffer(raw, np.uint64)
        yield block, n, number, raw, (Segments(power, [(number, bits)]).levels(grams) if bits else np.zeros(len(grams), np.int8)).tobytes()

    def spread(row: tuple) -> Iterator[tuple]:
        block, seqs, hashes, parts = row
        own, out = _hashes(hashes), []
        for n in range(2, order + 1):
            mine = [p for p in parts if p["n"] == n]
            grams, levels = np.frombuffer(b"".join(p["grams"] for p in mine), np.uint64), np.frombuffer(b"".join(p["levels"] for p in mine), np.int8)
            given = _seqs(seqs)
            out.append(b"".join(levels[np.searchsorted(grams, gram_hashes(own, given[part], n))].tobytes() for part in steps(given)))
        yield block, out

    rows = map_rows(blocks.select("block", "seqs", "hashes"), "n int, segment long, block long, grams binary", lambda: asked, weigh=3)
    met = rows.join(segments, "segment", "left").select("n", "block", "segment", "grams", "bits")
    told = map_rows(met, "block long, n int, segment long, grams binary, levels binary", lambda: probed, flush_rows=64, weigh=3)
    back = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "segment", "grams", "levels"))).alias("parts"))
    return map_rows(blocks.select("block", "seqs", "hashes").join(back, "block"), "block long, levels array<binary>", lambda: spread, flush_rows=1)


@dataclass
class Corpus:
    tokens: int
    types: int


def _ratios(counts: np.ndarray, seqs: list[np.ndarray], levels: list[np.ndarray], out: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 2: the share of the n-gram in its history and the history's power of two, -1 where it is new.

    `out` is 1 where each token is taken out of the counts that score it, else 0.
    """
    if not seqs:
        return
    size = np.array([len(s) for s in seqs])
    flat = np.concatenate(seqs)
    start = np.zeros(len(flat), bool)
    start[np.cumsum(size) - size] = True
    # before the first word of a text stands a start mark, of which there are as many as ends
    before = np.where(start, counts[0], counts[np.roll(flat, 1)]).astype(float)
    for k, level in enumerate(levels):
        if k:
            before = estimates(np.where(start, 0, np.roll(levels[k - 1], 1)))
            before[start] = counts[0]
        met = estimates(level)
        share = np.clip((met - out) / np.maximum(before - out, 1), 0, 1)
        share[before - out <= 0] = 0
        yield share, np.where(before - out > 0, np.frexp(np.maximum(before, 1))[1] - 1, -1)


def _mixed(p: np.ndarray, share: np.ndarray, power: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = np.where(power >= 0, weights[power], 0)
    return w * share + (1 - w) * p


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: Column, order: int = 2, bits: int = 10, block_bytes: int = BLOCK, broadcast_bytes: int = 128 << 20, segment_grams: int = 1 << 19) -> DataFrame:
    """docs(doc_id, text, ...) scored by a model of the rows for which `held_out` is not true.

    n_tokens counts words and the end, n_known those that training documents hold; base_score is the unigram estimate's
    log10, score the model's. The result does not depend on the last three parameters but for errors of the filter.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), ascii_lower(whole_text("text")).alias("text"))
    first = Bucketed(map_stream(given, BLOCKS, lambda: lambda rows: _blocks(rows, block_bytes), flush_rows=1), "block")
    asked = first.df.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("pos", "x"))
    each = Window.partitionBy("x.words")
    # a word is in a block once
    counted = Stored(asked.select("block", "pos", F.sum("x.times").over(each).alias("count"), (F.col("block") == F.min("block").over(each)).alias("once")), "counts")
    corpus = Corpus(first.df.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0], counted.df.where("once and count > 0").count())
    back = counted.df.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "count"))).alias("found"))
    counts = Bucketed(back.select("block", F.col("found.count").alias("counts")), "block")
    counted.drop()
    blocks = first.df.drop("words", "times", "tokens").join(counts.df, "block")

    power = max(6, int(np.ceil(np.log2(max(1, (order - 1) * corpus.tokens / segment_grams)))))
    segments = stored(filter_segments(first.df, order, power, bits), "filter")
    size = segments.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        sent: Broadcast | None = spark.sparkContext.broadcast(Segments(power, segments.toLocalIterator()))
        given = blocks.select("doc_ids", "held", "seqs", "hashes", "counts", F.lit(None).cast("array<binary>").alias("levels"))
    else:
        sent = None
        levels = _levels_by_segment(first.df, segments, order, power)
        given = stored(blocks.join(levels, "block").select("doc_ids", "held", "seqs", F.lit(None).cast("binary").alias("hashes"), "counts", "levels"), "probed")

    def reader() -> Callable[[tuple], Iterator[tuple]]:
        held_filter = sent.value if sent is not None else None

        def f(row: tuple) -> Iterator[tuple]:
            doc_ids, held, raw, hashes, counts, levels = row
            counts, own, at = np.array(counts, np.int64), _hashes(hashes) if held_filter else None, 0
            whole = _seqs(raw)
            for part in steps(whole):
                seqs = whole[part]
                end = at + sum(map(len, seqs))
                found = [held_filter.levels(gram_hashes(own, seqs, n)) for n in range(2, order + 1)] if held_filter else [np.frombuffer(x, np.int8)[at:end] for x in levels]
                yield doc_ids[part], np.array(held[part], bool), seqs, counts, found
                at = end

        return f

    def fitted(weights: list[np.ndarray]) -> np.ndarray:
        """Weights of the next order: for each power, the one of the grid with the largest sum of logs over training tokens."""

        def make() -> Callable[[tuple], Iterable[tuple]]:
            read = reader()

            def stretch(held: np.ndarray, seqs: list[np.ndarray], counts: np.ndarray, levels: list[np.ndarray]) -> Iterator[tuple]:
                taught = np.repeat(~held, [len(s) for s in seqs])
                p = np.maximum(counts[np.concatenate(seqs)], 1) / (corpus.tokens + corpus.types)
                for w, (share, at) in zip([*weights, None], _ratios(counts, seqs, levels, 1), strict=False):
                    if w is None:
                        use = taught & (at >= 0)
                        p, share, at = p[use], share[use], at[use]
                        new, some = share == 0, share > 0
                        alone, many = np.bincount(at[new], np.log10(p[new]), POWERS), np.bincount(at[new], minlength=POWERS)
                        p, share, own = p[some], share[some], at[some]
                        for k, g in enumerate(GRID.tolist()):
                            sums = alone + many * np.log10(1 - g) + np.bincount(own, np.log10(g * share + (1 - g) * p), POWERS)
                            yield from ((int(b), k, float(sums[b])) for b in np.unique(at))
                        return
                    p = _mixed(p, share, at, w)

            return lambda row: (out for _, *part in read(row) for out in stretch(*part))

        sums = map_rows(given, "power int, choice int, total double", make).groupBy("power", "choice").agg(F.sum("total").alias("total")).collect()  # POWERS times the grid at most
        out, best = np.zeros(POWERS), np.full(POWERS, -np.inf)
        for at, choice, total in sorted(sums):
            if total > best[at] + 1e-6 * abs(total):
                out[at], best[at] = GRID[choice], total
        return out

    weights: list[np.ndarray] = []
    for _ in range(2, order + 1):
        weights.append(fitted(weights))

    def scored() -> Callable[[tuple], Iterable[tuple]]:
        read = reader()

        def stretch(doc_ids: list[int | None], held: np.ndarray, seqs: list[np.ndarray], counts: np.ndarray, levels: list[np.ndarray]) -> Iterator[tuple]:
            p = (counts[np.concatenate(seqs)] + 1) / (corpus.tokens + corpus.types + 1)
            base = np.log10(p)
            for w, (share, at) in zip(weights, _ratios(counts, seqs, levels, 0), strict=True):
                p = _mixed(p, share, at, w)
            logs, at = np.log10(p), 0
            for doc_id, h, seq in zip(doc_ids, held.tolist(), seqs, strict=True):
                end = at + len(seq)
                yield doc_id, h, len(seq), int((counts[seq] > 0).sum()), corpus.tokens, float(base[at:end].sum()), float(logs[at:end].sum())
                at = end

        return lambda row: (out for part in read(row) for out in stretch(*part))

    return map_rows(given, SCORES, scored)
