"""Near copies by the Jaccard similarity of word shingles: every pair at 4/5 or more is found, and its sets are compared.

A text is the set of its shingles of `width` words (XXH64 hashes). The Gray-order index of `hamming` finds texts whose
SimHash fingerprints over that set are within `radius` bits. Fingerprints that near miss many pairs at 4/5, so a prefix
filter finds the rest: in any order that holds for all texts, two sets of Jaccard 4/5 share a shingle among the first
n - ceil(4n/5) + 1 of each, and texts meet on those only. Common shingles come last in that order; which are listed as
common decides the work, never the result.

Pairs are compared in three rounds, so that a group of copies costs work for its texts and not for its pairs. First each
text is compared with what its fingerprint found and with the smallest text it meets. Then each with the likeliest of
those it meets outside its component. Last all pairs that meet and are in different components still.

No pair is linked unseen. Odd sketches are compared first: a set's shingles fall on a power of two of bits, and a bit
says whether an odd number did. Two sketches cannot differ in more bits than the sets differ in shingles, so what is
dropped here is never a link. What remains has its sets compared.

Defined results: texts without words are copies of each other; fewer words than a shingle make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.frames import Stored, small_batches, stored, whole_text
from quarry.llm.hamming import hamming_links
from quarry.llm.simhash import word_slabs

COMMON = 100_000
#: Bits of the sketch that travels with every place where texts meet.
FOLD = 512


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """The set of a text's shingles, ascending."""
    digest, out = xxhash.xxh64_intdigest, []
    for k, words in enumerate(word_slabs(data, width)):
        text = b" ".join(words)
        if len(words) < width:
            if words and not k:
                out.append(digest(text))
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        out.extend([digest(text[a:b]) for a, b in zip((ends - size)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])
    return np.unique(np.array(out, np.uint64))


def set_digest(own: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(own.tobytes()), "big", signed=True)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sets is 4/5 or more."""
    if not len(a) and not len(b):
        return True
    both = np.sort(np.concatenate([a, b]))
    return bool(9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * len(both))


def set_print(own: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)


def odd_sketch(own: np.ndarray, bits: int | None = None) -> bytes:
    """One bit for each of `bits` places (a power of two, the first that is n or more): whether an odd number of shingles falls there."""
    m = bits or 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer is folded to the other's length. Never more than the sets differ in."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, ascending, and about how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.encode(), width) for t in b.column(0).to_pylist()]
            if own:
                h, c = np.unique(np.concatenate(own), return_counts=True)
                h, c = h[c >= 4], c[c >= 4]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    rows = docs.select(whole_text("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(COMMON).collect()
    h, c = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def in_order(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set with common shingles last, the most common at the end."""
    if not len(common[0]):
        return own
    at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
    return own[np.lexsort((own, np.where(common[0][at] == own, common[1][at], 0)))]


def _postings(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, digest, number of shingles n of every row, its sketch and fingerprint with a digest's first row of a batch;
    and for each digest of a batch the shingles h at place `at` of n on which it meets others."""
    common = _common(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, digests, hs, own_n, seen, at, size, sketches, folds, prints = b.column(0).to_pylist(), [], [], [], {}, [], [], [], [], []
            for t in b.column(1).to_pylist():
                own = shingles(t.encode(), width)
                digests.append(d := set_digest(own))
                own_n.append(len(own))
                sketches.append(None if d in seen else odd_sketch(own))
                folds.append(None if d in seen else odd_sketch(own, FOLD))
                prints.append(None if d in seen else set_print(own))
                if d not in seen:
                    first = in_order(own, common)[: len(own) - -(-4 * len(own) // 5) + 1] if len(own) else own
                    seen[d] = len(first)
                    hs.append(first)
                    at.append(np.arange(len(first), dtype=np.int32))
                    size.append(np.full(len(first), len(own), np.int32))
            n, m = len(docs), sum(map(len, hs))
            none = np.zeros(n, np.int32)
            keyed = np.repeat(np.array(list(seen), np.int64), np.array(list(seen.values()), np.int64))
            cols = [pa.array(docs + [None] * m, pa.int64()), pa.array(np.concatenate([np.array(digests, np.int64), keyed]))]
            cols += [pa.array(np.concatenate([np.zeros(n, np.int64), *(h.view(np.int64) for h in hs)])), pa.array(np.concatenate([none, *at])), pa.array(np.concatenate([np.array(own_n, np.int32), *size]))]
            cols += [pa.array(x + [None] * m, kind) for x, kind in ((sketches, pa.binary()), (folds, pa.binary()), (prints, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "h", "at", "n", "sketch", "fold", "print"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", whole_text("text")).mapInArrow(run, "doc_id long, digest long, h long, at int, n int, sketch binary, fold binary, print long")


def _near(at: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that can still share enough if this is the first shingle they share."""
    return 9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j])


def _groups(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """Rows sorted by (h, digest), repeats left out, in pieces that end with a whole group."""
    held = np.empty(0, kind)

    def single(rows: np.ndarray) -> np.ndarray:
        return rows[np.concatenate([[True], (rows["h"][1:] != rows["h"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1])])]

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.empty(b.num_rows, kind)
        for c in kind.names:
            rows[c] = np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(len(rows), -1) if c == "fold" else b.column(c).to_numpy()
        rows = np.concatenate([held, rows])
        last = np.searchsorted(rows["h"], rows["h"][-1])
        if last:
            yield single(rows[:last])
        held = rows[last:]
    if len(held):
        yield single(held)


_PLACE = np.dtype([(c, "i8") for c in ("h", "digest", "at", "n")])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every group of two or more: each row again, with the smallest digest of its group as `first` if the two are near."""
    for rows in _groups(batches, _PLACE):
        start = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
        own = np.cumsum(start) - 1
        size, head = np.bincount(own)[own], np.nonzero(start)[0][own]
        every = np.arange(len(rows))
        first = _near(rows["at"], rows["n"], head, every) & (head != every)
        kept = size > 1
        yield pa.RecordBatch.from_arrays([pa.array(rows[c][kept]) for c in _PLACE.names] + [pa.array(rows["digest"][head][kept], mask=~first[kept])], names=[*_PLACE.names, "first"])


def _differing(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a group in different components whose sketches allow a link, with their cost; if `best`, of each row the cheapest."""
    kind = np.dtype([*((c, "i8") for c in ("h", "digest", "at", "n", "root")), ("fold", "u8", (FOLD // 64,))])

    def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        own, a, b, cost = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cost)], names=["own", "a", "b", "cost"])

    found, held = [], 0
    for rows in _groups(batches, kind):
        edge = np.concatenate([[0], np.nonzero(rows["h"][1:] != rows["h"][:-1])[0] + 1, [len(rows)]])
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            g = rows[s:e]
            roots, code, size = np.unique(g["root"], return_inverse=True, return_counts=True)
            if len(roots) < 2:
                continue
            most = int(size.argmax())
            every, rest = np.arange(len(g)), np.nonzero(code != most)[0]
            step = max(1, 2_000_000 // len(g))
            for k in range(0, len(rest), step):
                i = rest[k : k + step]
                ok = (code[i][:, None] != code[None, :]) & ((code == most)[None, :] | (every[None, :] > i[:, None]))
                p, j = np.nonzero(ok)
                good = _near(g["at"], g["n"], i[p], j)
                p, j = p[good], j[good]
                far = np.zeros(len(p), np.int64)
                for w in range(FOLD // 64):
                    far += np.bitwise_count(g["fold"][i[p], w] ^ g["fold"][j, w])
                whole = g["n"][i[p]] + g["n"][j]
                good = 9 * far <= whole
                p, j, cost = p[good], j[good], (far / np.maximum(whole, 1))[good]
                if best and len(p):
                    order = np.lexsort((j, cost, p))
                    order = order[np.concatenate([[True], p[order][1:] != p[order][:-1]])]
                    p, j, cost = p[order], j[order], cost[order]
                found.append((g["digest"][i[p]], g["digest"][i[p]], g["digest"][j], cost))
                held += len(p)
                if held > 200_000:
                    yield out(found)
                    found, held = [], 0
    if found:
        yield out(found)


def _by_shingle(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "h").sortWithinPartitions("h", "digest")


def _possible(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sketches allow a Jaccard of 4/5."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x, y = ((b.column(2).to_numpy() + b.column(3).to_numpy()).tolist(), *(b.column(k).to_pylist() for k in (4, 5)))
            ok = [9 * apart(u, v) <= size for u, v, size in zip(x, y, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (each.select(F.col("digest").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").where(9 * F.least("a_n", "b_n") >= 4 * (F.col("a_n") + F.col("b_n")))
    return both.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(check, "a long, b long")


def _printed(each: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of digests with equal fingerprints, by their smallest, or fingerprints within `radius` bits."""
    heads = stored(each.groupBy("print").agg(F.min("digest").alias("head")), "heads")
    equal = each.join(heads, "print").where(F.col("digest") > F.col("head")).select(F.col("head").alias("a"), F.col("digest").alias("b"))
    links = hamming_links(heads.select("print"), radius)
    for c in ("u", "v"):
        links = links.join(heads.select(F.col("print").alias(c), F.col("head").alias(f"{c}_head")), c)
    return equal.unionByName(links.select(F.least("u_head", "v_head").alias("a"), F.greatest("u_head", "v_head").alias("b")).distinct())


def _verified(pairs: DataFrame, docs: DataFrame, each: DataFrame, width: int) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar, as u, v."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.encode(), width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["digest", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    needed = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    texts = docs.select("doc_id", whole_text("text").alias("text")).join(each.join(needed, "digest").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = Stored(texts.select("text").mapInArrow(sets, "digest long, own binary").groupBy("digest").agg(F.first("own").alias("own")), "sets")
    left, right = (own.df.select(F.col("digest").alias(c), F.col("own").alias(f"{c}_own")) for c in ("a", "b"))
    links = Stored(pairs.join(left, "a").join(right, "b").select("a", "b", "a_own", "b_own").mapInArrow(check, "u long, v long"), "links")
    own.drop()
    return links.df


def near_copies(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs of Jaccard 4/5 or more); doc_id must not be null."""
    small_batches(docs.sparkSession)
    made = stored(_postings(docs, width), "postings")
    rows = made.where(F.col("doc_id").isNotNull())
    prints = rows.select("doc_id", "digest")
    each = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), *(F.first(c, True).alias(c) for c in ("sketch", "fold", "print"))), "distinct")
    places = made.where(F.col("doc_id").isNull()).select("h", "digest", *(F.col(c).cast("long").alias(c) for c in ("at", "n")))
    met = Stored(_by_shingle(places).mapInArrow(_stars, "h long, digest long, at long, n long, first long"), "met")

    def compared(pairs: DataFrame) -> tuple[Stored, DataFrame]:
        tried = Stored(pairs.select("a", "b").distinct(), "pairs")
        return tried, _verified(stored(_possible(tried.df, each), "possible"), docs, each, width)

    def named(roots: DataFrame) -> DataFrame:
        placed = met.df.drop("first").join(each.select("digest", "fold"), "digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        return _by_shingle(placed.select("h", "digest", "at", "n", F.coalesce("root", "digest").alias("root"), "fold"))

    kind = "own long, a long, b long, cost double"
    stars = met.df.where("first IS NOT NULL").groupBy("digest").agg(F.min("first").alias("first")).select(F.col("first").alias("a"), F.col("digest").alias("b"))
    first, links = compared(stars.unionByName(_printed(each, radius)))
    roots = stored(components(links), "roots")
    likely = named(roots).mapInArrow(lambda it: _differing(it, True), kind).groupBy("own").agg(F.min(F.struct("cost", "a", "b")).alias("p")).select("p.a", "p.b")
    second, more = compared(likely.join(first.df, ["a", "b"], "left_anti"))
    links = links.unionByName(more)
    roots = stored(components(links), "roots")
    rest = named(roots).mapInArrow(lambda it: _differing(it, False), kind).select("a", "b").distinct()
    third, more = compared(rest.join(first.df.unionByName(second.df), ["a", "b"], "left_anti"))
    if more.limit(1).count():
        roots = stored(components(links.unionByName(more)), "roots")
    for done in (met, first, second, third):
        done.drop()
    named_each = each.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named_each.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named_each.join(least, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, all columns as they are.

    Rows without doc_id stay; of rows that repeat a doc_id one stays.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    stay = near_copies(named, width).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = named.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
