"""The warm index: postings, text and vector search, their merge, and upserts by newest row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def postings(listings: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """listing_key, field, term, tf from text columns; counts meet before the shuffle."""
    rows = None
    for field, column in fields.items():
        part = T.token_rows(listings.select(F.col(key).alias("listing_key"), F.lit(field).alias("field"), F.col(column).alias("_text")), ["listing_key", "field"], "_text")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("listing_key", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def text_search(posted: DataFrame, asked: DataFrame, limit: int = 50) -> DataFrame:
    """posted(listing_key, term, tf), asked(query_id, term), each term once: query_id, listing_key, term_score, the first `limit` a query."""
    scores = posted.join(asked, "term").groupBy("query_id", "listing_key").agg(F.sum("tf").cast("long").alias("term_score"))
    return best_of(scores, "query_id", limit, F.desc("term_score"), F.col("listing_key"))


def best_of(rows: DataFrame, by: str, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows of each `by`; Spark cuts groups before and after the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def _packed(vectors: DataFrame, key: str, vector: str, more: list[str], rows: int, name: str, within: str | None = None) -> DataFrame:
    """Up to `rows` rows as one: width, group, and in binary columns ids, vectors and the columns in `more` as doubles (null: NaN). Rows of one block have one value of `within` (not null), its group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                width, group = pc.list_value_length(part.column(1)).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                for w, g in sorted(set(zip(width.tolist(), group.tolist(), strict=True))):
                    own = part.filter(pa.array((width == w) & (group == g)))
                    flat = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    extra = np.array([own.column(3 + k).to_numpy(zero_copy_only=False) for k in range(len(more))], np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([g]), *(pa.array([x.tobytes()]) for x in (own.column(0).to_numpy().astype(np.int64), flat, extra))], names=[f"{name}_{c}" for c in ("width", "group", "ids", "vectors", "more")])

    good = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    if within:
        good = good.where(F.col(within).isNotNull()).sortWithinPartitions(within)
    group = F.col(within).cast("string") if within else F.lit("")
    return good.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"), group.alias("_group"), *(F.col(c).cast("double") for c in more)).mapInArrow(pack, f"{name}_width int, {name}_group string, {name}_ids binary, {name}_vectors binary, {name}_more binary")


@dataclass
class Block:
    """Queries `q` and vectors `c` (ids) with their vectors and lengths; `q_more` and `c_more` hold a row for each further column.

    `name` is the same for the same queries in every block of a task, where the task gives out something at its end.
    `near`, where asked for, are cosines in single precision, within `slack` of those to six digits; None if some vector is
    zero, not finite or of a length whose square is out of range.
    """

    q: np.ndarray
    c: np.ndarray
    q_rows: np.ndarray
    c_rows: np.ndarray
    q_norm: np.ndarray
    c_norm: np.ndarray
    q_more: np.ndarray
    c_more: np.ndarray
    name: tuple[int, int]
    near: np.ndarray | None = None

    @cached_property
    def cos(self) -> np.ndarray:
        """Cosines to six digits, 0 with a vector of zeros."""
        scale = self.q_norm[:, None] * self.c_norm[None, :]
        none = scale == 0
        scale[none] = 1.0
        cos = self.q_rows @ self.c_rows.T
        cos /= scale
        cos[none] = 0.0
        return np.round(cos, 6, out=cos)

    def cos_of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Those of queries at `i` and vectors at `j`, where `near` is there."""
        return np.round(np.einsum("ij,ij->i", self.q_rows[i], self.c_rows[j]) / (self.q_norm[i] * self.c_norm[j]), 6)

    @property
    def slack(self) -> float:
        """A sum of w products of single precision is off by w + 2 roundings of 2^-24 at most, in any order; four more for thresholds. Six digits are off by 0.5e-6."""
        return (self.q_rows.shape[1] + 6) * 2.0**-24 + 0.51e-6


def reaching(near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what is at least its row's `least`, looked for only in rows whose highest is."""
    low = least.astype(np.float32)
    rows = np.flatnonzero(near.max(axis=1) >= low)
    i, j = np.divmod(np.flatnonzero(near[rows] >= low[rows, None]), near.shape[1])
    return rows[i], j


def gridded(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks dealt over the cells of a square grid, about as many as there are shuffle partitions.

    A left block goes to one row of the grid, in every column; a right one to one column, in every row. Each pair meets
    in one cell, each block is sent as often as the grid is wide, and a cell holds its share of either side only.
    """
    side = max(2, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1)
    whole, share = F.explode(F.sequence(F.lit(0), F.lit(side - 1))), lambda name: F.pmod(F.xxhash64(name), F.lit(side)).cast("int")
    return (
        left.withColumn("q_row", share(left_name)).withColumn("q_column", whole),
        right.withColumn("c_column", share(right_name)).withColumn("c_row", whole),
    )


def cosine_blocks(queries: DataFrame, vectors: DataFrame, key: str, vector: str, score: Callable[[Block], pa.RecordBatch | None], schema: str, q_more: tuple[str, ...] = (), c_more: tuple[str, ...] = (), rows: int = 1024, strip: int = 128, most_queries: int = 50_000, last: Callable[[], Iterator[pa.RecordBatch]] | None = None, within: str | None = None, near: bool = False) -> DataFrame:
    """Every query against every vector in blocks: `score` says what leaves a pair of blocks, `last` what leaves a task at its end.

    A pair is worked on `strip` queries at a time, so that a task holds `strip` times `rows` cosines whatever the tables hold.

    Vectors of other lengths, and null ones, do not meet, nor do those of different values of `within`. Blocks of queries are broadcast up to `most_queries` rows, and
    those of vectors dealt evenly over two tasks a core, however few files hold them; else blocks meet in a grid: see
    `gridded`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w = b.column(0)[k].as_py()
                qi, qv, qm, ci, cv, cm = (np.frombuffer(x, t) if x.size else np.zeros(0, t) for x, t in ((b.column(i)[k].as_buffer(), np.int64 if i in (1, 4) else np.float64) for i in range(1, 7)))
                q, c, name = qv.reshape(-1, w), cv.reshape(-1, w), hash((qi.tobytes(), qv.tobytes())) if last else 0
                q_more, c_more = (x.reshape(-1, len(i)) if len(x) else np.zeros((0, len(i))) for x, i in ((qm, qi), (cm, ci)))
                q_norm, c_norm = (np.sqrt((x * x).sum(axis=1)) for x in (q, c))
                plain = near and all(((1e-140 < x) & (x < 1e140)).all() for x in (q_norm, c_norm))
                q_unit, c_unit = ((x / n[:, None]).astype(np.float32) if plain else None for x, n in ((q, q_norm), (c, c_norm)))
                for at in range(0, len(q), strip):
                    part = slice(at, at + strip)
                    out = score(Block(qi[part], ci, q[part], c, q_norm[part], c_norm, q_more[:, part], c_more, (name, at), q_unit[part] @ c_unit.T if plain else None))
                    if out is not None:
                        yield out
        if last:
            yield from last()

    asked, every = _packed(queries, key, vector, list(q_more), rows, "q", within), _packed(vectors, key, vector, list(c_more), rows, "c", within)
    alike = (F.col("q_width") == F.col("c_width")) & (F.col("q_group") == F.col("c_group"))
    few = queries.limit(most_queries + 1).count() <= most_queries
    if few:
        dealt = every.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
        met = dealt.join(F.broadcast(asked), alike)
    else:
        asked, every = gridded(asked, every, "q_ids", "c_ids")
        met = every.join(asked, alike & (F.col("q_row") == F.col("c_row")) & (F.col("q_column") == F.col("c_column")))
    return met.select("q_width", "q_ids", "q_vectors", "q_more", "c_ids", "c_vectors", "c_more").mapInArrow(run, schema)


class Tops:
    """The `limit` best hits so far of each of the queries `q`, as parallel arrays of place in `q`, id and cosine.

    New hits wait until there are as many as can be kept, so that they are sorted together. `s_last` and `c_last` are
    cosine and id of each query's last place.
    """

    def __init__(self, q: np.ndarray, limit: int, least: float):
        self.q, self.limit, self.waiting = q, limit, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.s_last, self.c_last = np.full(len(q), least), np.full(len(q), np.iinfo(np.int64).max)

    def add(self, c: np.ndarray, cos: np.ndarray) -> None:
        hit = cos >= self.s_last[:, None]
        many = 4 * self.limit * len(self.q)
        if cos.shape[1] > self.limit and np.count_nonzero(hit) > many:  # a first block: what its own last places leave
            own = np.partition(np.where(hit, cos, -np.inf), cos.shape[1] - self.limit, axis=1)
            hit &= cos >= own[:, cos.shape[1] - self.limit, None]
        at = np.flatnonzero(hit)
        if not len(at):
            return
        (i, j), s = np.divmod(at, cos.shape[1]), cos.ravel()[at]
        better = (s > self.s_last[i]) | (c[j] < self.c_last[i])
        self.parts.append((i[better], c[j[better]], s[better]))
        self.waiting += int(better.sum())
        if self.waiting > self.limit * len(self.q):
            self.cut()

    def cut(self) -> None:
        i, c, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((c, -s, i))
        i, c, s = i[order], c[order], s[order]
        at = np.arange(len(i))
        place = at - np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, at, 0))
        end = place == self.limit - 1
        self.s_last[i[end]], self.c_last[i[end]] = s[end], c[end]
        kept = place < self.limit
        self.parts, self.waiting = [(i[kept], c[kept], s[kept])], 0

    def batch(self) -> pa.RecordBatch:
        self.cut()
        i, c, s = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array(self.q[i]), pa.array(c), pa.array(s)], names=["query_id", "listing_key", "s"])


def vector_search(queries: DataFrame, vectors: DataFrame, key: str, vector: str, limit: int = 50, least: float = 0.0) -> DataFrame:
    """query_id, listing_key, descriptor_score: the `limit` listings of largest cosine, `least` at least, for each query.

    A task keeps each query's `limit` best so far and gives them out at its end: at most `limit` rows a query and task,
    however many blocks it meets. Listings have a vector each.
    """
    tops: dict[tuple[int, int], Tops] = {}

    def best(b: Block) -> None:
        if b.name not in tops:
            tops[b.name] = Tops(b.q, limit, least)
        tops[b.name].add(b.c, b.cos)

    def last() -> Iterator[pa.RecordBatch]:
        while tops:
            yield tops.popitem()[1].batch()

    found = cosine_blocks(queries, vectors, key, vector, best, "query_id long, listing_key long, s double", last=last)
    scores = found.groupBy("query_id", "listing_key").agg(F.max("s").alias("descriptor_score"))
    return best_of(scores, "query_id", limit, F.desc("descriptor_score"), F.col("listing_key"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Both lanes by query and listing: text hits with their vector scores, and vector hits that text did not find."""
    met = text_hits.join(vector_hits, ["query_id", "listing_key"], "full")
    return met.select("query_id", "listing_key", F.coalesce("term_score", F.lit(0).cast("long")).alias("term_score"), F.coalesce("descriptor_score", F.lit(0.0)).alias("descriptor_score"))


def newest(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *ties)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows by key, the newest whole; `keep_first` columns keep their earliest value."""
    rows = old.unionByName(new)
    firsts = [F.min(c).over(Window.partitionBy(*keys)).alias(c) for c in keep_first]
    rest = [F.col(c) for c in rows.columns if c not in keep_first]
    return newest(rows.select(*rest, *firsts), keys, at).select(*old.columns)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` are replaced by those in `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_once(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are there already do not come in again; of repeated new rows one does."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


# fixed values: marks of what must not leave a campaign
PRIVATE_MARKS = ["/Users/", "/home/", "file://", "put_private", "user_upload", "\\\\"]


def refused(rows: DataFrame, public: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the index with their public columns only, and those whose payload as JSON holds private paths or markup."""
    payload = F.to_json(F.struct(*public))
    private = F.lower(payload).contains("<html") | F.lower(payload).contains("<script")
    for mark in PRIVATE_MARKS:
        private = private | payload.contains(mark)
    return rows.where(~private).select(*public), rows.where(private)
