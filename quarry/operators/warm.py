"""The warm index as stored tables: listings by version, postings in order of impact, descriptors, evidence, queries run.

A put writes a batch's tables into a folder of its own and then commits them at once (see `commits`): readers follow the
log, so a put that was killed between tables is not seen, one that is run again changes nothing, and of two writers of
one batch one is refused. A batch that puts a listing again lists the rows it replaces, and a reader leaves those out;
`compact` writes all that lives as one batch and drops the rest.

Postings of one version and term lie in blocks of up to `BLOCK` listings, highest counts first, each with its highest
count. A document with a score of x has, for each of its terms, its block's highest count plus the highest counts of the
query's other terms at x or more. So a search takes the first block of each term, has a lower bound of its last place
from them, and then reads only blocks that can reach it. Rows are dealt by ranges of version, term and count: a term that
most listings hold is many blocks in several files.

A put takes texts apart once, a slice of them at a time, and leaves a row for each term and count of a slice with the
listings that have it, so that rows, not occurrences, are sorted and moved.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.functions.records import VERSIONS
from quarry.operators import index
from quarry.operators.cluster import Written, checkpoint_dir, written
from quarry.operators.commits import CommitLog, Conflict

BLOCK = 512
#: Bytes of text that are taken apart at once, and listings in one row of counts at most.
SLICE, PACK = 8 << 20, 256
#: Rows of (query, term) up to which they are broadcast; more meet the postings in a shuffle.
FEW = 50_000
#: `keys`, `batches` and `tfs` are parallel. `fields` holds the counts of each field beside them; null if they are all in that one.
#: `first` and `first_batch` are those of a block's first entry and name it within its tag and term.
POSTINGS = "tag long, term string, most long, n int, first long, first_batch long, keys array<long>, batches array<long>, tfs array<long>, fields map<string,array<long>>"
#: Counts of a slice: rows with a term list the listings with one count of it, rows with a listing_key the vector of its hashed terms.
COUNTED = "tag long, term string, tf long, keys array<long>, counts array<long>, listing_key long, hashed array<double>"
#: What a search reads of them.
BLOCKS = ["tag", "term", "most", "n", "first", "first_batch", "keys", "batches", "tfs"]
LISTINGS = "batch long, listing_key long, canonical_url string, content_digest string, availability string, first_seen_at timestamp, updated_at timestamp, " + ", ".join(f"{v} string" for v in VERSIONS)
DESCRIPTORS = "batch long, listing_key long, kind string, dim int, descriptor array<double>"
REPLACED = "batch long, listing_key long, old long"
EVIDENCE = "batch long, listing_key long, hypothesis_digest string, item_match double, authenticity double, completeness double"
QUERIES = "batch long, ior_key string, source_id string, query_norm string, pages long"
TABLES = {"postings": POSTINGS, "listings": LISTINGS, "descriptors": DESCRIPTORS, "replaced": REPLACED, "evidence": EVIDENCE, "queries": QUERIES}


def version_tag(*versions: Column) -> Column:
    """One number for the exact versions under which a listing was read."""
    return F.xxhash64(*(F.coalesce(v, F.lit("")) for v in versions))


WORD = np.where(np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)), np.arange(256), 32).astype(np.uint8)
SHORT_YEARS = pa.array([f"{y:02}" for y in range(31)])


@lru_cache(1 << 18)
def _bucket(term: str) -> int:
    """As `vectors.term_bucket`."""
    return int.from_bytes(hashlib.sha256(term.encode()).digest()[:4], "big") % V.DIM


def _starts(new: np.ndarray, most: int) -> np.ndarray:
    """Where runs begin, whose first rows are marked in `new`, and where a run has to be cut after every `most` rows."""
    at = np.arange(len(new))
    return np.nonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0)[0]


def _lists(values: np.ndarray | pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values))


def _words(text: pa.Array) -> pa.ListArray:
    """Runs of a-z and 0-9 of each text, which is lower-case; with empty ones."""
    text = text.cast(pa.string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    kept = WORD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), pa.py_buffer(at - at[0]), pa.py_buffer(kept)))


def _tokens(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and term, row and field of each token, as `text.tokens` has them; a column of texts is one field."""
    words = [_words(t) for t in texts]
    length = [pc.list_value_length(w).to_numpy() for w in words]
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in length])
    field = np.repeat(np.arange(len(words)), [n.sum() for n in length])
    each = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
    base, at = each.dictionary, each.indices.to_numpy()
    size = pc.binary_length(base).to_numpy()
    good = (size > 1) & ~pc.is_in(base, pa.array(T.STOP)).to_numpy(zero_copy_only=False)
    short = pc.is_in(base, SHORT_YEARS).to_numpy(zero_copy_only=False)
    years = np.nonzero(good & (short | ((size == 4) & pc.starts_with(base, "20").to_numpy(zero_copy_only=False))))[0]
    other = pa.array(["20" + y if len(y) == 2 else y[2:] for y in base.take(pa.array(years)).to_pylist()], pa.string())
    both = pa.concat_arrays([base, other]).dictionary_encode()
    year = np.full(len(base), -1)
    year[years] = both.indices.to_numpy()[len(base) :]
    is_term, also = good[at], year[at] >= 0
    return both.dictionary, np.concatenate([at[is_term], year[at[also]]]), np.concatenate([row[is_term], row[also]]), np.concatenate([field[is_term], field[also]])


def _counted(fields: int, scaled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(listing_key, tag, a lower-case text for each field) to COUNTED; vectors `scaled` to length 1, or as sums."""
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def nothing(n: int, *types: pa.DataType) -> list[pa.Array]:
        return [pa.nulls(n, t) for t in types]

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, tag = (b.column(i).to_numpy() for i in (0, 1))
        terms, term, row, field = _tokens([b.column(2 + i) for i in range(fields)])
        if not len(term):
            return
        code, n = np.unique((term.astype(np.int64) * b.num_rows + row) * fields + field, return_counts=True)
        new = np.nonzero(np.diff(code // fields, prepend=-1))[0]
        tf, each = np.add.reduceat(n, new), np.zeros((len(new), fields), np.int64)
        each[np.cumsum(np.diff(code // fields, prepend=-1) != 0) - 1, code % fields] = n
        term, row = np.divmod(code[new] // fields, b.num_rows)
        bucket = np.array([_bucket(t) for t in terms.to_pylist()], np.int64)
        hashed = np.bincount(row * V.DIM + bucket[term], tf, b.num_rows * V.DIM).reshape(-1, V.DIM)
        some = np.nonzero(hashed.any(axis=1))[0]
        hashed = hashed[some] / np.sqrt((hashed[some] ** 2).sum(axis=1))[:, None] if scaled else hashed[some]
        vectors = _lists(hashed.ravel(), np.arange(len(some)) * V.DIM)
        yield pa.RecordBatch.from_arrays([*nothing(len(some), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), pa.array(key[some]), vectors], names)
        version = np.unique(tag, return_inverse=True)[1][row]
        order = np.lexsort((-tf, term, version))
        term, row, tf, each, version = term[order], row[order], tf[order], each[order], version[order]
        same = (term[1:] == term[:-1]) & (version[1:] == version[:-1]) & (tf[1:] == tf[:-1])
        first = _starts(np.concatenate([[True], ~same]), PACK)
        counts = _lists(each.ravel(), first * fields) if fields > 1 else _lists(each[:0, 0], np.zeros(len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(tag[row[first]]), terms.take(pa.array(term[first])), pa.array(tf[first]), _lists(key[row], first), counts, *nothing(len(first), pa.int64(), pa.list_(pa.float64()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = sum(pc.binary_length(b.column(2 + i)).to_numpy().astype(np.int64) for i in range(fields))
            cuts = np.nonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))[0].tolist()
            for start, end in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                yield from count(b.slice(start, end - start))

    return run


def _packed(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tag, term, batch, tf, keys, counts) sorted by tag, term and falling tf as blocks; a block holds one term of one tag and ends with its Arrow batch."""
    names = ["tag", "term", "most", "n", "first", "first_batch", "keys", "batches", "tfs", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("keys")).to_numpy())
            tag, term = b.column("tag").to_numpy(), b.column("term").dictionary_encode().indices.to_numpy()
            change = np.concatenate([[True], (tag[1:] != tag[:-1]) | (term[1:] != term[:-1])])
            first = _starts(change[of] & np.concatenate([[True], of[1:] != of[:-1]]), BLOCK)
            keys, batch, tf = b.column("keys").flatten().to_numpy(), b.column("batch").to_numpy()[of], b.column("tf").to_numpy()[of]
            heads = [b.column(c).take(pa.array(of[first])) for c in ("tag", "term", "tf")]
            size = np.diff(np.append(first, len(keys)))
            if len(fields) > 1:  # a block's counts field by field
                start, length = np.repeat(first, size), np.repeat(size, size)
                flat, at = np.empty(len(keys) * len(fields), np.int64), np.arange(len(keys))
                each = b.column("counts").flatten().to_numpy().reshape(-1, len(fields))
                for i in range(len(fields)):
                    flat[start * len(fields) + i * length + at - start] = each[:, i]
                counts = _lists(flat, np.concatenate([[0], np.cumsum(np.repeat(size, len(fields)))[:-1]]))
            else:
                counts = pa.nulls(len(first), pa.list_(pa.int64()))
            parts = pa.MapArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * len(fields)), pa.array(fields * len(first), pa.string()), counts)
            yield pa.RecordBatch.from_arrays([*heads, pa.array(size.astype(np.int32)), pa.array(keys[first]), pa.array(batch[first]), *(_lists(x, first) for x in (keys, batch, tf)), parts], names)

    return run


def _entries(fields: list[str] | None = None) -> Column:
    """The entries of a block as listing_key, batch, tf and, with `fields`, the counts of each."""
    empty = F.transform("tfs", lambda _: F.lit(0).cast("long"))
    more = [F.when(F.map_contains_key("fields", f), F.coalesce(F.try_element_at("fields", F.lit(f)), F.col("tfs"))).otherwise(empty).alias(f"c{i}") for i, f in enumerate(fields or [])]
    return F.inline(F.arrays_zip(F.col("keys").alias("listing_key"), F.col("batches").alias("batch"), F.col("tfs").alias("tf"), *more))


class WarmIndex:
    """An index below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{checkpoint_dir(spark)}/warm-{uuid.uuid4().hex}"
        self.log = CommitLog(spark, f"{self.path}/_log")

    def _live(self) -> list[dict]:
        """Commits whose rows count: those that no later one has taken in."""
        entries = self.log.entries()
        gone = {v for e in entries for v in e.get("takes_in", [])}
        return [e for e in entries if e["version"] not in gone]

    def _read(self, name: str, entries: list[dict] | None = None) -> DataFrame:
        folders = [f"{self.path}/{e['tables'][name]}" for e in (self._live() if entries is None else entries) if name in e["tables"]]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*folders)

    def _write(self, name: str, rows: DataFrame, folder: str) -> str:
        where = f"data/{folder}/{name}"
        rows.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.parquet(f"{self.path}/{where}")
        return where

    def _known(self, batch: int, token: str) -> bool:
        """Whether this batch is committed; by another writer it is a conflict."""
        for e in self.log.entries():
            if batch in e.get("batches", []):
                if e["tokens"][str(batch)] != token:
                    raise Conflict(f"batch {batch} was committed by another writer")
                return True
        return False

    def _blocks(self, posted: DataFrame, fields: list[str]) -> DataFrame:
        """posted(tag, term, batch, tf, keys, counts), of each key its count in each of several fields, as blocks."""
        order = [F.col("tag"), F.col("term"), F.desc("tf"), F.get("keys", 0), F.col("batch")]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return posted.repartitionByRange(n, *order).sortWithinPartitions(*order).select("tag", "term", "batch", "tf", "keys", "counts").mapInArrow(_packed(fields), POSTINGS)

    def _fields(self, entries: list[dict]) -> list[str]:
        return sorted({f for e in entries for f in e.get("fields", [])})

    def put(self, listings: DataFrame, fields: dict[str, str], batch: int, vectors: DataFrame | None = None, token: str | None = None) -> bool:
        """listings(listing_key, canonical_url, content_digest, availability, first_seen_at, updated_at, the versions, the text
        columns named in `fields`), with descriptors of photographs in vectors(listing_key, descriptor) and a hashed vector of the terms.

        False, and nothing changes, if the batch is there by the same `token` (the writer's; the batch itself if none is
        given). Raises Conflict if another token has put it. Of rows for one listing those of the highest batch live,
        whichever was committed last.
        """
        token, number = token or str(batch), F.lit(batch).cast("long")
        if self._known(batch, token):
            return False
        names, tag = sorted(fields), version_tag(*(F.col(v) for v in VERSIONS))
        rows = listings.select(F.col("listing_key").cast("long"), tag.alias("tag"), *(F.lower(T.without_instructions(F.col(fields[f]))).alias(f"t{i}") for i, f in enumerate(names)))
        repeated = not listings.groupBy("listing_key").count().where("count > 1").isEmpty()
        if repeated:  # a listing's rows of one tag are one
            rows = rows.groupBy("listing_key", "tag").agg(*(F.array_join(F.collect_list(f"t{i}"), " ").alias(f"t{i}") for i in range(len(names))))
        counted = Written(rows.mapInArrow(_counted(len(names), not repeated), COUNTED))
        folder = f"{batch}-{uuid.uuid4().hex}"
        tables = {"postings": self._write("postings", self._blocks(counted.df.where(F.col("term").isNotNull()).withColumn("batch", number), names), folder)}
        hashed = counted.df.where(F.col("listing_key").isNotNull()).select("listing_key", "hashed")
        if repeated:
            sums = hashed.select("listing_key", F.posexplode("hashed").alias("at", "n")).groupBy("listing_key", "at").agg(F.sum("n").alias("n"))
            hashed = sums.groupBy("listing_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("hashed"))  # V.DIM entries
            hashed = hashed.withColumn("z", V.norm(F.col("hashed"))).select("listing_key", F.transform("hashed", lambda n: n / F.col("z")).alias("hashed"))
        text = hashed.select("listing_key", F.lit("hashed_text").alias("kind"), F.lit(V.DIM).alias("dim"), F.col("hashed").alias("descriptor"))
        if vectors is not None:
            text = text.unionByName(vectors.select("listing_key", F.lit("image").alias("kind"), F.size("descriptor").alias("dim"), F.col("descriptor").cast("array<double>").alias("descriptor")))
        tables["descriptors"] = self._write("descriptors", text.withColumn("batch", number), folder)
        counted.drop()
        tables["listings"] = self._write("listings", listings.withColumn("batch", number), folder)
        while True:  # once more if another writer commits meanwhile: what this batch replaces has to be seen then
            if self._known(batch, token):
                self.log.delete(f"{self.path}/data/{folder}")
                return False
            version, now = self._next(), self._live()
            if any("listings" in e["tables"] for e in now):
                there = self.listings_of(now).select("listing_key", "batch").join(listings.select("listing_key").distinct(), "listing_key", "left_semi")
                older = there.select("listing_key", F.least("batch", number).alias("old"))
                tables["replaced"] = self._write("replaced", older.withColumn("batch", number), f"{folder}/{version}")
            if self.log.put(version, {"batches": [batch], "tokens": {str(batch): token}, "tables": tables, "fields": names}):
                return True

    def _next(self) -> int:
        return max(self.log.versions(), default=0) + 1

    def _replaced(self, entries: list[dict]) -> DataFrame | None:
        """(listing_key, batch) of rows that a later batch put again; None if there are none."""
        if not any("replaced" in e["tables"] for e in entries):
            return None
        return self._read("replaced", entries).select("listing_key", F.col("old").alias("batch")).distinct()

    def _current(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        """Of rows(listing_key, batch, ...) those that no later batch replaced."""
        gone = self._replaced(entries)
        return rows if gone is None else rows.join(gone, ["listing_key", "batch"], "left_anti")

    def compact(self) -> bool:
        """All that lives as one commit, without what was replaced; data that no commit names goes. False if another writer came first."""
        entries = self._live()
        if not entries:
            return False
        folder, version = f"compact-{uuid.uuid4().hex}", max(e["version"] for e in entries) + 1
        fields = self._fields(entries)
        several = fields if len(fields) > 1 else []
        live = self._current(self._read("postings", entries).select("tag", "term", _entries(several)), entries)
        counts = F.array(*(f"c{i}" for i in range(len(several)))).cast("array<long>")
        tables = {"postings": self._write("postings", self._blocks(live.select("tag", "term", "batch", "tf", F.array("listing_key").alias("keys"), counts.alias("counts")), fields), folder)}
        tables["listings"] = self._write("listings", self.listings_of(entries), folder)
        tables["descriptors"] = self._write("descriptors", self._current(self._read("descriptors", entries), entries), folder)
        for name, keys in (("evidence", ["listing_key", "hypothesis_digest"]), ("queries", ["ior_key"])):
            tables[name] = self._write(name, self._newest(self._read(name, entries), *keys), folder)
        batches = sorted({b for e in entries for b in e["batches"]})
        tokens = {k: t for e in entries for k, t in e["tokens"].items()}
        if not self.log.put(version, {"batches": batches, "tokens": tokens, "tables": tables, "fields": fields, "takes_in": [e["version"] for e in entries]}):
            self.log.delete(f"{self.path}/data/{folder}")
            return False
        return True

    def vacuum(self) -> list[str]:
        """Delete folders that no live commit names: what was compacted away or never committed. No put may be running."""
        named = {where.split("/")[1] for e in self._live() for where in e["tables"].values()}
        gone = [f for f in self.log.folders(f"{self.path}/data") if f not in named]
        for f in gone:
            self.log.delete(f"{self.path}/data/{f}")
        return gone

    def drop(self) -> None:
        self.log.delete(self.path)

    def _newest(self, rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")

    def listings_of(self, entries: list[dict]) -> DataFrame:
        """The newest row of each listing, first sight kept, with its batch."""
        rows = self._read("listings", entries)
        gone = self._replaced(entries)
        if gone is None:
            return rows
        first = rows.groupBy("listing_key").agg(F.min("first_seen_at").alias("first_seen_at"))
        return self._current(rows, entries).drop("first_seen_at").join(first, "listing_key")

    def listings(self) -> DataFrame:
        return self.listings_of(self._live()).drop("batch")

    def count(self) -> DataFrame:
        return self._read("listings").agg(F.count_distinct("listing_key").alias("n"))

    def by_url(self, urls: DataFrame, versions: dict[str, str]) -> DataFrame:
        """The newest listing of each canonical_url under exactly these versions."""
        same = self._read("listings").where(F.forall(F.array(*(F.col(v) == F.lit(versions[v]) for v in VERSIONS)), lambda x: x))
        w = Window.partitionBy("canonical_url").orderBy(F.desc("updated_at"), "listing_key")
        return same.join(urls.select("canonical_url").distinct(), "canonical_url", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "batch")

    def point(self, listing_key: int) -> DataFrame:
        return self.listings().where(F.col("listing_key") == listing_key)

    def descriptors(self, keys: DataFrame | None = None, kind: str | None = None) -> DataFrame:
        entries = self._live()
        rows = self._current(self._read("descriptors", entries), entries)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        return (rows if keys is None else rows.join(keys.select("listing_key").distinct(), "listing_key", "left_semi")).drop("batch")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """listing_key, field, term, tf; with `terms` only of those, which Parquet looks up."""
        entries = self._live()
        rows = self._read("postings", entries)
        rows = rows if terms is None else rows.where(F.col("term").isin(terms))
        fields = self._fields(entries)
        if len(fields) == 1:
            return self._current(rows.select("term", _entries()), entries).select("listing_key", F.lit(fields[0]).alias("field"), "term", "tf")
        each = self._current(rows.select("term", _entries(fields)), entries)
        parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("tf")) for i, f in enumerate(fields))) if fields else F.array().cast("array<struct<field:string,tf:long>>")
        return each.select("listing_key", "term", F.inline(parts)).where(F.col("tf") > 0).select("listing_key", "field", "term", "tf")

    def _scores(self, blocks: DataFrame, entries: list[dict]) -> DataFrame:
        """blocks(query_id, keys, batches, tfs) to query_id, listing_key, term_score."""
        return self._current(blocks.select("query_id", _entries()), entries).groupBy("query_id", "listing_key").agg(F.sum("tf").cast("long").alias("term_score"))

    def search_many(self, asked: DataFrame, limit: int = 50, versions: dict[str, str] | None = None) -> DataFrame:
        """asked(query_id, term) to query_id, listing_key, term_score: the first `limit` of each query, exactly.

        The postings are read once, for the blocks of the terms asked for, which are written and read back: all else
        works on those. Blocks that cannot reach a query's last place are not exploded.
        """
        entries = self._live()
        asked = asked.select("query_id", "term").distinct()
        few = asked.limit(FEW + 1).count() <= FEW
        small = F.broadcast if few else lambda rows: rows
        every = self._tagged(self._read("postings", entries), versions).select(*BLOCKS)
        blocks = written(every.join(small(asked.select("term").distinct()), "term", "left_semi"))
        bounds = self._bounds(blocks, asked, limit, entries, few)
        met = blocks.join(small(bounds), "term").where(F.col("most") >= F.col("cut"))
        return index.best_of(self._scores(met, entries), "query_id", limit, F.desc("term_score"), F.col("listing_key"))

    def _tagged(self, blocks: DataFrame, versions: dict[str, str] | None) -> DataFrame:
        return blocks if versions is None else blocks.where(F.col("tag") == version_tag(*(F.lit(versions[v]) for v in VERSIONS)))

    def _bounds(self, blocks: DataFrame, asked: DataFrame, limit: int, entries: list[dict], few: bool = False) -> DataFrame:
        """query_id, term, cut: the least highest count with which a block of the term can reach the query's last place.

        The last place is at least that among the listings of each term's highest blocks, by the counts in those.
        """
        name = ["most", "n", "tag", "first", "first_batch"]
        tops = blocks.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.max(F.struct(*name)).alias("head"))
        heads = asked.join(tops, "term").select("query_id", "term", "head.*", F.col("head.most").alias("top"))
        first = index.best_of(self._scores(blocks.join(F.broadcast(heads) if few else heads, ["term", *name]).select("query_id", "keys", "batches", "tfs"), entries), "query_id", limit, F.desc("term_score"), F.col("listing_key"))
        last = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= limit, F.min("term_score")).otherwise(0).alias("reach"))
        total = heads.groupBy("query_id").agg(F.sum("top").alias("total"))
        return heads.select("query_id", "term", "top").join(last, "query_id", "left").join(total, "query_id").select("query_id", "term", (F.coalesce("reach", F.lit(0)) - F.col("total") + F.col("top")).alias("cut"))

    def search(self, terms: list[str], limit: int = 50, versions: dict[str, str] | None = None) -> DataFrame:
        """listing_key, term_score of one query's terms; with `versions` only of listings read under them.

        The bounds of the terms are known before the scan, so that terms and highest counts are pushed into Parquet.
        """
        entries = self._live()
        blocks = self._tagged(self._read("postings", entries), versions).where(F.col("term").isin(terms))
        asked = self.spark.createDataFrame([(0, t) for t in dict.fromkeys(terms)], "query_id long, term string")
        can = F.lit(False)
        for r in self._bounds(blocks, asked, limit, entries).collect():  # a row a term
            can = can | ((F.col("term") == r.term) & (F.col("most") >= r.cut))
        scores = self._scores(blocks.where(can).withColumn("query_id", F.lit(0)), entries).drop("query_id")
        return scores.orderBy(F.desc("term_score"), "listing_key").limit(limit)

    def hybrid_many(self, asked: DataFrame, vectors: DataFrame, limit: int = 50) -> DataFrame:
        """Both lanes of asked(query_id, term) and vectors(listing_key, descriptor), the queries' own descriptors."""
        hits = index.vector_search(vectors, self.descriptors(kind="image"), "listing_key", "descriptor", limit)
        return index.hybrid(self.search_many(asked, limit), hits)

    def remember(self, evidence: DataFrame, queries: DataFrame, batch: int, token: str | None = None) -> bool:
        """What a campaign learnt: evidence(listing_key, hypothesis_digest, bounds) and queries(ior_key, source_id, query_norm, pages)."""
        token, folder, number = token or str(batch), f"{batch}-{uuid.uuid4().hex}", F.lit(batch).cast("long")
        if self._known(batch, token):
            return False
        tables = {name: self._write(name, rows.withColumn("batch", number), folder) for name, rows in (("evidence", evidence), ("queries", queries))}
        while not self.log.put(self._next(), {"batches": [batch], "tokens": {str(batch): token}, "tables": tables}):
            if self._known(batch, token):
                return False
        return True

    def evidence(self) -> DataFrame:
        return self._newest(self._read("evidence"), "listing_key", "hypothesis_digest").drop("batch")

    def queries_run(self) -> DataFrame:
        return self._newest(self._read("queries"), "ior_key").drop("batch")


_kept: dict[tuple[str, str, str], WarmIndex] = {}


def prepared(spark: SparkSession, source: str, name: str) -> WarmIndex:
    """The index of this session that is kept for an input under a name; empty the first time. It goes with the session."""
    key = spark.sparkContext.applicationId, source, name
    if key not in _kept:
        _kept[key] = WarmIndex(spark)
        atexit.register(_forget, _kept[key])
    return _kept[key]


def _forget(warm: WarmIndex) -> None:
    try:
        warm.drop()
    except Exception:  # the JVM may have ended before the interpreter
        return


def descriptor_of(embedding: Column, histogram: Column, fingerprint: Column) -> Column:
    """The strongest descriptor there is: an embedding, else a colour histogram, else a hashed vector of the fingerprint's parts of four."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(fingerprint) - 1) / 4).cast("int")), lambda i: F.substr(fingerprint, i * 4 + 1, F.lit(4)))
    some = lambda a: F.when(F.size(a) > 0, a.cast("array<double>"))
    return F.coalesce(some(embedding), some(histogram), F.when(F.length(fingerprint) > 0, V.hashed_vector(parts)))


def query_terms(request: Column, more: Column) -> Column:
    """Terms of a request and of its hypotheses, each once, in order."""
    return F.array_distinct(F.flatten(F.array(T.tokens(request), T.tokens(F.array_join(more, " ")))))
