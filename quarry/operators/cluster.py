"""Duplicate listings and reused photographs: keys, edges, connected components, representatives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Written:
    """A DataFrame written below spark.checkpoint.dir and read back, so that its lineage ends there."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/rounds-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """`df` written and read back; it stays until the shared folder is cleared."""
    return Written(df).df


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component), the smallest node: star contraction, each round written to shared storage.

    In a round every node hangs its larger neighbours on its smallest one, then its smaller ones too, until nothing moves.
    A round's table goes when the next one is there; the last stays, as the result reads it.
    """
    last = Written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = last.df
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen, before = mark, last
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last = Written(small.where(F.col("a") > F.col("b")).distinct())
        before.drop()
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def cluster_key(adapter: Column, listing: Column, url: Column) -> Column:
    """Adapter and listing id where there is one, else the canonical URL."""
    return F.when(listing.isNotNull() & (listing != ""), F.concat_ws(":", adapter, listing)).otherwise(F.concat_ws(":", F.lit("url"), url))


def word_classes(rows: DataFrame, key: str, title: str, *more: str) -> DataFrame:
    """id, class, words and the columns in `more`: titles with the same set of words share a class. Titles without words leave."""
    sets = rows.select(F.col(key).alias("id"), *more, F.array_sort(T.title_tokens(F.col(title))).alias("words")).where(F.size("words") > 0)
    return sets.withColumn("class", F.sha2(F.array_join("words", " "), 256))


def near_classes(classes: DataFrame, threshold: float = 0.9) -> DataFrame:
    """classes(class, words), each class once, to (x, y, similarity), x < y: word sets that overlap by `threshold`.

    Only the rarest words of a set can carry a pair: with n words, two sets that reach the threshold share one of the
    first n - ceil(threshold * n) + 1 in the order of rarity. Classes meet on those words, then they are measured.
    """
    each = classes.select("class", F.explode("words").alias("word"))
    weight = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(weight, "word").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda s: s["word"]).alias("words"))
    prefix = F.size("words") - F.ceil(F.lit(threshold) * F.size("words")).cast("int") + 1
    blocks = ranked.select("class", F.size("words").alias("n"), F.explode(F.slice("words", F.lit(1), prefix)).alias("word"))
    a, b = (blocks.select("word", F.col("class").alias(c), F.col("n").alias(f"n_{c}")) for c in "xy")
    met = a.join(b, "word").where((F.col("x") < F.col("y")) & (F.col("n_x") * threshold <= F.col("n_y")) & (F.col("n_y") * threshold <= F.col("n_x"))).select("x", "y").distinct()
    for c in "xy":
        met = met.join(ranked.select(F.col("class").alias(c), F.col("words").alias(f"words_{c}")), c)
    return met.select("x", "y", T.jaccard(F.col("words_x"), F.col("words_y")).alias("similarity")).where(F.col("similarity") >= threshold)


def near_title_pairs(rows: DataFrame, key: str, title: str, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity), a < b, between the smallest ids of classes; members (id, head) of all titles.

    Titles with equal word sets are one class, so that a title which a third of the rows share costs no pairs.
    """
    named = word_classes(rows, key, title)
    heads = named.groupBy("class").agg(F.min("id").alias("head"), F.first("words").alias("words"))
    near = near_classes(heads.select("class", "words"), threshold)
    for c in "xy":
        near = near.join(heads.select(F.col("class").alias(c), F.col("head").alias(f"head_{c}")), c)
    pairs = near.select(F.least("head_x", "head_y").alias("a"), F.greatest("head_x", "head_y").alias("b"), "similarity")
    return pairs, named.join(heads.select("class", "head"), "class").select("id", "head")


def title_edges(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """rows(id, listing, title) to edges (a, b) whose components are those of all near-equal titles with compatible listings.

    Two known, different listings are no edge; an unknown one goes with any. One row stands for each class and listing,
    so edges grow with the rows and not with their pairs.
    """
    named = word_classes(rows, "id", "title", "listing")
    heads = named.groupBy("class", "listing").agg(F.min("id").alias("head"))
    same = named.join(heads, (named["class"] == heads["class"]) & named["listing"].eqNullSafe(heads["listing"])).select(F.col("id").alias("a"), F.col("head").alias("b"))
    classes = named.groupBy("class").agg(F.first("words").alias("words"))
    near = near_classes(classes, threshold).select("x", "y")
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(classes.select(F.col("class").alias("x"), F.col("class").alias("y")))
    left, right = (heads.select(F.col("class").alias(c), F.col("listing").alias(f"listing_{c}"), F.col("head").alias(f"head_{c}")) for c in "xy")
    unknown = both.join(left.where(F.col("listing_x").isNull()), "x").join(right, "y").select(F.col("head_x").alias("a"), F.col("head_y").alias("b"))
    known = both.where(F.col("x") < F.col("y")).join(left, "x").join(right.withColumn("listing_x", F.col("listing_y")), ["y", "listing_x"]).select(F.col("head_x").alias("a"), F.col("head_y").alias("b"))
    return same.unionByName(unknown).unionByName(known).where(F.col("a") != F.col("b")).distinct()


def cluster_listings(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """rows(id, key, family, listing, title) to (id, cluster): equal keys, shared image families, near-equal titles.

    An edge between two known, different listing ids is left out. Clusters are the components of the edges that stay.
    """
    heads = rows.groupBy("key").agg(F.min("id").alias("head"))
    by_key = rows.join(heads, "key").select(F.col("id").alias("a"), F.col("head").alias("b"))
    fam = rows.where(F.col("family").isNotNull())
    first = fam.groupBy("family", "listing").agg(F.min("id").alias("head"))
    unknown = fam.where(F.col("listing").isNull()).groupBy("family").agg(F.min("id").alias("anchor"))
    by_family = fam.join(first, [fam.family == first.family, fam.listing.eqNullSafe(first.listing)]).select(fam.id.alias("a"), F.col("head").alias("b"))
    bridge = first.join(unknown, "family").select(F.col("head").alias("a"), F.col("anchor").alias("b"))
    linked = components(by_key.unionByName(by_family).unionByName(bridge).unionByName(title_edges(rows, threshold)))
    return rows.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def savings(rows: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row: candidates, clusters, duplicates removed and their share."""
    n = clustered.agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("cluster").alias("clusters"))
    keys = rows.agg(F.count_distinct("key").alias("keys"))
    out = n.join(F.broadcast(keys)).select("candidates", "keys", "clusters", (F.col("candidates") - F.col("clusters")).alias("removed"))  # one row
    return out.withColumn("share", F.round(F.try_divide("removed", "candidates"), 6))


def representatives(rows: DataFrame, cluster: str, score: list[str], key: str) -> DataFrame:
    """The row of each cluster that scores highest, later columns deciding ties."""
    return rows.groupBy(cluster).agg(F.max_by(key, F.struct(*score, key)).alias("representative"), F.count(F.lit(1)).alias("members"))


def photo_reuse(images: DataFrame, family: str, seller: str, stock: int = 3) -> DataFrame:
    """family, sellers, reused (two or more), stock_photo (`stock` or more); exact counts."""
    counted = images.where(F.col(family).isNotNull()).groupBy(F.col(family).alias("family")).agg(F.count_distinct(seller).alias("sellers"))
    return counted.select("family", "sellers", (F.col("sellers") >= 2).alias("reused"), (F.col("sellers") >= stock).alias("stock_photo"))


def independent_families(records: DataFrame, by: str, family: str, digest: str) -> DataFrame:
    """by, families: evidence counts once for each family, by its digest where it has none."""
    return records.groupBy(by).agg(F.count_distinct(F.coalesce(F.nullif(F.col(family), F.lit("")), F.col(digest))).alias("families"))


def greedy_distinct(queries: DataFrame, group: str, text: str, order: str, similarity: float = 0.86) -> DataFrame:
    """Queries in order, each kept unless it is near one already kept; a group is one search's few hundred queries."""
    schema = queries.schema

    def keep(pdf):  # noqa: ANN001, ANN202
        kept: list[set[str]] = []
        rows = []
        for i, t in pdf.sort_values(order)[text].items():
            words = set("".join(c for c in t.lower() if c not in "\"'`").split())
            if all((len(words & k) / len(words | k) if words | k else 1.0) < similarity for k in kept):
                kept.append(words)
                rows.append(i)
        return pdf.loc[rows]

    return queries.groupBy(group).applyInPandas(keep, schema)


def split_leak(parts: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that are in more than one split."""
    return parts.groupBy(key).agg(F.count_distinct(split).alias("splits")).where(F.col("splits") > 1)


def first_n(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
