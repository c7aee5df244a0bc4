"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source. A token budget goes down the tree by the children's weights; a
child gets no more than its tokens times `max_epochs`, and what it cannot take goes to its siblings by their weights
first, then to the siblings of its ancestors. A leaf with budget b and s tokens gives b // s whole epochs, then the
longest prefix, in an order seeded by the epoch, whose tokens fit the rest. The prefix is found from sums over bins of
the order, as many as the root of the leaf's rows, so that no task sees a whole leaf.

A token here is a run of characters other than space, tab and line breaks.

Defined results: null or empty text has no tokens; a null domain, language or source is a child of its own named "".
Equal rows are chosen together or not at all, so a leaf may stay short of its budget by less than the tokens of one row
with its repeats; that is not handed on. A tree without tokens, or an empty table, gives an empty result. Columns
named like the result's own (domain, epoch, tokens) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.frames import stored, whole_text

LEVELS = ("domain", "lang", "source")
MOST_LEAVES = 200_000
BIN_ROWS = 1 << 20


@dataclass
class Mix:
    """Weights by path: {("web",): .6, ("web", "en"): .5}; a child without one weighs `default`."""

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    share: float = 0.5  # budget as a part of all tokens, unless `budget` is given
    budget: int | None = None
    max_epochs: int = 2
    seed: int = 17
    default: float = 1.0

    def weight(self, path: tuple[str, ...]) -> float:
        return self.weights.get(path, self.weights.get(("*",) * (len(path) - 1) + path[-1:], self.default))


def split_budget(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Parts in proportion to the weights, none above its room; what does not fit goes to the others."""
    out, live = [0] * len(room), [i for i in range(len(room)) if room[i] > 0 and weights[i] > 0]
    left = min(budget, sum(room[i] for i in live))
    while live and left > 0:
        total = sum(weights[i] for i in live)
        full = [i for i in live if left * weights[i] / total >= room[i] - out[i]]
        if full:
            for i in full:
                left -= room[i] - out[i]
                out[i] = room[i]
            live = [i for i in live if i not in set(full)]
            continue
        exact = [left * weights[i] / total for i in live]
        for i, x in zip(live, exact, strict=True):
            out[i] += int(x)
        rest = left - sum(map(int, exact))
        for i, _ in sorted(zip(live, exact, strict=True), key=lambda p: (int(p[1]) - p[1], p[0])):
            if rest <= 0:
                break
            if out[i] < room[i]:
                out[i] += 1
                rest -= 1
        left = 0
    return out


def budgets(sizes: dict[tuple[str, ...], int], mix: Mix, budget: int) -> dict[tuple[str, ...], int]:
    """Leaf budgets from leaf sizes."""
    room: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for leaf, n in sizes.items():
        for k in range(len(leaf) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0) + n * mix.max_epochs
            if k:
                children.setdefault(leaf[: k - 1], set()).add(leaf[:k])
    out, todo = {}, [((), budget)]
    while todo:
        node, b = todo.pop()
        below = sorted(children.get(node, ()))
        if not below:
            out[node] = b
            continue
        todo += zip(below, split_budget(b, [mix.weight(c) for c in below], [room[c] for c in below]), strict=True)
    return out


def _order(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("_tag"))


def _bin(h: Column, bins: Column) -> Column:
    """Place among `bins` equal parts of the hash's range, rising with the hash as an unsigned number."""
    return F.floor(F.shiftrightunsigned(h, 32) * bins / F.lit(float(1 << 32))).cast("int")


def _key(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(-(2**63)))  # sorts as the unsigned hash


def mix_sources(docs: DataFrame, mix: Mix, domain: Column) -> DataFrame:
    """The rows of docs that the mix takes, with domain, epoch (0 first) and tokens; a row comes once an epoch."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("domain", "epoch", "tokens")]
    text = whole_text("text")
    counted = docs.withColumn("_domain", F.coalesce(domain, F.lit("")))
    counted = counted.select(*(F.col(f"`{c}`") for c in own), F.col("_domain").alias("domain"), F.xxhash64(text).alias("_tag"), F.regexp_count(text, F.lit("[^ \\t\\n\\x0b\\f\\r]+")).cast("long").alias("tokens"))
    leaf = [F.col("domain"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")]
    keys = ["domain", "_lang", "_source"]
    small = stored(counted.select("doc_id", "_tag", "tokens", *leaf), "tokens")
    stats = small.groupBy(*keys).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MOST_LEAVES + 1).collect()
    if len(stats) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves")
    sizes = {(r[0], r[1], r[2]): r["n"] for r in stats}
    total = sum(sizes.values())
    given = budgets(sizes, mix, mix.budget if mix.budget is not None else int(mix.share * total))
    plan = [(*k, given[k] // sizes[k] if sizes[k] else 0, given[k] % sizes[k] if sizes[k] else 0, max(isqrt(r["rows"]) + 1, -(-r["rows"] // BIN_ROWS))) for r in stats for k in [(r[0], r[1], r[2])]]
    plan = spark.createDataFrame(plan, "domain string, _lang string, _source string, _whole int, _rest long, _bins long")
    ordered = small.join(F.broadcast(plan), keys)  # at most MOST_LEAVES rows
    ordered = ordered.withColumn("_h", _order(mix.seed, F.col("_whole"))).withColumn("_bin", _bin(F.col("_h"), F.col("_bins")))
    sums = ordered.where(F.col("_rest") > 0).groupBy(*keys, "_rest", "_bin").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = sums.withColumn("_upto", F.sum("n").over(w)).where(F.col("_upto") > F.col("_rest")).groupBy(*keys).agg(F.min("_bin").alias("_edge"), F.min_by(F.col("_upto") - F.col("n"), "_bin").alias("_before"))
    edge = stored(edge, "edges")
    inside = ordered.join(F.broadcast(edge), keys).where(F.col("_bin") == F.col("_edge"))
    near = inside.withColumn("_upto", F.col("_before") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy(_key(F.col("_h")), "doc_id", "_tag")))
    last = near.where(F.col("_upto") <= F.col("_rest")).groupBy(*keys).agg(F.max(F.struct(_key(F.col("_h")).alias("h"), "doc_id", F.col("_tag").alias("tag"))).alias("_last"))
    cut = stored(edge.join(last, keys, "left").select(*keys, "_edge", "_last"), "cuts")
    rows = counted.withColumn("_lang", leaf[1]).withColumn("_source", leaf[2]).join(F.broadcast(plan), keys).join(F.broadcast(cut), keys, "left")
    h = _order(mix.seed, F.col("_whole"))
    mine = F.struct(_key(h).alias("h"), F.col("doc_id"), F.col("_tag").alias("tag"))
    place = _bin(h, F.col("_bins"))
    taken = F.col("_edge").isNotNull() & ((place < F.col("_edge")) | ((place == F.col("_edge")) & F.coalesce(mine <= F.col("_last"), F.lit(False))))
    epochs = F.col("_whole") + F.when(taken, 1).otherwise(0)
    rows = rows.withColumn("_epochs", epochs).where(F.col("_epochs") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
    return rows.select(*(F.col(f"`{c}`") for c in own), "domain", "epoch", "tokens")
