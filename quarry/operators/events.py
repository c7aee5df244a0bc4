"""The event log: sequence, resume, chain, streaks, breakers, budgets, frontier and state machine."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(events: DataFrame, stream: str, order: list[str], after: int = 0) -> DataFrame:
    """n: place in the stream from 1; rows after place `after`."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(stream).orderBy(*order))).where(F.col("n") > after)


def last_row(events: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """Each stream's last row, with one aggregate and no sort."""
    rest = [c for c in events.columns if c != stream]
    return events.groupBy(stream).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(stream, "_r.*")


def chain_ok(events: DataFrame, stream: str, event: str, predecessor: str, order: list[str]) -> DataFrame:
    """(stream, ok): every predecessor is the event before, the first has none."""
    before = F.lag(event).over(Window.partitionBy(stream).orderBy(*order))
    return events.withColumn("_ok", F.col(predecessor).eqNullSafe(before)).groupBy(stream).agg(F.bool_and("_ok").alias("ok"))


def failure_streaks(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """streak: failures in a row up to each row, 0 after a success."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("_fail", failed).withColumn("_island", F.sum(F.when(F.col("_fail"), 0).otherwise(1)).over(run))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("streak", F.sum(F.when(F.col("_fail"), 1).otherwise(0)).over(inside)).drop("_fail", "_island")


def breaker(streaks: DataFrame, key: str, order: list[str], at: str, blocked: Column, failures: int = 3, hours: int = 4) -> DataFrame:
    """opened_until: four hours after the last row that opened the breaker, unless a success came later; null if shut."""
    opens = (F.col("streak") >= failures) | blocked
    last = F.struct(*order)
    opened = F.max(F.when(opens, last))
    shut = F.max(F.when((F.col("streak") == 0) & ~blocked, last))
    when_open = F.max_by(F.when(opens, F.col(at)), F.when(opens, last))
    sums = streaks.groupBy(key).agg(opened.alias("_o"), shut.alias("_s"), when_open.alias("_at"))
    open_now = F.col("_o").isNotNull() & (F.col("_s").isNull() | (F.col("_s") < F.col("_o")))
    return sums.select(key, F.when(open_now, F.col("_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("opened_until"))


def budget(events: DataFrame, stream: str, order: list[str], amount: str, ceiling: float) -> DataFrame:
    """used: running sum in order; refused where it passes the ceiling (reaching it is allowed)."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("used", F.sum(amount).over(w)).withColumn("refused", F.col("used") > ceiling)


def tumbling(events: DataFrame, at: str, width: str, *aggregates: Column) -> DataFrame:
    """start and the aggregates of each window of `width`."""
    return events.groupBy(F.window(at, width).alias("w")).agg(*aggregates).withColumn("start", F.col("w.start")).drop("w")


# fixed values: states of a campaign and where each may go; all but the last five may also be cancelled or fail
STATES = {
    "CREATED": ["VALIDATING_INPUT"], "VALIDATING_INPUT": ["INGESTING_REFERENCES"], "INGESTING_REFERENCES": ["CALIBRATING_REFERENCES"], "CALIBRATING_REFERENCES": ["DECOMPOSING_REFERENCES"], "DECOMPOSING_REFERENCES": ["FORMING_HYPOTHESES"],
    "FORMING_HYPOTHESES": ["PLANNING_QUERIES"], "PLANNING_QUERIES": ["PLANNING_SOURCES"], "PLANNING_SOURCES": ["DISCOVERING"], "DISCOVERING": ["ACQUIRING", "REPLANNING", "PARTIAL"], "ACQUIRING": ["NORMALIZING", "DISCOVERING", "PARTIAL"],
    "NORMALIZING": ["DEDUPLICATING", "PARTIAL"], "DEDUPLICATING": ["BROAD_RETRIEVAL", "PARTIAL"], "BROAD_RETRIEVAL": ["FINE_MATCHING", "GAP_ANALYSIS", "PARTIAL"], "FINE_MATCHING": ["AUTHENTICITY_REVIEW", "GAP_ANALYSIS", "PARTIAL"],
    "AUTHENTICITY_REVIEW": ["LIVE_CHECKING", "PARTIAL"], "LIVE_CHECKING": ["RANKING", "PARTIAL"], "RANKING": ["PUBLISHING", "PARTIAL"], "PUBLISHING": ["GAP_ANALYSIS", "COMPLETE", "PARTIAL"], "GAP_ANALYSIS": ["REPLANNING", "COMPLETE", "PARTIAL"],
    "REPLANNING": ["PLANNING_QUERIES", "PLANNING_SOURCES", "DISCOVERING", "COMPLETE"], "COMPLETE": [], "PARTIAL": [], "BLOCKED": [], "FAILED": [], "CANCELLED": [],
}
# fixed values: faults of the engine itself; only they may end a campaign as failed
INTERNAL_FAULTS = ["INTERNAL_INVARIANT", "DATABASE", "STORAGE", "MODEL", "BROWSER"]


def legal_moves() -> list[tuple[str, str]]:
    """All moves between states. Every state that can be left may be cancelled or fail, and all but the first be blocked."""
    return [(s, t) for s, forward in STATES.items() if forward for t in [*forward, "CANCELLED", "FAILED", *(["BLOCKED"] if s != "CREATED" else [])]]


def move_fault(source: Column, target: Column) -> Column:
    """Why a move is not legal, or null."""
    ended = source.isin([s for s, forward in STATES.items() if not forward])
    return F.when(ended, "terminal").when(~F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in legal_moves()]), "illegal")


def invariant_fault(target: Column, has_query: Column, has_visual: Column, normalised: Column, seller_only: Column, has_evidence: Column, receipt: Column, error: Column, reason: Column) -> Column:
    """Which of the five guards a move breaks, or null: a query before discovery, candidates before matching, more than a
    seller's words before review, a receipt before completion, a fault of the engine before failure."""
    nothing_found = F.lower(F.coalesce(reason, F.lit(""))).rlike("no match|zero match")
    return (
        F.when((target == "DISCOVERING") & ~(has_query | has_visual), "no_query").when((target == "FINE_MATCHING") & (normalised < 1), "no_candidates").when((target == "AUTHENTICITY_REVIEW") & (seller_only | ~has_evidence), "seller_text_alone")
        .when((target == "COMPLETE") & ~receipt, "no_receipt").when((target == "FAILED") & (~F.coalesce(error.isin(INTERNAL_FAULTS), F.lit(False)) | nothing_found), "no_internal_fault")
    )


def illegal_moves(events: DataFrame, stream: str, state: str, order: list[str], legal: list[tuple[str, str]]) -> DataFrame:
    """Steps from one state to the next that are not legal; staying is."""
    spark = events.sparkSession
    steps = events.withColumn("_from", F.lag(state).over(Window.partitionBy(stream).orderBy(*order))).where(F.col("_from").isNotNull() & (F.col("_from") != F.col(state)))
    edges = spark.createDataFrame(legal, f"_from string, {state} string")
    return steps.join(F.broadcast(edges), ["_from", state], "left_anti").withColumnRenamed("_from", "came_from")


def frontier_batch(frontier: DataFrame, limit: int, most_depth: int = 3) -> DataFrame:
    """The next entries: queued, not too deep, each work key once and none that ended already; by priority, then age."""
    ended = frontier.where(F.col("state").isin("DONE", "FAILED", "BLOCKED")).select("work_key").distinct()
    queued = frontier.where((F.col("state") == "QUEUED") & (F.col("depth") <= most_depth)).join(ended, "work_key", "left_anti")
    one = queued.groupBy("work_key").agg(F.min_by(F.struct(*queued.columns), F.struct(-F.col("priority"), F.col("created_at"))).alias("r")).select("r.*")
    return one.orderBy(F.desc("priority"), "created_at", "work_key").limit(limit)


def recovered(frontier: DataFrame, now: Column, stale: int = 30) -> DataFrame:
    """Entries in flight for longer than `stale` seconds are queued again."""
    old = (F.col("state") == "INFLIGHT") & (F.unix_timestamp(now) - F.unix_timestamp("claimed_at") > stale)
    return frontier.withColumn("state", F.when(old, "QUEUED").otherwise(F.col("state")))


def health_state(outcome: Column, failures: Column, circuit_open: Column, disabled: Column) -> Column:
    """State of a source after an outcome, the gravest first."""
    return (
        F.when(disabled, "POLICY_DISABLED").when(circuit_open | (outcome == "BLOCKED_BY_ACCESS"), "BLOCKED").when(outcome == "SOURCE_UNAVAILABLE", "UNAVAILABLE")
        .when(outcome == "PARSER_FAILED", "PARSER_DRIFT").when((failures > 0) | (outcome == "RATE_LIMITED"), "DEGRADED").otherwise("HEALTHY")
    )


# fixed value: pages that every source may take
PAGE_FLOOR = 2


def page_share(remaining: Column, sources: Column) -> Column:
    """Pages a source may take from a catalogue: an even share, the floor at least, none when nothing is left."""
    share = F.greatest(F.lit(PAGE_FLOOR), F.floor(remaining / F.greatest(sources, F.lit(1))))
    return F.when((remaining <= 0) | (sources <= 0), 0).otherwise(share).cast("int")


def exploration_allowance(remaining: Column, sources: Column) -> Column:
    """Pages held for each source before any may spend more: the floor where it fits all, else an even share."""
    return F.when((remaining <= 0) | (sources <= 0), 0).when(PAGE_FLOOR * sources <= remaining, PAGE_FLOOR).otherwise(F.floor(remaining / F.greatest(sources, F.lit(1)))).cast("int")


Step = Callable[[dict, dict], object]


def folded(rows: DataFrame, by: str, order: list[str], result: str, kind: str, start: Callable[[], dict], step: Step) -> DataFrame:
    """`rows` with column `result`: `step(state, row)` called row by row in order, with a state of its own for each `by`.

    For rules whose every step hangs on what the step before decided. A group is what one campaign or host did.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*rows.schema.fields, *_parse_datatype_string(f"{result} {kind}").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state = pdf.sort_values(order, kind="stable"), start()
        pdf[result] = [step(state, row) for row in pdf.to_dict("records")]
        return pdf

    return rows.groupBy(by).applyInPandas(run, schema)


DIMENSIONS = ["wall_seconds", "sources", "pages", "browser_pages", "images", "model_calls", "bytes", "retries", "storage", "monetary"]


def budget_ledger(moves: DataFrame, ceilings: dict[str, float], campaign: str = "campaign", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """moves(campaign, seq, move, reservation, amounts map<string, double>) with `verdict`: ok, closed, or the dimension whose ceiling would be crossed.

    A reservation holds its amounts until it is committed or released, once; what is refused holds nothing. Reaching a
    ceiling is allowed, and a dimension without one has none.
    """

    def step(state: dict, row: dict) -> str:
        held, used = state.setdefault("open", {}), state.setdefault("used", dict.fromkeys(DIMENSIONS, 0.0))
        if row["move"] == "reserve":
            asked = dict(row["amounts"] or {})
            for d in DIMENSIONS:
                if asked.get(d) and used[d] + asked[d] > ceilings.get(d, float("inf")):
                    return d
            for d, x in asked.items():
                used[d] += x
            held[row["reservation"]] = asked
            return "ok"
        if (own := held.pop(row["reservation"], None)) is None:
            return "closed"
        if row["move"] == "release":
            for d, x in own.items():
                used[d] -= x
        return "ok"

    return folded(moves, campaign, list(order), "verdict", "string", dict, step)


def exploration(claims: DataFrame, sources: list[str], pages: int, campaign: str = "campaign", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """claims(campaign, seq, source, finished) with `taken`: whether the source gets another page; a finished source frees what was held for it.

    Each of `sources` has an allowance of its own, beyond which it may only take what is not held for others.
    """
    share = PAGE_FLOOR if sources and PAGE_FLOOR * len(sources) <= pages else pages // max(1, len(sources))

    def step(state: dict, row: dict) -> bool:
        taken, done = state.setdefault("taken", dict.fromkeys(sources, 0)), state.setdefault("done", set())
        if row["finished"]:
            done.add(row["source"])
            return False
        left, own = pages - sum(taken.values()), taken.get(row["source"], 0)
        others = sum(max(0, share - n) for s, n in taken.items() if s != row["source"] and s not in done)
        ok = left > 0 and (share <= 0 or own < share or left > others)
        taken[row["source"]] = own + ok
        return bool(ok)

    return folded(claims, campaign, list(order), "taken", "boolean", dict, step)


def bandwidth(charges: DataFrame, rate: int, host: str = "host", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """charges(host, at double seconds, bytes) with `wait` in seconds: what goes over `rate` in a second that starts with its first charge."""

    def step(state: dict, row: dict) -> float:
        if rate <= 0:
            return 0.0
        if "start" not in state or row["at"] - state["start"] >= 1.0:
            state["start"], state["used"] = row["at"], 0
        state["used"] += row["bytes"]
        return max(0.0, (state["used"] - rate) / rate)

    return folded(charges, host, list(order), "wait", "double", dict, step)


def token_bucket(calls: DataFrame, rate: float, burst: float, host: str = "host", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """calls(host, at double seconds) with `wait` in seconds: a bucket starts empty, fills at `rate` up to `burst`, and a call takes one token."""

    def step(state: dict, row: dict) -> float:
        now = max(row["at"], state.get("at", row["at"]))
        tokens = min(burst, state.get("tokens", 0.0) + (now - state.get("at", now)) * rate)
        if tokens >= 1.0:
            state["tokens"], state["at"] = tokens - 1.0, now
            return now - row["at"]
        wait = (1.0 - tokens) / rate if rate > 0 else 1.0
        state["tokens"], state["at"] = 0.0, now + wait
        return now + wait - row["at"]

    return folded(calls, host, list(order), "wait", "double", dict, step)
