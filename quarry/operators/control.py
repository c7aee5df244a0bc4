"""Campaigns that can be stopped: their Spark jobs carry a tag, a control log says which are cancelled, and results are committed at the end.

A campaign writes below a folder that nobody reads until its commit names it. So one that is cancelled, or lost, leaves
its tables as they were. Any driver that shares the folder may ask for a cancellation.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from quarry.operators.commits import CommitLog

Work = Callable[[SparkSession], DataFrame]


class Cancelled(Exception):
    """The campaign was cancelled; its tables are as before."""


class Campaigns:
    """Results of campaigns below one folder that drivers and executors share."""

    def __init__(self, spark: SparkSession, path: str, poll: float = 0.2):
        self.spark, self.path, self.poll = spark, path, poll
        self.control, self.results = CommitLog(spark, f"{path}/_control"), CommitLog(spark, f"{path}/_log")

    def cancel(self, search_id: str) -> None:
        """Ask for the end of a campaign that runs, here or on another driver, or has not begun."""
        while not self.control.put(max(self.control.versions(), default=0) + 1, {"cancel": search_id}):
            pass

    def cancelled(self) -> set[str]:
        return {e["cancel"] for e in self.control.entries()}

    def run(self, search_id: str, work: Work) -> int:
        """Write what `work` returns and commit it; the number of its commit. Raises Cancelled if it was cancelled before that."""
        sc, tag, over = self.spark.sparkContext, f"quarry-{search_id}-{uuid.uuid4().hex}", threading.Event()
        if search_id in self.cancelled():
            raise Cancelled(search_id)

        def watch() -> None:
            while not over.wait(self.poll):
                if search_id in self.cancelled():
                    sc.cancelJobsWithTag(tag)  # again and again: a job may begin after a cancellation

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        folder = f"data/{search_id}-{uuid.uuid4().hex}"
        sc.addJobTag(tag)
        try:
            work(self.spark).write.parquet(f"{self.path}/{folder}")
        except Exception as e:
            if search_id not in self.cancelled():
                raise
            self.results.delete(f"{self.path}/{folder}")
            raise Cancelled(search_id) from e
        finally:
            sc.removeJobTag(tag)
            over.set()
            watcher.join()
        while True:
            if search_id in self.cancelled():
                self.results.delete(f"{self.path}/{folder}")
                raise Cancelled(search_id)
            version = max(self.results.versions(), default=0) + 1
            if self.results.put(version, {"search_id": search_id, "folder": folder}):
                return version

    def run_all(self, works: dict[str, Work]) -> dict[str, str]:
        """Run campaigns side by side, each in a thread of its own: complete, cancelled or failed by campaign."""
        ends: dict[str, str] = {}

        def one(search_id: str, work: Work) -> None:
            try:
                self.run(search_id, work)
                ends[search_id] = "COMPLETE"
            except Cancelled:
                ends[search_id] = "CANCELLED"
            except Exception:  # the campaign's own; others go on
                ends[search_id] = "FAILED"

        threads = [InheritableThread(target=one, args=x) for x in works.items()]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        return ends

    def result(self, search_id: str) -> DataFrame | None:
        """The last committed result of a campaign, None if it has none."""
        folders = [e["folder"] for e in self.results.entries() if e["search_id"] == search_id]
        return self.spark.read.parquet(f"{self.path}/{folders[-1]}") if folders else None
