"""Limits for whoever runs queries of others: time, cancelling, and requests to remote endpoints."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class Stopped(RuntimeError):
    """A query that was cancelled or ran out of time or requests."""


@dataclass
class Handle:
    """A running query; ``cancel`` may be called from another thread."""

    spark: SparkSession
    group: str = field(default_factory=lambda: f"query-{uuid.uuid4().hex}")
    why: str | None = None

    def cancel(self, why: str = "cancelled") -> None:
        self.why = self.why or why
        self.spark.sparkContext.cancelJobGroup(self.group)


@contextmanager
def governed(spark: SparkSession, seconds: float | None = None) -> Iterator[Handle]:
    """Runs what stands inside as one group of jobs, stopped after ``seconds`` or by the handle.

    Results are lazy, so the block must hold the action that reads them.  Once
    the time is over, jobs that begin later are stopped too.
    """
    handle = Handle(spark)
    context = spark.sparkContext
    before = [context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]
    context.setJobGroup(handle.group, "governed query", interruptOnCancel=True)
    over = threading.Event()

    def watch() -> None:
        if over.wait(seconds):
            return
        while not over.wait(0.05):
            handle.cancel(f"out of time after {seconds} s")

    if seconds is not None:
        threading.Thread(target=watch, daemon=True).start()
    try:
        yield handle
    except Exception as e:
        if handle.why:
            raise Stopped(handle.why) from e
        raise
    finally:
        over.set()
        for k, v in zip(("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"), before, strict=True):
            context.setLocalProperty(k, v)
    if handle.why:
        raise Stopped(handle.why)


def limited(service: Callable, most: int) -> Callable:
    """A transport for SERVICE that refuses more than ``most`` requests."""
    left, lock = [most], threading.Lock()

    def ask(endpoint: str, text: str, names: list[str]):
        with lock:
            if not left[0]:
                raise Stopped(f"more than {most} remote requests")
            left[0] -= 1
        return service(endpoint, text, names)

    return ask
