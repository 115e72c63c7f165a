"""Repeated scans: a full scan each time, and an incremental one over a stream of file versions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from glintsieve.plans import scan


def watch(scan_once: Callable[[], int], count: int | None = None, seconds: float = 1.0) -> Iterator[int]:
    """Exit codes of scans, one every `seconds`; ends after `count` of them or at an error of use (2)."""
    done = 0
    while count is None or done < count:
        code = scan_once()
        done += 1
        yield code
        if code == 2:
            return
        if count is None or done < count:
            time.sleep(seconds)


def incremental(versions: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, settings: scan.Settings | None = None):
    """A streaming query over file versions (path, content, at): each version is scanned once, late repeats within an hour are dropped."""
    fresh = versions.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["path", "content"])

    def batch(frame: DataFrame, number: int) -> None:
        handle(scan.scan(frame.select("path", "content"), settings), number)

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
