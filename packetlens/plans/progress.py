"""Progress of a running scan as a file: how much of the landing job's tasks is done, in packets and bytes of the whole."""

from __future__ import annotations

import contextlib
import os
import threading
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession

from packetlens.sources.pcap import count_packets, located


def text(packets: int, size: int, seconds: float, total: int) -> str:
    """progress.json: six keys in fixed order."""
    share = 100.0 * packets / total if total else 0.0
    return (
        f'{{\n  "packets_processed": {packets},\n  "bytes_processed": {size},\n  "time_elapsed": {seconds:.2f},\n'
        f'  "rank": 0,\n  "world_size": 1,\n  "percentage": {share:.1f}\n}}\n'
    )


def _replaced(path: str, content: str) -> None:
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(f"{path}.part", path)


@contextlib.contextmanager
def reported(spark: SparkSession, captures: str, path: str | None, every: float = 0.5) -> Iterator[None]:
    """Writes ``path`` while the jobs started inside run, and once when they are done. No path: nothing.

    The total is counted from record headers before any filter. What is done is the share of the group's tasks that
    have ended: executors report nothing of their own.
    """
    if not path:
        yield
        return
    total, size, began = count_packets(spark, captures), sum(os.path.getsize(x.removeprefix("file://")) for x in located(captures) if "://" not in x), time.time()
    sc, over = spark.sparkContext, threading.Event()
    group = f"scan-{time.time_ns()}"
    sc.setJobGroup(group, "scan of captures")
    tracker = sc.statusTracker()

    def share() -> float:
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
        tasks = [(s.numCompletedTasks, s.numTasks) for s in stages if s]
        return sum(a for a, _ in tasks) / max(1, sum(b for _, b in tasks))

    def run() -> None:
        while not over.wait(every):
            done = share()
            _replaced(path, text(int(done * total), int(done * size), time.time() - began, total))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
    _replaced(path, text(total, size, time.time() - began, total))
