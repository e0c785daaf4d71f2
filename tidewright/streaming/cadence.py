"""Run jobs again and again, each in its own rhythm: bounded streams and monitors."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql.streaming import DataStreamWriter


@dataclass
class Job:
    """Something to run every ``seconds``: a stream over what has come, or any call."""

    seconds: float
    work: Callable[[], object]
    due: float = field(default=0.0)


def run(jobs: Mapping[str, Job], rounds: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict[str, list[str]]:
    """Run every job that is due, then wait for the next; what failed, by job.

    A job that returns a stream writer is run until it has read all there is. A
    failure doesn't keep the others from running, and the job is due again
    after its time. ``rounds`` bounds how often jobs are looked at; without it
    this never ends.
    """
    failed: dict[str, list[str]] = {name: [] for name in jobs}
    done = 0
    while rounds is None or done < rounds:
        for name, job in jobs.items():
            if clock() >= job.due:
                job.due = clock() + job.seconds
                try:
                    if isinstance(made := job.work(), DataStreamWriter):
                        made.start().awaitTermination()
                except Exception as error:  # noqa: BLE001
                    failed[name].append(str(error).splitlines()[0] if str(error) else type(error).__name__)
        done += 1
        if rounds is None or done < rounds:
            sleep(max(0.0, min(j.due for j in jobs.values()) - clock()))
    return failed
