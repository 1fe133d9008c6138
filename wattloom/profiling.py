"""What a command costs: wall and CPU time of its steps on the driver, and what Spark's status store says of their tasks.

A step is a job group: the tasks that its jobs ran, their time, shuffle and spill are read from Spark's own figures when it
ends. ``step`` costs nothing while no profile is open.
"""

from __future__ import annotations

import json
import platform
import resource
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import catalog

GROUP, DESCRIPTION = "spark.jobGroup.id", "spark.job.description"
#: How long a step waits for Spark to hear of its last tasks.
WAIT_MS = 10_000


@dataclass
class Step:
    """A step's figures; ``tasks`` and those after it are the executors' share, without Python workers' CPU."""

    name: str
    wall_s: float = 0.0
    cpu_s: float = 0.0
    max_rss_mb: float = 0.0
    rows: int | None = None
    jobs: int = 0
    tasks: int = 0
    task_s: float = 0.0
    task_cpu_s: float = 0.0
    shuffle_mb: float = 0.0
    spill_mb: float = 0.0


@dataclass
class Profile:
    spark: SparkSession
    command: str
    steps: list[Step] = field(default_factory=list)
    started: float = field(default_factory=time.perf_counter)
    total_wall_s: float = 0.0

    @contextmanager
    def step(self, name: str, rows: int | None = None) -> Iterator[Step]:
        """A step of the command, also if it fails; the job group around it comes back afterwards."""
        out = Step(name, rows=rows)
        self.steps.append(out)
        sc, group = self.spark.sparkContext, f"{name}-{uuid.uuid4().hex}"
        before = {k: sc.getLocalProperty(k) for k in (GROUP, DESCRIPTION)}
        wall, cpu = time.perf_counter(), time.process_time()
        sc.setLocalProperty(GROUP, group)
        sc.setLocalProperty(DESCRIPTION, f"{self.command}: {name}")
        try:
            yield out
        finally:
            out.wall_s, out.cpu_s, out.max_rss_mb = time.perf_counter() - wall, time.process_time() - cpu, peak_rss_mb()
            for k, v in before.items():
                sc.setLocalProperty(k, v)
            _count_tasks(self.spark, group, out)

    def record(self, root: str) -> None:
        """Adds the run to the catalog."""
        row = [(self.command, self.total_wall_s, peak_rss_mb(), platform.python_version(), json.dumps([asdict(s) for s in self.steps]))]
        catalog.record(root, "profile_run", self.spark.createDataFrame(row, "command string, total_wall_s double, peak_rss_mb double, python string, stages string"))


def peak_rss_mb() -> float:
    """The driver's Python process: kilobytes, but bytes on macOS."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (2**20 if sys.platform == "darwin" else 2**10)


def _count_tasks(spark: SparkSession, group: str, out: Step) -> None:
    """Adds what the group's stages did; a stage that the store no longer holds, or that was skipped, adds nothing."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(WAIT_MS)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) is not None for s in info.stageIds}
    out.jobs = len(jobs)
    for s in stages:
        try:
            d = store.lastStageAttempt(s)
        except Py4JError:
            continue
        out.tasks += d.numCompleteTasks()
        out.task_s += d.executorRunTime() / 1e3
        out.task_cpu_s += d.executorCpuTime() / 1e9
        out.shuffle_mb += d.shuffleWriteBytes() / 2**20
        out.spill_mb += d.diskBytesSpilled() / 2**20


_open: ContextVar[Profile | None] = ContextVar("profile", default=None)


@contextmanager
def profiled(spark: SparkSession, command: str, root: str | None = None) -> Iterator[Profile]:
    """A profile that ``step`` adds to; recorded in the catalog at ``root`` at the end, also if the command fails."""
    out = Profile(spark, command)
    token = _open.set(out)
    try:
        yield out
    finally:
        _open.reset(token)
        out.total_wall_s = time.perf_counter() - out.started
        if root is not None:
            out.record(root)


@contextmanager
def step(name: str, rows: int | None = None) -> Iterator[Step | None]:
    """A step of the open profile, if there is one."""
    profile = _open.get()
    if profile is None:
        yield None
        return
    with profile.step(name, rows) as out:
        yield out


def stages_of(runs: DataFrame) -> DataFrame:
    """(command, recorded_at, place, and a stage's figures) of profiled runs as ``catalog.profiles`` gives them."""
    return runs.select("command", "recorded_at", F.posexplode("stages").alias("place", "s")).select("command", "recorded_at", "place", "s.*")


def stage_totals(stages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Repeated stages as one row a name: times and rows add up, memory is the highest, ``first`` is where it first came.

    A figure that is null counts as none; ``rows`` is 0 where no call counted any.
    """
    sums = [c for c in ("wall_s", "cpu_s", "task_s", "shuffle_mb", "spill_mb") if c in stages.columns]
    return stages.groupBy(*(by or []), "name").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums],
        F.max("max_rss_mb").alias("max_rss_mb"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("*").alias("calls"),
        F.min("place").alias("first"),
    )
