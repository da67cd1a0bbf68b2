"""What the driver and the executors' hosts offer, and the resources of recognition."""

from __future__ import annotations

import os
import shutil
import socket
import subprocess
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: words in the names of graphics units of their own, and of those built in
DISCRETE = ["NVIDIA", "GeForce", "RTX", "GTX", "Quadro", "Radeon RX", "Radeon Pro", "Radeon(TM) RX", "Arc"]
INTEGRATED = ["Intel(R) UHD", "Intel(R) HD", "Intel(R) Iris", "Intel(R) Xe", "Radeon Vega", "Radeon(TM) Graphics", "Microsoft Basic Render"]


@dataclass
class Profile:
    cpu_cores: int
    memory_gb: float
    has_gpu: bool
    gpu_name: str
    parallelism: int

    def summary(self) -> str:
        graphics = self.gpu_name or "no graphics unit of its own: recognition runs on the processor"
        return f"{self.cpu_cores} cores, {self.parallelism} tasks at once, {self.memory_gb:.1f} GB of memory; {graphics}"


def is_discrete(name: str) -> bool:
    named = lambda words: any(w.lower() in name.lower() for w in words)
    return not named(INTEGRATED) and named(DISCRETE)


def is_discrete_column(name: Column) -> Column:
    named = lambda words: reduce(lambda a, w: a | F.contains(F.lower(name), F.lit(w.lower())), words, F.lit(False))
    return ~named(INTEGRATED) & named(DISCRETE)


def gpu_names() -> list[str]:
    def said(*command: str) -> list[str]:
        if not shutil.which(command[0]):
            return []
        try:
            return subprocess.run(command, capture_output=True, text=True, timeout=10).stdout.splitlines()
        except (OSError, subprocess.TimeoutExpired):
            return []

    own = [x.strip() for x in said("nvidia-smi", "--query-gpu=name", "--format=csv,noheader") if x.strip()]
    listed = [x.split(":", 1)[-1].strip() for x in said("lspci") if any(w in x for w in ("VGA", "3D", "Display"))]
    return own + [x for x in listed if is_discrete(x)]


def memory_gb() -> float:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30 if hasattr(os, "sysconf") else 0.0


def profile(spark: SparkSession) -> Profile:
    names = gpu_names()
    return Profile(os.cpu_count() or 1, memory_gb(), bool(names), names[0] if names else "", spark.sparkContext.defaultParallelism)


def profile_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([asdict(profile(spark))], "cpu_cores int, memory_gb double, has_gpu boolean, gpu_name string, parallelism int")


def host_table(spark: SparkSession, slots: int | None = None) -> DataFrame:
    """host, cpu_cores, memory_gb, has_gpu, gpu_name, slots: a row a host of the executors.

    A barrier stage as wide as the cluster's task slots: its tasks run all at once,
    so every host has some; ``slots`` tells how many.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sum(map(len, batches))
        names = gpu_names()
        yield pd.DataFrame([(socket.gethostname(), os.cpu_count() or 1, memory_gb(), bool(names), names[0] if names else "")] * rows, columns=["host", "cpu_cores", "memory_gb", "has_gpu", "gpu_name"])

    wide = slots or spark.sparkContext.defaultParallelism
    told = spark.range(0, wide, 1, wide).mapInPandas(probe, "host string, cpu_cores int, memory_gb double, has_gpu boolean, gpu_name string", barrier=True)
    return told.groupBy("host").agg(F.max("cpu_cores").alias("cpu_cores"), F.max("memory_gb").alias("memory_gb"), F.max("has_gpu").alias("has_gpu"), F.max("gpu_name").alias("gpu_name"), F.count(F.lit(1)).alias("slots"))


def gpu_profile(master: str, dynamic: bool, gpus: float, script: str = "") -> ResourceProfile | None:
    """Graphics units of a stage's tasks, or None where the stage runs on processors: without any asked for, and in local mode.

    With dynamic allocation executors are asked for units of their own; otherwise
    tasks share the units that the executors were started with.
    """
    if gpus <= 0 or master.startswith("local"):
        return None
    builder = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", gpus))
    if dynamic:
        builder = builder.require(ExecutorResourceRequests().resource("gpu", max(1, int(gpus)), script))
    return builder.build


def task_device() -> str:
    """In a task: gpu:n of the unit that the stage's profile gave it, or cpu."""
    here = TaskContext.get()
    given = here.resources().get("gpu") if here else None
    return f"gpu:{given.addresses[0]}" if given and given.addresses else "cpu"
