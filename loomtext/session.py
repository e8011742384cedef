"""Session helpers: a tuned local builder, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomtext")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders of a path read here are listed by a few tasks for every core.

    Spark's default is a task for every folder, up to 10,000 of them, which cost more than the listing.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application.

    Operators that run Python call this, so a job works wherever the driver was started from.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loomtext-"), "loomtext.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
