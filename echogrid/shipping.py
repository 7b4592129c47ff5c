"""Makes this package importable for Python workers."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of this application, once, unless they inherit a path to it.

    A local master's workers inherit the driver's PYTHONPATH and working
    directory; on a cluster the package goes out as a zip file.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if context.master.startswith("local") and root in {os.path.realpath(p) for p in paths if p}:
        return
    folder = tempfile.mkdtemp(prefix="echogrid-ship-")  # Spark copies the file from here; nothing else is read from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    keep = shutil.ignore_patterns("__pycache__", "*.pyc")
    shutil.copytree(os.path.join(root, "echogrid"), os.path.join(folder, "package", "echogrid"), ignore=keep)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "echogrid"), "zip", os.path.join(folder, "package")))


def shipped(f: Callable) -> Callable:
    """f(spark, ...) with the package sent out first."""

    @functools.wraps(f)
    def run(spark: SparkSession, *rest, **options):
        ship(spark)
        return f(spark, *rest, **options)

    return run
