"""Making the package importable on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless they find it by PYTHONPATH or the working folder."""
    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    sc = spark.sparkContext
    if any(Path(p).resolve() == root for p in known) or sc.applicationId in _SHIPPED:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/loomspan", "zip", root, "loomspan")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shipped(f: Callable) -> Callable:
    """``f(spark, ...)``, with the package sent to the executors first where they lack it."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run
