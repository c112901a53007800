"""Send this package to the executors of a session whose workers would not find it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package as a zip, unless PYTHONPATH already leads to it."""
    known = [Path(x).resolve() for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x]
    context = spark.sparkContext
    if ROOT in known or context.applicationId in _sent:
        return
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(ROOT / "wayfold", Path(top, "in", "wayfold"), ignore=shutil.ignore_patterns("__pycache__"))
        place = tempfile.mkdtemp(prefix="wayfold-zip-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        made = shutil.make_archive(os.path.join(place, "wayfold"), "zip", Path(top, "in"))
    context.addPyFile(made)
    _sent.add(context.applicationId)


def shipped(query):
    """``query(spark, sf_dir)`` after :func:`ship`."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
