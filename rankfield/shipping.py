"""Getting this package to executors whose workers cannot import it from where the driver does."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context; a few hundred kilobytes of source."""
    context = spark.sparkContext
    if not getattr(context, "_rankfield_shipped", False):
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='rankfield-src-')}/rankfield", "zip", here.parent, here.name)
        context.addPyFile(archive)
        context._rankfield_shipped = True
