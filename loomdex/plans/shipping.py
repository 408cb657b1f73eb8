"""Getting this package onto the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all Python workers, once an application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="loomdex-")) / f"{top.name}.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(place))
    _shipped.add(sc.applicationId)


def shipped(run: Callable) -> Callable:
    """``run(spark, ...)`` with the package sent first."""

    @wraps(run)
    def inner(spark: SparkSession, *args, **options):
        ship(spark)
        return run(spark, *args, **options)

    return inner
