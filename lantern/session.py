"""Sessions, and the library on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(name: str = "lantern", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; everything else comes from the cluster's configuration."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_lantern_shipped", False):
        return
    place = Path(tempfile.mkdtemp(prefix="lantern-code-")) / "lantern.zip"
    with zipfile.ZipFile(place, "w") as out:
        for path in sorted((ROOT / "lantern").rglob("*.py")):
            out.write(path, path.relative_to(ROOT).as_posix())
    context.addPyFile(str(place))
    context._lantern_shipped = True
