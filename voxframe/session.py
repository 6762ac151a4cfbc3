"""A Spark session with the settings that the plans here rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the executors' path through Spark's own file server, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def session(name: str = "voxframe", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution on; conf's keys have _ for each dot."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
