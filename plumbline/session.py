"""The session used where the caller gives none, and the package on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their Python path has it anyway."""
    home = Path(__file__).resolve().parents[1]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == home for p in paths) or "site-packages" in home.parts or spark.conf.get("plumbline.shipped", None):
        return
    made = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted((home / "plumbline").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(made)
    spark.conf.set("plumbline.shipped", "true")
