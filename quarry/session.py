"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_MOST_BYTES = 16 << 20
_shipped: set[str] = set()


def session(name: str = "quarry", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster the submit command's settings win."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so their Python finds it wherever they run.

    Arrow batches of a session that still has the default size are made smaller, in rows and in bytes: ten thousand long texts at once are too many.
    """
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, "1000")
    if int(spark.conf.get(_BYTES).rstrip("b")) > _MOST_BYTES:
        spark.conf.set(_BYTES, str(_MOST_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarry-code-")
    target = os.path.join(folder, "quarry_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(target)  # executors fetch it when a task first needs it, so it stays until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(context.applicationId)
