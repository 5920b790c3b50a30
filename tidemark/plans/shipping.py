"""Making the package importable where Python tasks run."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession | None = None) -> None:
    """Send the package to the executors once per application.

    Functions are pickled by reference to their module, so a worker needs the
    module even if only the driver has it on its path.  Without a session the
    active one is taken; without any, nothing can run yet and nothing is sent.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.writestr(str(file.relative_to(root.parent)), file.read_bytes())
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    pathlib.Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path
