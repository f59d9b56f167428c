"""Sends the package to Python workers that can't import it from where they run."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .tables import shared_dir

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def importable() -> bool:
    """Whether workers started from here find the package: by PYTHONPATH, or by the working folder."""
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Once a Spark application: the package as a zip in the shared folder, fetched by executors, unless workers find it anyway."""
    app = spark.sparkContext.applicationId
    if app in _shipped or importable():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted([*(ROOT / "meshwright").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/meshwright/{uuid.uuid4().hex}/meshwright_package.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(app)
