"""What all machines need: the library's code for Python workers, and a folder that all see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without the setting one of our own for a session on this machine alone, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quern-lib-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}/{tag}"


def ship() -> None:
    """Send this package to the executors' Python workers, once for an application."""
    spark = SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="quern-lib-")) / f"{top.name}-lib.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(made))
    atexit.register(shutil.rmtree, made.parent, ignore_errors=True)
    _shipped.add(app)
