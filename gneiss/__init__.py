"""A PySpark-native engine for auditing source and text corpora."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent


def checkpoints(spark) -> None:
    """Checkpoints go to the folder the session names; a local one is made only where none is named and the master is local."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gneiss-checkpoints-"))


def ship(spark) -> None:
    """Lets Python workers import this package: nothing to do where PYTHONPATH has it, else it is sent as a zip."""
    have = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT.parent) in have or getattr(spark.sparkContext, "_gneiss_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="gneiss-")) / "gneiss.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._gneiss_shipped = True
