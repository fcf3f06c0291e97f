"""What every session that runs this package needs."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``, as ever.
    """
    here, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, for all that driver and executors both read.

    A session on one machine that names none gets a folder of its own; on a
    cluster that is an error, as no machine could read what another wrote.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"spark.checkpoint.dir names no folder that driver and executors of {context.master} share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: partitions and rows stay as they are from here on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
