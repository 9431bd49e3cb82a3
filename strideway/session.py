"""Session settings every plan relies on, and shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings above; further settings by name, dots as double underscores."""
    b = SparkSession.builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone and give executors this package; safe to call again."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if getattr(sc, "_strideway_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="strideway-"), "strideway_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"strideway/{p.relative_to(top)}")
    sc.addPyFile(path)
    sc._strideway_shipped = True
    return spark


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if all run on this machine, else an error."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if top:
        return top.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_strideway_shared", None):
        path = tempfile.mkdtemp(prefix="strideway-shared-")
        atexit.register(shutil.rmtree, path, True)
        sc._strideway_shared = f"file://{path}"
    return sc._strideway_shared


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the folder that all executors share and read back: a short plan for what follows, and nothing to compute again when an executor is lost."""
    path = f"{shared_top(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
