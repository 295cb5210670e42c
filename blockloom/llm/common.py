"""Shared storage, sizing and table helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.sources.shared import discard, own_dir, shared_dir, written
from blockloom.sources.tables import spread

__all__ = ["discard", "own_dir", "shared_dir", "ship", "table", "task_threads", "text_bytes", "written"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="blockloom-")) / "blockloom_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0


def task_threads() -> None:
    """Libraries that start thread pools keep to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
