"""Episode tables as files: materialised scores, and versioned upserts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where the session names none, a temporary one on a local master, and
    an error on a cluster, whose executors share no temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracemill-store-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialised(df: DataFrame, stem: str = "episodes") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Predicates on scores would else be pushed below their computation, with the expressions put in for every mention of
    them, and those multiply. On files they become Parquet filters, and only the columns in use are read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def upserted(old: DataFrame | None, new: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """SNK3: the latest version of each row. F15: a rebuild without content never replaces one with content."""
    rows = new if old is None else old.unionByName(new)
    content = F.lit(False)
    for c in ("steps", "commands", "diffs", "tests"):
        if c in rows.columns:
            content = content | (F.coalesce(F.size(c), F.lit(0)) > 0)
    has_any = any(c in rows.columns for c in ("steps", "commands", "diffs", "tests"))
    w = Window.partitionBy(key).orderBy(*([content.desc()] if has_any else []), F.col(order).desc())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
