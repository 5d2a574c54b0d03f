"""Results by artefact (a session, a clip), each written whole once and never overwritten.

A run writes its rows below a folder of its own and then says in the manifest which artefacts it has finished: one small file,
which is there or not.  Only what the manifest names is read.  So output of a run that broke off is no output; the next run
writes what is missing and leaves the rest alone, or, where that is asked for, refuses artefacts that are there already.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scratch


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/_manifest"  # a leading underscore hides it from readers of the rows


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """(keys, run, rows) of the artefacts that are complete; None if no run has finished."""
    return spark.read.parquet(_manifest(path)) if _exists(spark, _manifest(path)) else None


def write_artefacts(rows: DataFrame, path: str, by: Sequence[str] = ("session_id",), existing: str = "refuse") -> int:
    """Write the artefacts of ``rows`` and give their number; ``existing`` ones are an error (``refuse``) or left (``skip``).

    Rows of a large artefact may be in many files.  Two runs at a time must not share artefacts.
    """
    if existing not in ("refuse", "skip"):
        raise ValueError(f"existing must be refuse or skip, got {existing!r}")
    spark, by = rows.sparkSession, list(by)
    done = finished(spark, path)
    if done is not None:
        if existing == "skip":
            rows = rows.join(done.select(*by), by, "left_anti")
        elif some := rows.select(*by).distinct().join(done.select(*by), by).take(1):
            raise FileExistsError(f"{path} already holds {some[0].asDict()}; nothing was written")
    run = uuid.uuid4().hex
    rows.write.parquet(f"{path.rstrip('/')}/run={run}")
    written = spark.read.schema(rows.schema).parquet(f"{path.rstrip('/')}/run={run}")
    told = written.groupBy(*by).agg(F.count("*").alias("rows")).withColumn("run", F.lit(run))
    told = scratch.written(told, "finished-artefacts")
    count = told.count()
    if count:
        told.coalesce(1).write.mode("append").parquet(_manifest(path))  # one row an artefact; the commit
    return count


def read_artefacts(spark: SparkSession, path: str, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """All rows of complete artefacts, with the ``run`` that wrote them."""
    done = finished(spark, path)
    if done is None:
        raise FileNotFoundError(f"no run has finished in {path}")
    return spark.read.parquet(path).join(done.select(*by, "run"), [*by, "run"])
