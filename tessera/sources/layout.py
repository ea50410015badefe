"""Tables per job: one dataset, partitioned by job, in place of folders per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the jobs in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def read(spark: SparkSession, path: str, job_id: int | None = None) -> DataFrame:
    """All jobs, or one: then only its partition is listed and read."""
    df = spark.read.parquet(path)
    return df if job_id is None else df.filter(F.col("job_id") == job_id)


def exists(spark: SparkSession, path: str, job_id: int) -> bool:
    return bool(read(spark, path, job_id).limit(1).count())


def cleanup(spark: SparkSession, path: str, job_id: int) -> bool:
    """Removes a job's partition; whether there was one."""
    context = spark.sparkContext
    part = context._jvm.org.apache.hadoop.fs.Path(f"{path}/job_id={job_id}")
    return bool(part.getFileSystem(context._jsc.hadoopConfiguration()).delete(part, True))


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token tables of references (row, col, tok, vec) or pieces (piece_id, rot, tok, vec), per job, in place of archives:
    a job's rows are sorted by what identifies a set, so that readers of few sets skip the rest."""
    ids = [c for c in tokens.columns if c not in ("job_id", "vec")]
    write(tokens.repartition("job_id", ids[0]).sortWithinPartitions("job_id", *ids), path)


def write_manifest(steps: DataFrame, path: str) -> None:
    steps.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
