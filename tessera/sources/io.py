"""Sources and sinks: typed scans, optional ones, feature and score stores, submissions, repairs."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.semantics import missing


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header and a declared schema; only the columns asked for are parsed, NaN reads as missing."""
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({n: missing(n) for n in floats}) if floats else df
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one of its schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """Where a query may keep tables of its own: spark.checkpoint.dir; only on a local master may it be unset, and a temporary folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="tessera-")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, however often it is used, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None, floats: bool = True) -> None:
    """A feature store: doubles narrowed to floats at the sink alone, infinities missing."""
    cols = [missing(f.name).cast("float").alias(f.name) if floats and isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    w = df.select(*cols).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_scores(df: DataFrame, path: str, model: str, key: str, score: str, split: str = "oof") -> None:
    """Appends one model's scores to a store laid out by model and split."""
    df.select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), F.lit(model).alias("model"), F.lit(split).alias("split")).write.mode("append").partitionBy("model", "split").parquet(path)


def read_scores(spark: SparkSession, path: str, models: list[str] | None = None, split: str = "oof") -> DataFrame:
    """(key, model, score); the partitions of other models and splits are not read."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return (df.where(F.col("model").isin(models)) if models else df).select("key", "model", "score")


def models_in(spark: SparkSession, path: str) -> list[str]:
    return sorted(r.model for r in spark.read.parquet(path).select("model").distinct().collect())


def register_scores(external: DataFrame, ids: DataFrame, key: str, score: str) -> DataFrame:
    """Scores aligned with ids; an id without one is an error, never a guess."""
    out = ids.select(key).join(external.select(key, score), key, "left")
    if n := out.where(F.col(score).isNull()).count():
        raise ValueError(f"{n} ids have no {score}")
    return out


def write_submission(df: DataFrame, path: str, key: str, score: str) -> None:
    """One CSV file with a header: a result of two narrow columns."""
    df.select(key, score).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, in as many files as df has parts."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: list[dict], path: str, spark: SparkSession) -> None:
    """A small report as JSON lines, through Spark's writer so that any file system does."""
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def repair(spark: SparkSession, path: str, out: str) -> None:
    """Rewrites a store with infinities and NaN as missing, to a new place: a table is never its own sink."""
    df = spark.read.parquet(path)
    cols = [missing(f.name).cast(f.dataType).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").parquet(out)
