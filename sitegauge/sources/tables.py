"""Scratch and history tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, as in tests, one of this machine; a cluster's
    executors would not share that, so there the setting must be made."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sitegauge-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/sitegauge/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: loops keep short plans and survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_history(df: DataFrame, path: str, schema_version: int = 2) -> None:
    df.withColumn("schema_version", F.lit(schema_version)).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str, schema_version: int = 2) -> DataFrame:
    """Unreadable lines are skipped; only the current version is compared."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return current_version(rows, schema_version)


def current_version(rows: DataFrame, schema_version: int = 2) -> DataFrame:
    return rows.filter(F.col("schema_version") == schema_version)


def upsert_history(history: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """History with rows of the same keys replaced, and how many rows truly changed."""
    rows = history.select(*keys, *values, F.lit(0).alias("_new")).unionByName(new.select(*keys, *values, F.lit(1).alias("_new")))
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_new").alias("v")).select(*keys, "v.*")
    old = history.select(*keys, F.struct(*values).alias("_old"))
    changed = new.join(old, keys, "left").filter(~F.struct(*values).eqNullSafe(F.col("_old"))).agg(F.count("*").alias("written"))
    return merged, changed


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by ``order`` (window group limit before the shuffle)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def cap_history(history: DataFrame, keys: list[str], ts: str, n: int = 52) -> DataFrame:
    return latest(history, keys, [F.desc(ts)], n)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return latest(df, group, order, k)


def expired(items: DataFrame, keep: int, max_age_days: int, now: Column) -> DataFrame:
    """Items beyond the newest ``keep`` of their family or older than ``max_age_days``."""
    ranked = items.withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("made"), F.desc("item"))))
    return ranked.filter((F.col("rn") > keep) | (F.datediff(now, "made") > max_age_days)).drop("rn")


def paged_dedupe(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    from ..operators.pages import first_by

    return first_by(rows, keys, *order)


def write_findings(rows: DataFrame, path: str, report: str, run_date: str) -> None:
    """Dated findings, one schema for all audits; evidence goes in a map."""
    known = {"type", "severity", "url", "detail"}
    extra = [c for c in rows.columns if c not in known]
    evidence = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]) if extra else F.create_map().cast("map<string,string>")
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit("")).cast("string").alias(c) for c in ("type", "severity", "url", "detail")], evidence.alias("evidence"), F.lit(report).alias("report"), F.lit(run_date).alias("run_date"))
    full.write.mode("append").partitionBy("report", "run_date").parquet(path)
