"""Readers with declared schemas, writers, and local cache files."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import urllib.request
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYMENTS = "Record_ID long, Covered_Recipient_NPI long, Covered_Recipient_Type string, Covered_Recipient_First_Name string, Covered_Recipient_Last_Name string, Recipient_State string, Covered_Recipient_Specialty_1 string, Total_Amount_of_Payment_USDollars double, Number_of_Payments_Included_in_Total_Amount int, Form_of_Payment_or_Transfer_of_Value string, Nature_of_Payment_or_Transfer_of_Value string, Date_of_Payment string"
FEATURES = "Record_ID long, payment_amount double, payment_amount_log double, num_payments_included int, payment_form string, payment_nature string, recipient_specialty string, manufacturer_name string, payment_month int, payment_day_of_week int, is_excluded int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header under a declared schema; columns are pruned in the scan."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return df.select(*columns) if columns else df


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An all-text CSV; blanks stay empty texts instead of becoming nulls."""
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def write_table(df: DataFrame, path: str, key: str | None = None, files: int = 16) -> None:
    """Parquet, dealt by a key where one is given."""
    (df.repartition(files, key) if key else df).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = 16) -> None:
    """A table whose later joins and rollups on key need no shuffle."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def pairs_of(pairs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of pairs whose key is wanted."""
    return pairs.join(wanted.select(key), key, "left_semi")


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def cached(url: str, path: str, force: bool = False) -> str:
    """A local copy of url, fetched once; a part file becomes the copy only when it is whole."""
    to = Path(path)
    if force or not to.exists():
        to.parent.mkdir(parents=True, exist_ok=True)
        part = to.with_name(to.name + ".part")
        with urllib.request.urlopen(url) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        os.replace(part, to)
    return str(to)


def clear_cache(folder: str) -> int:
    """Removes the folder's files, but for its placeholder; returns how many went."""
    gone = [p for p in Path(folder).rglob("*") if p.is_file() and p.name != ".gitkeep"]
    for p in gone:
        p.unlink()
    return len(gone)


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that the cluster names in spark.checkpoint.dir: computed once, where a checkpoint runs its last stage twice."""
    path = f"{_shared(df.sparkSession)}/riskweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``stored`` in buckets of key: later rollups by key and more, and joins on it, move no row."""
    spark = df.sparkSession
    name, n = f"riskweave_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{_shared(spark)}/{name}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the files outlive the name
    spark.sql(f"DROP TABLE {name}")
    return out


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/riskweave-checkpoints").rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the cluster names in spark.checkpoint.dir: what reads it often starts there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()
