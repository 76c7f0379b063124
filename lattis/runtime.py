"""Session, scratch tables and settings (environment variables LATTIS_*)."""

from __future__ import annotations

import logging
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

DOMAINS = ("hydrology", "oceanography", "airspace", "maritime")


def get_session(app: str = "lattis", **conf: str) -> SparkSession:
    """The running session, or a new one from LATTIS_MASTER, LATTIS_SHUFFLE_PARTITIONS and conf."""
    b = SparkSession.builder.appName(app)
    if m := os.environ.get("LATTIS_MASTER"):
        b = b.master(m)
    if n := os.environ.get("LATTIS_SHUFFLE_PARTITIONS"):
        b = b.config("spark.sql.shuffle.partitions", n)
    return b.config("spark.sql.session.timeZone", "UTC").config(map=conf).getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder (spark.checkpoint.dir) and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    at = f"{(root or 'file:///tmp/lattis-scratch').rstrip('/')}/lattis-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def data_dir(domain: str) -> str:
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}; expected one of {', '.join(DOMAINS)}")
    return os.path.join(os.environ.get("LATTIS_DATA", "data"), domain)


def export_dir(domain: str) -> str:
    data_dir(domain)
    return ensure_dir(os.path.join(os.environ.get("LATTIS_EXPORTS", "exports"), domain))


def ensure_dir(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def get_logger(name: str = "lattis") -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
        log.setLevel(os.environ.get("LATTIS_LOG", "INFO"))
    return log
