"""Panel, configuration, sample and observed-yield sources, and the output sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"max_features": "max", "other_features": "other"}
CONFIG_SCHEMA = "horizon string, role string, ordinal int, column_name string"


def table_source(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A Parquet table with a clear error for a wrong suffix, a missing path or missing columns."""
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError(f"not a .parquet path: {path}")
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(path) from e
        raise
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; it has {df.columns}")
    return df.select(*required) if required else df


def feature_config(spark: SparkSession, path: str) -> DataFrame:
    """Configuration rows ``(horizon, role, ordinal, column_name)`` from a small YAML or JSON file.

    A horizon maps either to ``max_features`` / ``other_features`` lists or, in the older flat
    shape, straight to one list. ``dependent_variables`` are targets and belong to no horizon.
    """
    try:
        text = spark.read.text(path, wholetext=True).head()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(path) from e
        raise
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        import json

        config = json.loads(text)
    rows = []
    for name, entry in config.items():
        if name == "dependent_variables":
            groups = {("target", None): entry}
        elif isinstance(entry, list):
            groups = {("max", name): entry}
        else:
            groups = {(ROLES[role], name): columns for role, columns in entry.items()}
        for (role, horizon), columns in groups.items():
            rows += [(horizon, role, i, c) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def horizons(config: DataFrame) -> DataFrame:
    return config.filter(F.col("horizon").isNotNull()).select("horizon").distinct()


def features(config: DataFrame, horizon: str, roles: tuple[str, ...] = ("max",)) -> list[str]:
    """Feature names of a horizon in file order; an unknown horizon names the valid ones."""
    wanted = config.filter((F.col("horizon") == horizon) & F.col("role").isin(*roles))
    order = F.when(F.col("role") == "max", 0).otherwise(1)
    names = [r.column_name for r in wanted.orderBy(order, "ordinal").collect()]
    if not names:
        known = sorted(r.horizon for r in horizons(config).collect())
        raise ValueError(f"no features for horizon {horizon!r}; horizons are {known}")
    return names


def targets(config: DataFrame) -> list[str]:
    rows = config.filter(F.col("role") == "target").orderBy("ordinal").collect()
    return [r.column_name for r in rows]


def read_samples(spark: SparkSession, root: str, horizon: str | None = None) -> DataFrame:
    """Sample table under ``root``; a horizon is a partition filter, so other folders are not read."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(root)
    return df if horizon is None else df.filter(F.col("horizon") == horizon)


def read_dated_files(spark: SparkSession, path: str) -> DataFrame:
    """Files or tables named ``<date>.parquet`` without a date column: the date comes from the name.

    A table is the folder that Spark writes for one. The name counts up to its first dot. Hadoop file systems do not
    allow ``:`` in names, so a time of day cannot be part of it.
    """
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/.]+)(?:\.[^/]*)?\.parquet(?:/[^/]*)?$", 1)
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select("*", F.to_date(stem).alias("date"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet output; rebalancing first gives even files, splitting large partition values.

    With ``by``, overwriting replaces only the partitions present in ``df``.
    """
    if by:
        writer = df.hint("rebalance", *by).write.mode(mode).partitionBy(*by)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        df.hint("rebalance").write.mode(mode).parquet(path)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Store an expensive stage in the shared folder so that several outputs read it back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` stores inside is removed at the end, also after an error.

    Results that are still lazy read those tables, so they must be written before the end, to a folder of their own.
    """
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in held:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).option("header", True).csv(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only where that setting is absent, as in local tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="curvewalk-")
