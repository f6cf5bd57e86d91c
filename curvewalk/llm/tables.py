"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvewalk.sources.tables import materialize

Rows = Iterator[pa.RecordBatch]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators read, a null text as the empty one; all other columns are ignored."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def body_key(text_col: str = "text") -> Column:
    """A hash that names a text beside its id, so that rows with repeated or null ids can be told apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many lines under it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(values: DataFrame, column: str) -> DataFrame:
    """values with place: the dense number of each row by order of code points, null last; column holds no value twice.

    Rows are ranged over partitions and numbered inside them; only counts of partitions are added up.
    """
    ordered = values.orderBy(F.col(column).asc_nulls_last())
    ordered = materialize(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    parts = parts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ordered.join(parts, "part").withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """Run fn over Arrow batches. It gets one Arrow array a column and returns a column for each name of schema.

    Batches are cut to SLICE rows so that memory follows the texts at hand, not the batch setting.
    """
    fields = _arrow_schema(df, schema)

    def run(batches: Rows) -> Rows:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = fn(*part.columns)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


SLICE = 2000


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
