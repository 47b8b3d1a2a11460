"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def numeric_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    wanted = None if among is None else set(among)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and (wanted is None or f.name in wanted)
    ]


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps or appends columns (a withColumn chain grows the plan)."""
    kept = [new.get(c, F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns]
    added = [expr.alias(name) for name, expr in new.items() if name not in df.columns]
    return df.select(*kept, *added)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small driver-side table as a local relation (through Arrow, so no Python worker reads it back)."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [[] for _ in arrow]
    arrays = [pa.array(list(column), type=f.type) for column, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=schema)


class FittedRow:
    """Values of a one-row aggregate as literals: `stats["name"]` in any later expression."""

    def __init__(self, schema: T.StructType, values: Sequence):
        self._types = {f.name: f.dataType for f in schema.fields}
        self.values = dict(zip(schema.names, values))

    def __getitem__(self, name: str) -> Column:
        return F.lit(self.values[name]).cast(self._types[name])


def one_row(df: DataFrame, **aggregates: Column) -> FittedRow:
    """Fit global aggregates (a job with map-side partial aggregation that returns one row).

    Literals keep later plans small: they fold, they can be pushed to the scan, and stacked fits do not
    nest the whole upstream plan in every reference the way scalar subqueries would.
    """
    fitted = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return FittedRow(fitted.schema, fitted.first())


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide to long as doubles. The rows it makes are meant to be aggregated right away."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(ids), list(values), name, value
    )


def per_column(df: DataFrame, columns: Sequence[str], *, by: Sequence[str] = (), **aggregates: Callable[[Column], Column]) -> DataFrame:
    """Rows (by..., feature, one value per aggregate) from one wide aggregation of all columns as doubles.

    Only the aggregated row of each group is unpivoted, so no input row is multiplied.
    """
    if not columns:
        return df.groupBy(*by).agg(F.lit("").alias("feature"), *[fn(F.lit(0.0)).alias(name) for name, fn in aggregates.items()]).limit(0)
    wide = [fn(F.col(c).cast("double")).alias(f"_{i}_{name}") for i, c in enumerate(columns) for name, fn in aggregates.items()]
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}_{name}").alias(name) for name in aggregates]) for i, c in enumerate(columns)]
    return df.groupBy(*by).agg(*wide).select(*by, F.inline(F.array(*rows)))


def unnest(df: DataFrame, ids: Sequence[str], array: Column | str, required: str) -> DataFrame:
    """One row per element of an array of structs, with the struct's fields as columns.

    For computed arrays. A plain explode makes the optimizer add a size filter and push it down, which
    evaluates the whole array expression once more per projection below; the outer form does not. Rows of
    empty arrays are dropped by `required`, a field no element leaves NULL.
    """
    return df.select(*ids, F.inline_outer(array)).where(F.col(required).isNotNull())


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which a cluster sets to storage that the driver and all executors share.

    Only a session whose tasks run inside the driver's own process may go without: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="heatgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the session's shared folder and continue from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: Sequence[Column], out: str, start: int = 1) -> DataFrame:
    """Sequential number over a total order, without a single-task window.

    The range sort is written out once, so the partition a row sits in is settled; each row's number is
    its place in the partition plus the rows in the partitions before. Only one count per partition meets
    in one place. Pass a unique last sort key for a repeatable order.
    """
    placed = checkpointed(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_at") + start)
        .drop("_part", "_at", "_before")
    )
