"""Preparation of raw tables into points."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import RunTables


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_projection(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Numeric columns only, in order; ``keep`` names further columns to carry along."""
    wanted = set(numeric_columns(df)) | set(keep or [])
    return df.select([F.col(f"`{c}`") for c in df.columns if c in wanted])


def drop_nulls(df: DataFrame) -> DataFrame:
    """Drops rows with a null (or NaN) in any column."""
    return df.na.drop()


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def one_hot(df: DataFrame, columns: list[str] | None = None, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Replaces each categorical column by one 0/1 column per level, all levels kept.

    The other columns come first, as they were. Each level is a column that the caller asks for, so the levels
    go through the driver, all columns in one pass; ``levels`` names those of a column beforehand. For
    columns with very many levels there is ``one_hot_sparse``.
    """
    columns = categorical_columns(df) if columns is None else columns
    known = {name: sorted(levels[name]) for name in columns if levels and name in levels}
    open_columns = [c for c in columns if c not in known]
    if open_columns:
        # One row per (column, level), whatever the number of rows.
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("level")) for i, c in enumerate(open_columns)])
        found = df.select(F.explode(pairs).alias("p")).select("p.*").where("level is not null").distinct().collect()
        for i, name in enumerate(open_columns):
            known[name] = sorted(r.level for r in found if r.i == i)
    outputs = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    for name in columns:
        level = F.col(f"`{name}`")
        outputs += [F.coalesce(level == F.lit(v), F.lit(False)).cast("int").alias(f"{name}_{v}") for v in known[name]]
    return df.select(outputs)


def one_hot_sparse(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Replaces a categorical column by the index of its level among all levels in order (null stays null).

    The index is the place of the single 1 in the sparse one-hot vector. Any number of levels: they are
    counted per range of levels and numbered in Spark, never gathered.
    """
    output = output or f"{column}_index"
    levels = df.select(F.col(f"`{column}`").alias("level")).where("level is not null").distinct()
    with_place = numbered(levels, ["level"], RunTables(df.sparkSession)).withColumnRenamed("number", output)
    joined = df.join(with_place, F.col(f"`{column}`") == F.col("level"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != column], output)


def one_hot_points(df: DataFrame, id_columns: list[Column], categorical: list[str], numeric: list[str] = ()) -> DataFrame:
    """(point_id, x) with x a sparse point: the numeric columns, then one coordinate for each level of each categorical one.

    Levels in order, columns as they are given; a null level has no entry, a null number is 0. The number of levels may be any:
    they are numbered in Spark, and only their count reaches the driver. Rows meet their levels' numbers once: keys, numbers
    and places are written to the shared folder, and each pass over the points puts them together from there. What is
    moved for that are the columns of ``df`` that are named, no texts made of them.
    """
    tables, offset = RunTables(df.sparkSession), len(numeric)
    mark = uuid4().hex  # names that no column has
    rows, places = df, []
    for i, c in enumerate(categorical):
        level = F.col(f"`{c}`").cast("string")
        levels = df.select(level.alias("level")).where("level is not null").distinct()
        known = numbered(levels, ["level"], tables)
        count = known.count()
        known = known.select(F.col("level").alias(f"of_{i}_{mark}"), (F.col("number") + F.lit(offset)).cast("int").alias(f"place_{i}_{mark}"))
        rows = rows.join(known, level == F.col(f"of_{i}_{mark}"), "left")
        places.append(F.col(f"place_{i}_{mark}").alias(f"place_{i}"))
        offset += count
    keyed = [c.alias(f"key_{i}") for i, c in enumerate(id_columns)]
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"number_{i}") for i, c in enumerate(numeric)]
    stored = tables.write(rows.select(*keyed, *numbers, *places), "points")
    held = F.array_compact(F.array(*[F.col(f"place_{i}") for i in range(len(places))])) if places else F.array().cast("array<int>")
    indices = F.concat(F.array(*[F.lit(i) for i in range(len(numeric))]).cast("array<int>"), held)
    values = F.concat(F.array(*[F.col(f"number_{i}") for i in range(len(numeric))]).cast("array<double>"), F.transform(held, lambda _: F.lit(1.0)))
    x = F.struct(F.lit(offset).alias("size"), indices.alias("indices"), values.alias("values"))
    key = [F.col(f"key_{i}") for i in range(len(id_columns))]
    named = key[0] if len(key) == 1 else F.concat_ws(":", *[c.cast("string") for c in key])
    return stored.select(named.alias("point_id"), x.alias("x"))


def numbered(df: DataFrame, order: list[str], tables: RunTables) -> DataFrame:
    """Adds ``number``, the place of each row in the given order, from 0.

    Rows are sorted by ranges and numbered within each; what comes before a range is a sum over ranges,
    of which there are no more than tasks.
    """
    place = F.monotonically_increasing_id()  # upper bits: the task, lower 33: the row in it
    stored = tables.write(df.orderBy(*order).withColumn("place", place), f"numbered-{uuid4().hex}")
    part = F.shiftright("place", 33)
    sizes = stored.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return (
        stored.join(F.broadcast(bases), part == F.col("part"))
        .withColumn("number", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1))
        .select(*[F.col(f"`{c}`") for c in df.columns], "number")
    )


def first_rows(df: DataFrame, count: int, order: list[str], tables: RunTables | None = None) -> DataFrame:
    """The first ``count`` rows in the given order, cut without gathering them in one task."""
    return numbered(df, order, tables or RunTables(df.sparkSession)).where(F.col("number") < count).drop("number")


def drop_first_column(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns[1:]])


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scales columns to [0, 1]; a constant column becomes 0. NaN has no part in the range and stays NaN.

    One aggregate finds the ranges (two numbers per column), one narrow projection applies them.
    """
    def known(c):
        value = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(value), value)

    ranges = df.agg(
        *[F.min(known(c)).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(known(c)).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = ranges[f"lo_{i}"], ranges[f"hi_{i}"]
        value = F.col(f"`{c}`").cast("double")
        if low is None or high == low:
            scaled[c] = F.when(F.isnan(value), value).when(value.isNotNull(), F.lit(0.0))
        else:
            scaled[c] = (value - F.lit(low)) / F.lit(high - low)
    return df.select([scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns])


def constant_scale(grid: Column, factor: float = 255.0) -> Column:
    """Flattens a grid (array of arrays) and divides each cell by a constant."""
    return F.transform(F.flatten(grid), lambda v: v.cast("double") / F.lit(factor))


def assemble_vector(columns: list[str]) -> Column:
    """Columns gathered into one array of doubles."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def rounded(value: Column) -> Column:
    """``F.round(value)`` of doubles, halves away from zero, without the decimal that it makes of every number."""
    value = value.cast("double")
    even = F.rint(value)
    # the distance to a neighbouring integer is exact; + 0.0 makes 0.0 of -0.0
    return F.when(F.abs(value - even) == 0.5, value + F.signum(value) * 0.5).otherwise(even) + F.lit(0.0)


def point_table(df: DataFrame, id_columns: list[Column], x: Column, weight: Column | None = None) -> DataFrame:
    """(point_id, x[, w]) from key columns and a coordinate array.

    A single key column is kept as it is; several are joined by ':'.
    """
    key = id_columns[0] if len(id_columns) == 1 else F.concat_ws(":", *[c.cast("string") for c in id_columns])
    columns = [key.alias("point_id"), x.cast("array<double>").alias("x")]
    if weight is not None:
        columns.append(checked_weight(weight).alias("w"))
    return df.select(columns)


def spread(df: DataFrame, per_split: int = 0) -> DataFrame:
    """Deals out a table that has fewer splits than there are cores; any other is left alone.

    With ``per_split`` every table is dealt out, into at least so many parts for each of its splits: a split may hold
    millions of rows, too many for a task that keeps them as vectors.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if per_split:
        return df.repartition(max(cores, per_split * splits))
    return df.repartition(cores) if splits < cores else df


def checked_weight(weight: Column) -> Column:
    """Weight as double, 1.0 where missing; one that is negative or NaN fails the job."""
    value = F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.when((value >= 0) & ~F.isnan(value), value).otherwise(
        F.raise_error(F.concat(F.lit("negative weight: "), value.cast("string"))).cast("double")
    )


def profile(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per stage: row count, number of columns and their types."""
    parts = []
    for name, df in stages.items():
        types = ",".join(f.dataType.typeName() for f in df.schema.fields)
        parts.append(
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("stage"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
                F.lit(types).alias("column_types"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
