"""CSV files by the position of their lines: lines to skip, a header behind them, the first rows as they stand.

A split of a file is named by its path and the byte at which it starts, and its lines come in order. One pass counts
the lines of every split; sums of these counts over the splits before give each line its number in its file and among
all rows. Nothing is sorted but one row for each split, and lines are parsed only behind the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import RunTables

#: Types tried for a column without a given one, narrowest first; a column that none fits is a string.
INFERRED = ("int", "bigint", "double", "boolean", "timestamp")
CORRUPT = "malformed line"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, with their split and a number that rises by 1 from line to line of it."""
    read = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    return read.where(F.trim("value") != "").withColumn("place", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str, before: int = 0) -> DataFrame:
    """(value, file, line, row): each line with its number in its file, and, the first ``before`` lines of every file
    left out, its number among all rows; both from 0, files in the order of their paths.

    Blank lines count for nothing. A record is a line, so a quoted field must not hold a line break. Splits that
    change between the pass that counts and the one that reads fail the job instead of giving wrong numbers.
    """
    lines = _lines(spark, path)
    counted = lines.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    splits = RunTables(spark).write(counted, "splits")
    of_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("skipped", F.coalesce(F.sum("lines").over(of_file), F.lit(0)))
    files = placed.groupBy("file").agg(F.greatest(F.sum("lines") - before, F.lit(0)).alias("rows"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    known = placed.join(files, "file").select(
        F.col("file").alias("of_file"), F.col("start").alias("of_start"), "lines", "first", "skipped", "base"
    )
    # one row for each split
    same = (F.col("file") == F.col("of_file")) & (F.col("start") == F.col("of_start"))
    joined = lines.join(F.broadcast(known), same, "left")
    inside = F.col("place") - F.col("first")
    changed = F.raise_error(F.concat(F.lit("the splits of "), "file", F.lit(" changed while it was read"))).cast("bigint")
    # A condition that is not settled by its row keeps the planner from making this an inner join, which
    # would leave out lines of unknown splits instead of failing.
    known_line = (F.monotonically_increasing_id() >= 0) & F.col("first").isNotNull() & (inside >= 0) & (inside < F.col("lines"))
    return joined.select(
        "value", "file", F.when(known_line, F.col("skipped") + inside).otherwise(changed).alias("line"),
        F.col("base").alias("base"),
    ).select("value", "file", "line", (F.col("base") + F.col("line") - F.lit(before)).alias("row"))


def _fields(spark: SparkSession, line: str, options: dict) -> list[str]:
    """The fields of one line, split as the rows are."""
    width = line.count(options.get("sep", ",")) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = spark.range(1).select(F.from_csv(F.lit(line), schema, options).alias("r")).first().r
    # fields beyond the last are null; an empty name is one too, and stays a column
    found = list(row)
    while len(found) > 1 and found[-1] is None and not line.rstrip().endswith(options.get("sep", ",")):
        found.pop()
    return [name if name is not None else f"_c{i}" for i, name in enumerate(found)]


def inferred_schema(lines: DataFrame, names: list[str], options: dict) -> T.StructType:
    """The narrowest types that hold all values of each column, by one aggregate."""
    rows = lines.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), options).alias("r")).select("r.*")
    fits = [
        F.count_if(F.col(f"c{i}").isNotNull() & F.col(f"c{i}").try_cast(kind).isNull()).alias(f"{kind}{i}")
        for i in range(len(names)) for kind in INFERRED
    ]
    some = [F.count(f"c{i}").alias(f"some{i}") for i in range(len(names))]
    found = rows.agg(*fits, *some).first()

    def kind(i):
        if not found[f"some{i}"]:
            return "string"
        return next((k for k in INFERRED if not found[f"{k}{i}"]), "string")

    simple = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
              "timestamp": T.TimestampType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, simple[kind(i)]) for i, name in enumerate(names)])


def read_csv_lines(
    spark: SparkSession,
    path: str,
    *,
    skip_lines: int = 0,
    header: bool = True,
    limit: int | None = None,
    schema: T.StructType | str | None = None,
    skip_malformed: bool = False,
    sep: str = ",",
) -> DataFrame:
    """Rows of CSV files, without the first ``skip_lines`` lines of each and the header behind them; the first ``limit`` rows.

    Files come in the order of their paths. Without ``schema`` the names are those of the first file's header and the types
    are found in one more pass over the lines that count. A row with too few fields has nulls; one whose value doesn't fit its
    type has a null there, or is left out with ``skip_malformed`` (behind the cut, as files are cut by lines).
    """
    if skip_lines < 0 or (limit is not None and limit < 0):
        raise ValueError("lines to skip and rows to read must not be negative")
    options = {"sep": sep, "mode": "PERMISSIVE"}
    before = skip_lines + (1 if header else 0)
    lines = numbered_lines(spark, path, before)
    rows = lines.where(F.col("line") >= before)
    if limit is not None:
        rows = rows.where(F.col("row") < limit)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        first = lines.where(F.col("line") == skip_lines).orderBy("file").select("value").first()
        if first is None:
            raise ValueError(f"{path}: no line behind the {skip_lines} to skip")
        names = _fields(spark, first.value, options)
        schema = inferred_schema(rows, names if header else [f"_c{i}" for i in range(len(names))], options)
    return rows.select(parsed(F.col("value"), schema, options).alias("r")).transform(
        lambda df: df.where(F.col(f"r.`{CORRUPT}`").isNull()) if skip_malformed else df
    ).select([F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def parsed(value: Column, schema: T.StructType, options: dict) -> Column:
    """A line as a struct of the schema, with the line itself if it doesn't fit."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in whole.fields)
    return F.from_csv(value, ddl, {**options, "columnNameOfCorruptRecord": CORRUPT})
