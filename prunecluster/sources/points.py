"""Point sources: CSV, named presets, libsvm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.sparse import sparse_point
from ..operators import prep
from .gaussians import gaussian_points, mixture_k
from .lines import read_csv_lines


@dataclass(frozen=True)
class Preparation:
    """Which preparation steps a source goes through, in this order."""

    one_hot: bool = False
    numeric_only: bool = True
    drop_nulls: bool = True
    drop_first_column: bool = False
    scale: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.one_hot:
            df = prep.one_hot(df)
        if self.numeric_only:
            df = prep.numeric_projection(df)
        if self.drop_nulls:
            df = prep.drop_nulls(df)
        if self.drop_first_column:
            df = prep.drop_first_column(df)
        if self.scale:
            df = prep.min_max_scale(df, prep.numeric_columns(df))
        return df


# The preparation each well-known dataset needs.
PRESETS = {
    "kdd": Preparation(numeric_only=True, drop_nulls=False),
    "bigcross": Preparation(numeric_only=True, drop_nulls=False),
    "higgs": Preparation(numeric_only=True, drop_nulls=True),
    "higgs_top20k": Preparation(numeric_only=True, drop_nulls=True),
    "census1990": Preparation(one_hot=True, numeric_only=False, drop_nulls=True, drop_first_column=True),
}


def preset(name: str) -> Preparation:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known are {sorted(PRESETS)}")
    return PRESETS[name]


def read_csv_points(
    spark: SparkSession,
    path: str,
    *,
    header: bool = True,
    schema: StructType | str | None = None,
    skip_malformed: bool = False,
    skip_lines: int = 0,
    limit: int | None = None,
    order: list[str] | None = None,
    preparation: Preparation = Preparation(),
) -> DataFrame:
    """A prepared table from CSV files.

    Give ``schema`` for large files: inference reads them once more. ``skip_lines`` leaves out so many lines at the
    head of each file, before its header. ``limit`` keeps the first rows in the order of ``order``, without it
    those that stand first in the files. Both go by the position of lines (``lines.read_csv_lines``).
    """
    if skip_lines or (limit is not None and not order):
        by_position = None if order else limit
        df = read_csv_lines(
            spark, path, skip_lines=skip_lines, header=header, limit=by_position, schema=schema, skip_malformed=skip_malformed
        )
        if order and limit is not None:
            df = prep.first_rows(df, limit, order)
        return preparation.apply(df)
    reader = spark.read.option("header", header)
    reader = reader.option("mode", "DROPMALFORMED" if skip_malformed else "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if limit is not None:
        df = prep.first_rows(df, limit, order)
    return preparation.apply(df)


def read_preset(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return read_csv_points(spark, path, preparation=preset(name), **options)


def read_libsvm_points(spark: SparkSession, path: str, dims: int | None = None, sparse: bool = False) -> DataFrame:
    """(label, x) from a libsvm file, x an array of all coordinates or a sparse point.

    Give ``dims`` for large files: finding it reads them once.
    """
    reader = spark.read.format("libsvm")
    if dims is not None:
        reader = reader.option("numFeatures", str(dims))
    x = sparse_point(F.col("features")) if sparse else vector_to_array("features")
    return reader.load(path).select("label", x.alias("x"))


def to_points(df: DataFrame, columns: list[str], id_columns: list[str], weight: str | None = None) -> DataFrame:
    """(point_id, x[, w]) from a prepared table."""
    return prep.point_table(
        df, [F.col(f"`{c}`") for c in id_columns], prep.assemble_vector(columns),
        None if weight is None else F.col(f"`{weight}`"),
    )


def load_dataset(spark: SparkSession, name: str, path: str | None = None, **options) -> DataFrame:
    """A prepared table by name: a preset with its files, a mixture such as gaussian_25, or a path of CSV files.

    A mixture takes the options of ``gaussian_points`` (n, dims, seed, ...), the others those of ``read_csv_points``.
    """
    if name in PRESETS:
        if path is None:
            raise ValueError(f"the preset {name!r} needs the path of its files")
        return read_preset(spark, name, path, **options)
    if name.startswith("gaussian_"):
        return gaussian_points(spark, mixture_k(name), **options)
    return read_csv_points(spark, name, **options)


class Datasets:
    """Prepared tables by name, kept from setting to setting.

    A table asked for again with the same options is the one that was loaded first, persisted in executors' memory and
    on their disks; a lost part is read again. As a context it lets go of all of them at the end.
    """

    def __init__(self, spark: SparkSession, load=load_dataset):
        self.spark, self.load, self.kept = spark, load, {}

    def get(self, name: str, path: str | None = None, **options) -> DataFrame:
        key = (name, path, repr(sorted(options.items(), key=lambda item: item[0])))
        if key not in self.kept:
            given = options if path is None else {"path": path, **options}
            self.kept[key] = self.load(self.spark, name, **given).persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept[key]

    def __enter__(self) -> "Datasets":
        return self

    def __exit__(self, *_) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()
