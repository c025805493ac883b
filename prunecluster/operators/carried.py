"""Nearest distances carried from step to step beside the points.

The points are written once as a table bucketed by point_id, together with their distances to the first centres. What
is known of each later, its distance to the nearest centre so far and that centre's number, is a narrow table bucketed
alike, so both are joined bucket by bucket without an exchange. A step measures the points against the newest centres
alone and writes the narrow table anew; a point is compared with every centre exactly once.
"""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.centers import Centers
from ..functions.hashing import POINT_ID
from ..storage import RunTables
from .cost import weight_of
from .nearest import with_nearest
from .sampling import weighted_draw

# Buckets of one file each are sorted as they were written; only with this does Spark not sort them again to join them.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class CarriedDistances:
    """Distances of ``points`` (unique point_id, x[, w]) to centres that are added step by step.

    As a context it drops its tables at the end.
    """

    def __init__(self, points: DataFrame, buckets: int | None = None):
        if POINT_ID not in points.columns:
            raise ValueError("carried distances need a unique point_id column")
        self.spark, self.run = points.sparkSession, RunTables(points.sparkSession)
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []
        self.columns = [POINT_ID, "x", *(["w"] if "w" in points.columns else [])]
        # dealt out by key as the buckets are, so that each is one file
        self.points = points.select(*self.columns).repartition(self.buckets, POINT_ID)
        self.known: DataFrame | None = None
        self.count = 0

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"prunecluster_{name}_{uuid4().hex}"
        self.tables.append(table)
        writer = df.write.format("parquet").bucketBy(self.buckets, POINT_ID).sortBy(POINT_ID)
        writer.option("path", f"{self.run.root}/{table}").saveAsTable(table)
        return self.spark.table(table)

    @contextmanager
    def _sorted_buckets(self):
        before = self.spark.conf.get(SORTED_BUCKETS)
        self.spark.conf.set(SORTED_BUCKETS, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SORTED_BUCKETS, before)

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.run.drop(table)

    def scored(self, newest: Centers) -> DataFrame:
        """(point_id, w, d2, center_id) once the newest centres are known too; of equal distances the older centre stays."""
        numbered = Centers(newest.matrix, [self.count + i for i in range(len(newest))])
        fresh = self.points
        if self.known is not None:
            before = self.known.select(F.col(POINT_ID).alias("of"), F.col("d2").alias("known"), F.col("center_id").alias("by"))
            fresh = fresh.join(before, F.col(POINT_ID) == F.col("of"))
        fresh = with_nearest(fresh, numbered)
        if self.known is not None:
            closer = F.col("d2") < F.col("known")
            fresh = fresh.withColumn("center_id", F.when(closer, F.col("center_id")).otherwise(F.col("by"))).withColumn(
                "d2", F.least("d2", "known")
            )
        return fresh.select(POINT_ID, weight_of(self.points).alias("w"), "d2", "center_id")

    def add(self, newest: Centers) -> DataFrame:
        """Measures the newest centres and returns what is known now."""
        if self.known is None:
            # one table holds the points and, in columns of their own, what is known of them so far
            table = self._write(with_nearest(self.points, newest), "points")
            self.points = table.select(*self.columns)
            self.known = table.select(POINT_ID, weight_of(table).alias("w"), "d2", "center_id")
        else:
            with self._sorted_buckets():
                self.known = self._write(self.scored(newest), "known")
            if len(self.tables) > 2:
                self._drop(self.tables.pop(-2))
        self.count += len(newest)
        return self.known

    def draw(self, draws: int, seed: int, step: int, uniform: str = "xxhash64") -> DataFrame:
        """Rows drawn in proportion to their distance (times weight), with their coordinates; at most ``draws``."""
        chosen = weighted_draw(self.known, draws, seed, f"draw{step}", uniform).withColumn("place", F.monotonically_increasing_id())
        chosen = chosen.select(F.col(POINT_ID).alias("drawn"), "d2", "place")
        found = self.points.join(F.broadcast(chosen), F.col(POINT_ID) == F.col("drawn"))  # ``draws`` rows
        return found.select(POINT_ID, "x", "d2", "place")

    def weights(self) -> DataFrame:
        """(center_id, weight, cost) of the centres that have points, from what is known alone."""
        return self.known.groupBy("center_id").agg(F.sum("w").alias("weight"), F.sum(F.col("d2") * F.col("w")).alias("cost"))

    def __enter__(self) -> "CarriedDistances":
        return self

    def __exit__(self, *_) -> None:
        for table in self.tables:
            self._drop(table)
        self.tables = []
        self.run.__exit__(None)
