"""A centre set small enough to travel with a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A centre set up to this size is shipped to every task; larger ones go block by block.
CENTER_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Centers:
    """Rows of ``matrix`` are centres, in ascending order of ``ids`` (ints or strings)."""

    matrix: np.ndarray
    ids: list = field(default_factory=list)
    weights: np.ndarray | None = None

    def __post_init__(self):
        matrix = np.asarray(self.matrix, dtype=np.float64)
        object.__setattr__(self, "matrix", matrix.reshape(len(matrix), -1))
        if not self.ids:
            object.__setattr__(self, "ids", list(range(len(matrix))))

    def __len__(self) -> int:
        return len(self.matrix)

    @property
    def dims(self) -> int:
        return self.matrix.shape[1]

    @property
    def nbytes(self) -> int:
        """Bytes of the coordinates and the ids."""
        return self.matrix.nbytes + (sum(map(len, self.ids)) if self.id_type == "string" else 4 * len(self))

    @property
    def id_type(self) -> str:
        return "string" if self.ids and isinstance(self.ids[0], str) else "int"

    def with_weights(self, weights) -> "Centers":
        return Centers(self.matrix, self.ids, np.asarray(weights, dtype=np.float64))

    def appended(self, other: "Centers | None") -> "Centers":
        """Union without removal of duplicates; positions become the new ids."""
        if other is None or not len(other):
            return Centers(self.matrix)
        return Centers(np.vstack([self.matrix, other.matrix]))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(center_id, c, weight), weight null where not known."""
        weights = [None] * len(self) if self.weights is None else [float(w) for w in self.weights]
        rows = [(i, c.tolist(), w) for i, c, w in zip(self.ids, self.matrix, weights)]
        return spark.createDataFrame(rows, f"center_id {self.id_type}, c array<double>, weight double")

    @staticmethod
    def from_rows(rows, id_field="center_id", value_field="c") -> "Centers":
        """From collected rows of a table whose size the caller has checked."""
        ordered = sorted(rows, key=lambda r: r[id_field])
        return Centers(np.array([r[value_field] for r in ordered]), [r[id_field] for r in ordered])


def center_table_size(centers: DataFrame) -> tuple[int, int]:
    """(rows, bytes of coordinates and ids) of a centre table, sparse or not."""
    arrays = isinstance(centers.schema["c"].dataType, T.ArrayType)
    held = 8 * F.size("c") if arrays else 12 * F.size("c.indices")
    row = centers.agg(
        F.count("*").alias("n"), F.sum(held + F.octet_length(F.col("center_id").cast("string"))).alias("b")
    ).first()
    return row.n, row.b or 0
