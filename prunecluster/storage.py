"""Tables written between rounds, in the folder that all executors share.

A written table ends the lineage of a round, survives the loss of executors, and is packed
into few partitions again when it is read after the survivors have shrunk.
"""

from __future__ import annotations

import json
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="prunecluster-"))
    return context.getCheckpointDir()


class RunTables:
    """The tables of one run, in a folder of their own.

    As a context it removes the folder at the end; without, the folder stays for frames that
    still read from it. A run with a ``name`` finds its tables again when it is started anew, and so
    keeps them if it ends by an error.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.name = spark, name
        self.root = f"{shared_folder(spark).rstrip('/')}/run-{name or uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # what a run that stopped has left half written is written again
        df.write.mode("overwrite" if self.name else "errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def note(self, state: dict) -> None:
        """Writes what a run has come to, in place of nothing or of an earlier note of the same turn."""
        row = self.spark.createDataFrame([(json.dumps(state),)], "state string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/notes/turn={state['turn']}")

    def last_note(self) -> dict | None:
        """The note of the last turn that was written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/notes")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        done = [f"{d.getPath()}" for d in files.listStatus(path)]
        done = [d for d in done if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{d}/_SUCCESS"))]
        if not done:
            return None
        last = max(done, key=lambda d: int(d.rsplit("=", 1)[1]))
        return json.loads(self.spark.read.schema("state string").parquet(last).first().state)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def __enter__(self) -> "RunTables":
        return self

    def __exit__(self, error, *_) -> None:
        if error is None or self.name is None:
            self._delete(self.root)
