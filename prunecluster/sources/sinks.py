"""Result sinks: one row per run, one summary row per setting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names of the two result files, in file order.
RUN_COLUMNS = [
    "test_name", "k", "dt", "m", "ep", "l", "len(C)", "iterations", "risk", "risk_final",
    "reducers_time", "total_time",
]
SUMMARY_COLUMNS = [
    "algorithm", "k", "epsilon", "coord_mem", "num_centers_avg", "num_centers_stdv", "rounds_avg", "rounds_stdv",
    "final_risk_avg", "final_risk_stdv", "comps_pm_avg", "comps_pm_stdv", "comps_tot_avg", "comps_tot_stdv",
    "reducers_time_avg", "reducers_time_stdv", "total_time_avg", "total_time_stdv",
]

_AVERAGED = {
    "num_centers": "num_centers", "rounds": "iterations", "final_risk": "risk_final", "comps_pm": "comps_pm",
    "comps_tot": "comps_tot", "reducers_time": "reducers_time", "total_time": "total_time",
}


def run_rows(metrics: DataFrame) -> DataFrame:
    """Metrics of single runs in the layout of the run file."""
    named = metrics.withColumnRenamed("num_centers", "len(C)")
    return named.select([F.col(f"`{c}`") for c in RUN_COLUMNS])


def summarize(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation per dataset, algorithm, k, epsilon and steps (null deviation for a single run).

    The columns of the summary file come after dataset and steps, which tell its settings apart.
    """
    measures = []
    for output, source in _AVERAGED.items():
        measures.append(F.avg(source).alias(f"{output}_avg"))
        measures.append(F.stddev_samp(source).alias(f"{output}_stdv"))
    grouped = metrics.groupBy("dataset", "steps", "algorithm", "k", F.col("ep").alias("epsilon"))
    return grouped.agg(F.max("coord_mem").alias("coord_mem"), *measures).select("dataset", "steps", *SUMMARY_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """Appends result rows to a folder of CSV files with headers."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)
