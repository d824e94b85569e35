"""Cell-signal measurements: band filter, operator filter, export in fewer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardgrid.schemas import SIGNAL

# The accepted signal band in dBm, and the name that stands for all operators.
WEAKEST = -121
STRONGEST = -44
ALL_OPERATORS = "todos"


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """The five columns in use; the scan reads no others."""
    return spark.read.parquet(path).select(*SIGNAL.fieldNames())


def valid_signal(df: DataFrame, lo: float = WEAKEST, hi: float = STRONGEST) -> DataFrame:
    """Measurements inside the band, both ends included."""
    return df.filter(F.col("rsrp").between(lo, hi))


def by_operator(df: DataFrame, name: str | None = None) -> DataFrame:
    """Measurements of one operator; of all without a name."""
    if name is None or name == ALL_OPERATORS:
        return df
    return df.filter(F.col("network_operator_name") == name)


def selected_signal(df: DataFrame, name: str | None = None) -> DataFrame:
    """Band and operator filters together."""
    return by_operator(valid_signal(df), name)


def export_signal(df: DataFrame, name: str | None, path: str) -> None:
    """Write the selection in few files of an even size.

    The scan and the filters keep all their tasks; only what is left is dealt out anew.
    """
    selected_signal(df, name).hint("rebalance").write.mode("overwrite").parquet(path)
