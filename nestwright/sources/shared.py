"""Written tables that end a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage ended by a reliable checkpoint. Its files go with the last DataFrame that reads them where
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="nestwright-"))
    return df.checkpoint()


#: Operators after which rows may come out in another order or in other partitions when a plan is computed again.
_UNSTABLE = re.compile(r"\b(Aggregate|Join|Sort|Window|Repartition\w*|Rebalance\w*|Distinct|Sample|GlobalLimit|Offset)\b")


def stable(df: DataFrame) -> DataFrame:
    """df with its row numbers alike whenever it is read: a scan numbers them so each time, anything with a shuffle in it
    is checkpointed once."""
    return cut(df) if _UNSTABLE.search(df._jdf.queryExecution().optimizedPlan().toString()) else df
