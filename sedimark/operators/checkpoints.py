"""Where iterative operators cut their lineage: the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there. Only a local master (tests) may do without a named folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"sedimark-checkpoints-{os.getpid()}"))
    return df.checkpoint(eager=True)
