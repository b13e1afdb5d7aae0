"""Sessions and table access shared by queries, tests and the command line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("weftline")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Setting with the number of tasks to deal a scan out to; unset, scans stay as their files are cut.
SCAN_TASKS = "spark.weftline.scanTasks"


def spread(df: DataFrame) -> DataFrame:
    """A scan whose cost is in Python per row, dealt out to as many tasks as ``SCAN_TASKS`` says.

    Off unless the session sets it: for tables of a single small file on one machine.
    A large table comes in enough pieces, and a shuffle of its whole texts gains nothing.
    """
    n = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(n)) if n else df
