"""Tables between the steps of one run, in a folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class Shared:
    """A folder below spark.checkpoint.dir for one run. What is written there cuts the lineage and survives lost executors; drop()
    deletes a table, or all of them when the result has been written elsewhere. Where the setting is absent, a local session
    (one machine, as in tests) sets one; a cluster must name it."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file:///tmp/checkpoints/{os.getpid()}"
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.folder, self.count = spark, f"{root.rstrip('/')}/{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df as a table; all others of the run go."""
        done, made = self.written(df), self.count
        for number in range(1, made):
            self.drop(number)
        return done

    def drop(self, number: int | None = None) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder if number is None else f"{self.folder}/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
