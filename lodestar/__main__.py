"""python -m lodestar: a small collection is filled, searched and shown."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from lodestar.collection import Collection
from lodestar.types import Metric


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as folder:
        c = Collection(spark, 3, Metric.cosine)
        c.open_lsm(folder)
        for id, values, lang in ((1, [1.0, 0.0, 0.0], "en"), (2, [0.6, 0.8, 0.0], "de"), (3, [0.0, 0.0, 1.0], "en")):
            print("insert", id, c.insert(id, values, {"lang": lang}).value)
        print("insert 1 again", c.insert(1, [0.0, 1.0, 0.0]).value)
        c.flush()
        c.search([1.0, 0.5, 0.0], 2).orderBy("rank").show()
        c.search([1.0, 0.5, 0.0], 2, {"lang": "en"}).orderBy("rank").show()
        print("size", c.size(), "segments", c.segments)
    spark.stop()


if __name__ == "__main__":
    main()
