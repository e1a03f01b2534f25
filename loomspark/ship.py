"""Makes a session fit for the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each Spark application, and sets what right results need.

    Spark 4.1 takes a union of parts that are dealt by a key for dealt by it too, though adaptive execution may have merged
    each part's partitions in its own way; rows of one key then come to several groups. The setting is switched off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
        for p in sorted(top.parent.glob("corpus_pipeline.py")):
            z.write(p, p.name)
    sc.addPyFile(target)
    sc._loomspark_shipped = True
