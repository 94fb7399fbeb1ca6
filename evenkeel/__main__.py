"""Joins two tables held by several nodes as a settings file says, and reports the run.

    spark-submit --py-files evenkeel.zip evenkeel/__main__.py SETTINGS DATA [--sink PATH]
    python -m evenkeel SETTINGS DATA

DATA has folders 0, 1, ... up to the settings' node_nums, each with files small and big of lines
``key,value`` (and small.skew, big.skew where detection is static).
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evenkeel import options
from evenkeel.operators import metrics
from evenkeel.plans import joins
from evenkeel.sources import text

log = logging.getLogger("evenkeel")


def run(spark: SparkSession, settings: str, data: str, sink: str | None = None) -> dict:
    """The run's figures; with a sink, the joined rows are written there as Parquet first."""
    o = options.read(settings)
    paths = [f"{data}/{i}/{name}" for i in range(o.buckets) for name in ("small", "big")]
    if gone := text.missing(spark, paths):
        raise FileNotFoundError(f"not there: {', '.join(gone)}")
    big, small = (text.read_sent_pairs(spark, data, name, o.buckets) for name in ("big", "small"))
    statistics = None
    if not o.online:
        listed = text.read_statistics(spark, [f"{data}/{i}/big.skew" for i in range(o.buckets)])
        statistics = listed.groupBy("key").agg(F.sum("count").alias("cnt"))
    log.info("%s over %d nodes of %s", o.strategy, o.buckets, data)
    out = joins.configured_join(big, small.drop("sender"), "key", o, "sender", statistics=statistics)
    if sink:
        out.write.parquet(sink)
        out = spark.read.parquet(sink)
    got = metrics.timed(out)
    return {"strategy": o.strategy, "rows": got.rows, "seconds": round(got.seconds, 3), "million_rows_a_second": got.million_rows_a_second, "shuffled_bytes": got.shuffled_bytes, "shuffled_rows": got.shuffled_rows}


def main() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("settings")
    args.add_argument("data")
    args.add_argument("--sink")
    a = args.parse_args()
    print(json.dumps(run(SparkSession.builder.appName("evenkeel").getOrCreate(), a.settings, a.data, a.sink)))


if __name__ == "__main__":
    main()
