"""Scale probe for the ordered operators (local measurement only, not a registered query).

Replicates the events of an sf directory ``copies`` times with shifted user ids
(one extra copy set is given to a single user, so that user holds about a third
of all rows), then runs bounded time interpolation (G1) over it and reports wall
time and the largest (key, chunk) partition.

    python scripts/scale_probe.py [--copies 100] [--sf-dir /root/testdata/sf0.1]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--copies", type=int, default=100)
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    args = ap.parse_args()

    from pyspark.sql import functions as F

    from gridpv.operators import series
    from gridpv.operators.series import CHUNK, with_chunk
    from gridpv.session import get_session
    from gridpv.sources.testdata import r2_sparse

    spark = get_session("local[8]", shuffle_partitions=64)
    spark.sparkContext.setLogLevel("ERROR")
    base = r2_sparse(spark, args.sf_dir)
    n_users = base.agg(F.max("gsp_id")).first()[0] + 1
    # Ordinary copies: new user ids; the hot user's copies: same id, shifted in time.
    cold = base.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(args.copies - 1)))).select(
        (F.col("gsp_id") + F.col("_copy") * n_users).alias("gsp_id"), "datetime_gmt",
        (F.col("event_id") * args.copies + F.col("_copy")).alias("event_id"), "generation_mw")
    hot = base.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(args.copies // 2 - 1)))).select(
        F.lit(-1).cast("long").alias("gsp_id"),
        F.timestamp_add("DAY", F.col("_copy") * 31, F.col("datetime_gmt")).alias("datetime_gmt"),
        (F.col("event_id") * args.copies + F.col("_copy") + 10**12).alias("event_id"), "generation_mw")
    data = cold.unionByName(hot)
    import tempfile

    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "events")
    data.write.parquet(path)
    df = spark.read.parquet(path)
    n = df.count()
    hot_n = df.filter("gsp_id = -1").count()
    biggest = with_chunk(df, "datetime_gmt").groupBy("gsp_id", CHUNK).count().agg(F.max("count")).first()[0]
    t0 = time.time()
    out = series.interpolate_time(df, ["gsp_id"], "datetime_gmt", "generation_mw", limit=12, tiebreak=["event_id"])
    out.write.format("noop").mode("overwrite").save()
    dt = time.time() - t0
    print(f"rows={n} hot_key_rows={hot_n} largest_key_chunk={biggest} g1_wall={dt:.1f}s")
    spark.stop()


if __name__ == "__main__":
    main()
