"""File sources and sinks.

The reference downloads from web services; here the same data is read from
files landed in storage.  Schemas are explicit, optional columns nullable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.operators import series
from gridpv.operators.joins import small_side
from gridpv.schemas import GENERATION_SCHEMA, weather_payload_schema


def read_capacity(spark: SparkSession, path: str, history: bool = True, release: str | None = None) -> DataFrame:
    """A1 (+B1-B3, C1): capacity CSV (gzip or plain) with a header.

    Known columns are typed (bad text becomes NULL and the row is dropped by C1);
    ``install_month`` is a date when ``history``.
    """
    from gridpv.operators.clean import clean_capacity

    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    types = {"cumul_capacity_mwp": "double", "dc_capacity_MWp": "double", "dc_capacity_mwp": "double",
             "system_count": "double"}
    if history:
        types["install_month"] = "date"
    cols = []
    for c in raw.columns:
        t = types.get(c)
        cols.append(F.col(c).try_cast(t).alias(c) if t else F.col(c))
    return clean_capacity(raw.select(*cols), release)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """A3: location CSV; ids stay text (they are coerced by C6); ``row_ord`` keeps
    the order of rows, file by file (by path), for "first row" rules."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    types = {"gsp_lat": "double", "gsp_lon": "double", "pes_id": "int"}
    cols = [F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns]
    # the partition order of several files is not theirs; the rank of a path is over file names only
    place = raw.select(*cols, F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_id"))
    paths = sorted(r[0] for r in place.select("_path").distinct().collect())
    if len(paths) < 2:
        return place.select(*raw.columns, F.col("_id").alias("row_ord"))
    rank = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p), F.lit(i))])[F.col("_path")]
    # ids have 33 bits within a partition; a file of several partitions keeps their order
    return place.select(*raw.columns, (rank.cast("decimal(38,0)") * (1 << 62) + F.col("_id")).alias("row_ord"))


def select_generation(gen: DataFrame, start: str, end: str, gsp_ids: DataFrame | Sequence[int] | None = None,
                      include_national: bool = False, ts: str = "datetime_gmt", col: str = "gsp_id",
                      extra_fields: Sequence[str] = ()) -> DataFrame:
    """A4/A5 + C4 + C5 + C9: one scan for the whole fleet.

    Inclusive period (pushed to the parquet scan), national id 0 excluded
    unless asked, and ids restricted by a semi join (a DataFrame of ids) or an
    ``IN`` list (a short literal list) instead of one request per id.
    """
    t = gen.schema[ts].dataType
    x = gen.filter(F.col(ts).between(F.lit(start).cast(t), F.lit(end).cast(t)))
    x = x.filter(F.col(col) >= F.lit(0 if include_national else 1))
    if isinstance(gsp_ids, DataFrame):
        x = x.join(small_side(gsp_ids.select(col)), col, "left_semi")
    elif gsp_ids is not None:
        x = x.filter(F.col(col).isin(list(gsp_ids)))
    keep = [c for c in gen.columns if c in (col, ts, "generation_mw") or c in extra_fields]
    return x.select(*keep)


def read_generation(spark: SparkSession, path: str, start: str, end: str,
                    gsp_ids: DataFrame | Sequence[int] | None = None, include_national: bool = False,
                    extra_fields: Sequence[str] = ()) -> DataFrame:
    """A4/A5: generation parquet.  Stored partitioned by month and sorted by id, the
    period filter prunes files and the id filter skips row groups."""
    gen = spark.read.parquet(path)
    if not extra_fields:
        gen = gen.select(*[f.name for f in GENERATION_SCHEMA.fields if f.name in gen.columns])
    return select_generation(gen, start, end, gsp_ids, include_national, extra_fields=extra_fields)


def read_weather_payload(spark: SparkSession, path: str, fmt: str = "parquet",
                         variables: Sequence[str] | None = None) -> DataFrame:
    """Weather payloads: per location start/end epoch, step, one array per variable."""
    schema = weather_payload_schema(list(variables)) if variables else weather_payload_schema()
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    """Export (CSV with header or parquet), optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_series(df: DataFrame, table: str, keys: Sequence[str], ts: str, step_us: int | None = None, buckets: int = 200,
                 path: str | None = None, mode: str = "errorifexists") -> None:
    """A9 for series: a table bucketed by (keys, chunk) and sorted by time, the layout of the ordered operators.

    With ``step_us`` (a regular series) chunks hold about 256 steps, as the pipelines use them, else one day.  Read
    with ``spark.table``, the fills, interpolations and row numbers of a key need no exchange of the rows:
    the chunk column is there already and each bucket holds whole chunks.  One file is written per bucket.
    """
    keys = list(keys)
    width = series.chunk_for_step(step_us) if step_us else series.DEFAULT_CHUNK_US
    x = series.with_chunk(df.drop(series.CHUNK), ts, width).repartition(buckets, *keys, series.CHUNK)
    w = x.write.mode(mode).format("parquet").bucketBy(buckets, *keys, series.CHUNK).sortBy(*keys, series.CHUNK, ts)
    (w.option("path", path) if path else w).saveAsTable(table)
