"""Values by segment, and by segment and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.network import Network


def segments_series(network: Network, value, name: str = "value") -> DataFrame:
    """``(segnum, <name>)``: a number for all, or a frame ``(segnum, value)`` or dict that covers the segments exactly."""
    ids = network.segments.select("segnum")
    if isinstance(value, dict):
        value = network.segments.sparkSession.createDataFrame([(int(k), v) for k, v in value.items()], ["segnum", "value"])
    if not isinstance(value, DataFrame):
        return ids.withColumn(name, F.lit(value))
    odd = ids.join(value.select("segnum", F.lit(1).alias("_v")), "segnum", "full").where("_v IS NULL").limit(1).count()
    if odd or value.count() != ids.count():
        raise ValueError("index is different than for segments")
    return value.select("segnum", F.col("value").alias(name))


def long_values(data, times: DataFrame | None, spark: SparkSession, *, mapping: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """``(key, kper, value)`` of a dict of numbers or of equally long lists, or of a frame that has this shape already; ``kper`` null if constant.

    ``mapping(key, to)`` renames keys, all of which it must know; rows of
    ``ignore(key)`` are dropped first. ``times(kper)`` must match the lists' length.
    """
    if isinstance(data, dict):
        lists = [isinstance(v, (list, tuple)) for v in data.values()]
        if any(lists) and not all(lists):
            raise ValueError("mixture of static and time-varying values")
        if any(lists):
            sizes = {len(v) for v in data.values()}
            if len(sizes) > 1:
                raise ValueError("inconsistent lengths found in series")
            if times is not None and times.count() not in sizes:
                raise ValueError(f"length of time series ({sizes.pop()}) is different than the number of stress periods")
            rows = [(int(k), i, float(x)) for k, v in data.items() for i, x in enumerate(v)]
        else:
            rows = [(int(k), None, float(v)) for k, v in data.items()]
        frame = spark.createDataFrame(rows, "key long, kper int, value double")
    else:
        frame = data.select("key", F.col("kper").cast("int").alias("kper"), "value")
    if ignore is not None:
        frame = frame.join(ignore.select("key"), "key", "left_anti")
    if mapping is not None:
        lost = [r[0] for r in frame.select("key").distinct().join(mapping.select("key"), "key", "left_anti").orderBy("key").limit(10).collect()]
        if lost:
            known = frame.join(mapping.select("key"), "key", "left_semi").limit(1).count()
            raise KeyError(f"{len(lost)} or more keys not found in mapping: {lost}" if known else "keys from data are disjoint from those of the mapping")
        frame = frame.join(mapping.select("key", "to"), "key").select(F.col("to").alias("key"), "kper", "value")
    return frame


def unpivot(wide: DataFrame, time: str) -> DataFrame:
    """``(<time>, segnum, flow)`` of a frame with a column per segment number."""
    ids = [c for c in wide.columns if c != time]
    return wide.unpivot([time], ids, "segnum", "flow").withColumn("segnum", F.col("segnum").cast("long"))


def resample_mean(flows: DataFrame, time: str, key: str, value: str, days: int, first_day: str) -> DataFrame:
    """``(period_start, <key>, mean)`` over periods of ``days`` that count from ``first_day``."""
    k = F.floor(F.datediff(F.to_date(time), F.lit(first_day).cast("date")) / days)
    return flows.groupBy(F.date_add(F.lit(first_day).cast("date"), (k * days).cast("int")).alias("period_start"), key).agg(F.avg(value).alias("mean"))


def inflow_by_segment(marked: DataFrame, data: DataFrame) -> DataFrame:
    """``(kper, segnum, inflow)``: values ``data(kper, segnum, value)`` of the outside segments that feed each one in the model, summed."""
    pairs = marked.where("in_model").select("segnum", F.explode("inflow_segnums").alias("from"))
    return pairs.join(data.select("kper", F.col("segnum").alias("from"), "value"), "from").groupBy("kper", "segnum").agg(F.sum("value").alias("inflow"))


def stress_periods(spark: SparkSession, perlen: list[float], start: str) -> DataFrame:
    """``(kper, start_date, end_date)`` of periods of days that follow one another."""
    at, rows = 0.0, []
    for k, days in enumerate(perlen):
        rows.append((k, at, at + days))
        at += days
    frame = spark.createDataFrame(rows, "kper int, a double, b double")
    day = lambda c: (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c) * 86400)).alias
    return frame.select("kper", day("a")("start_date"), day("b")("end_date"))
