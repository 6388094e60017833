"""As-of, interval and range joins by buckets of time: no join on an inequality alone, no key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def _micros(rows: DataFrame, c: str) -> F.Column:
    """Microseconds of a time column; without a time zone its parts count, so that no change of clocks disturbs their order."""
    if not isinstance(rows.schema[c].dataType, TimestampNTZType):
        return F.unix_micros(F.col(c).cast("timestamp"))
    seconds = F.expr(f"cast(extract(SECOND FROM `{c}`) * 1000000 AS BIGINT)")
    return (F.unix_date(F.col(c).cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60) * 1_000_000 + seconds


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, carry: list[str], bucket_seconds: int = 86_400, strict: bool = False) -> DataFrame:
    """Each row of ``left`` with columns ``carry`` of the last row of ``right`` of the same ``by`` at or before its time ``at``.

    Rows are put in order within buckets of time, so that a key with most rows is divided; each bucket's last row is handed on
    to later buckets through one row for a key and bucket. Of several right rows at one time the greatest ``carry`` counts. With
    ``strict`` rows of the same time do not count. Left rows without one, or with a null key or time, have nulls in
    ``carry``; all their own columns stay. Names of ``carry`` must not be those of ``left``.
    """
    bucket = lambda rows: F.floor(_micros(rows, at) / (bucket_seconds * 1_000_000))
    entry = F.struct(F.col(at).alias("dq_at"), *[F.col(c) for c in carry])
    rows = left.select(F.struct("*").alias("dq_row"), F.col(by).alias("dq_by"), F.col(at).alias("dq_time"), bucket(left).alias("dq_bucket"), F.lit(None).alias("dq_entry"), F.lit(0 if strict else 2).alias("dq_side"))
    held = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.lit(None).alias("dq_row"), F.col(by).alias("dq_by"), F.col(at).alias("dq_time"), bucket(right).alias("dq_bucket"), entry.alias("dq_entry"), F.lit(1).alias("dq_side"))
    both = rows.unionByName(held)
    lasts = held.groupBy("dq_by", "dq_bucket").agg(F.max("dq_entry").alias("dq_last"))
    wanted = rows.where("dq_by is not null and dq_bucket is not null").select("dq_by", "dq_bucket").distinct()
    steps = lasts.unionByName(wanted.withColumn("dq_last", F.lit(None))).groupBy("dq_by", "dq_bucket").agg(F.max("dq_last").alias("dq_last"))
    before = Window.partitionBy("dq_by").orderBy("dq_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("dq_carried", F.last("dq_last", ignorenulls=True).over(before)).select("dq_by", "dq_bucket", "dq_carried")
    inside = Window.partitionBy("dq_by", "dq_bucket").orderBy("dq_time", "dq_side", "dq_entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("dq_here", F.last("dq_entry", ignorenulls=True).over(inside)).where("dq_side <> 1")
    out = met.join(carried, ["dq_by", "dq_bucket"], "left").withColumn("dq_found", F.when(F.col("dq_by").isNotNull() & F.col("dq_time").isNotNull(), F.coalesce("dq_here", "dq_carried")))
    return out.select("dq_row.*", *[F.col(f"dq_found.{c}").alias(c) for c in carry])


def within(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, bucket_seconds: int = 3_600) -> DataFrame:
    """``points`` joined with all ``spans`` of the same ``by`` whose half-open [``start``, ``end``) holds their time ``at``.

    A span stands in each bucket of time that it touches, and meets only points of that bucket; choose buckets about as long
    as spans. Nulls match nothing. Other columns of the two must have different names.
    """
    width = bucket_seconds * 1_000_000
    last = F.floor((_micros(spans, end) - 1) / width)
    cut = spans.where(F.col(start) < F.col(end)).withColumn("dq_bucket", F.explode(F.sequence(F.floor(_micros(spans, start) / width), last)))
    keyed = points.withColumn("dq_bucket", F.floor(_micros(points, at) / width))
    return keyed.join(cut, [by, "dq_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("dq_bucket")


def near(left: DataFrame, right: DataFrame, by: str, at: str, other_at: str, seconds: int) -> DataFrame:
    """Rows of ``left`` and ``right`` of the same ``by`` whose times ``at`` and ``other_at`` differ by ``seconds`` at most.

    Each right row stands in its own bucket of that width and in both beside it. Nulls match nothing.
    """
    width = seconds * 1_000_000
    keyed = left.withColumn("dq_here", _micros(left, at)).withColumn("dq_bucket", F.floor(F.col("dq_here") / width))
    three = right.withColumn("dq_there", _micros(right, other_at)).withColumn("dq_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("dq_there") / width) + d)))
    return keyed.join(three, [by, "dq_bucket"]).where(F.abs(F.col("dq_here") - F.col("dq_there")) <= width).drop("dq_bucket", "dq_here", "dq_there")
