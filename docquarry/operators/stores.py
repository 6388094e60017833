"""Keyed stores as DataFrame plans: upserts, appends, deletes, look-ups, caches and key migration.

A store is a table; each change is a plan from the old table to the new one, which the caller writes where it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with the last row (by ``order``) of each key of ``batch`` in place of its own; ``keep`` columns stay as first stored.

    Only keys of the batch are compared; the aggregate combines before its shuffle, so a hot key costs one row a task.
    """
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
    if keep:
        old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in keep])
        last = last.join(old, key, "left").select(*[F.coalesce(F.col(f"old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in batch.columns])
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def append(stored: DataFrame, batch: DataFrame, order: str, blocks: int = 64) -> DataFrame:
    """``batch`` with ids after the greatest stored one, in ``order``: ranks within blocks of ``order``, after the sizes of those before."""
    first = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("first"))
    cuts = batch.approxQuantile(order, [i / blocks for i in range(1, blocks)], 0.001)
    block = sum((F.col(order) > c).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)
    dealt = batch.withColumn("block", F.lit(0) + block)
    sizes = dealt.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", F.expr("coalesce(sum(n) over (order by block rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(order))
    return dealt.withColumn("rank", rank).join(F.broadcast(before), "block").crossJoin(F.broadcast(first)).withColumn("id", (F.col("first") + F.col("before") + F.col("rank")).cast("long")).select("id", *batch.columns)


def lookup(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_semi")


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``stored`` without the rows whose ``key`` is in ``gone``."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def without_chapter(chunks: DataFrame, doc: str, title: str) -> DataFrame:
    return chunks.where(~((F.col("doc") == doc) & (F.col("chapter") == title)))


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose ``column`` does not begin with ``prefix``, read literally."""
    return rows.where(~F.col(column).startswith(prefix))


def emptied(stored: DataFrame) -> DataFrame:
    return stored.where(F.lit(False))


def migrate(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` renamed by ``mapping(old_id, new_id)``; others stay."""
    return rows.join(mapping, F.col(column) == F.col("old_id"), "left").withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


def migrate_lists(rows: DataFrame, mapping: DataFrame, column: str, key: str) -> DataFrame:
    """The same for a column of lists, which keep their order."""
    each = rows.select(key, F.posexplode(column).alias("at", "id"))
    new = migrate(each, mapping, "id").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias(column))
    return rows.drop(column).join(new, key, "left").withColumn(column, F.coalesce(column, F.array()))


def fresh(cache: DataFrame, now: Column, days: str = "ttl_days") -> DataFrame:
    """Entries younger than their own number of days."""
    return cache.where(now - F.col("created_at") < F.col(days) * 86400)


def cached(asked: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """``asked(qid, text)`` with ``result`` of the entry that has its hash (null: a miss); with ``now``, of a fresh one only."""
    entries = cache if now is None else fresh(cache, now)
    return asked.withColumn("query_hash", T.query_hash(F.col("text"))).join(entries.select("query_hash", "result"), "query_hash", "left")


def sessions_by_age(sessions: DataFrame) -> DataFrame:
    """Sessions, the last changed first, with a preview of the report."""
    return sessions.withColumn("preview", F.substring("report", 1, 200)).orderBy(F.coalesce("updated_at", "created_at").desc(), "session_id")


def enriched(asked: DataFrame, cached_rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``asked`` where columns that are null, empty or 0 take the cached value."""
    old = cached_rows.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string").isin("", "0"))
    return asked.join(old, key, "left").select(key, *[F.when(blank(c), F.coalesce(F.col(f"old_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in columns])


def widened(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Rows of an older schema beside those of the new one, with ``defaults`` for what they lack."""
    return old.unionByName(new, allowMissingColumns=True).fillna(defaults)
