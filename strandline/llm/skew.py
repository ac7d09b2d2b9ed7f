"""Equi-joins in which a hot key is dealt to several tasks, by plain DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT of a join's rows is dealt to several tasks.
HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, deal: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``), hot keys split by ``deal``.

    Keys with more than 1 / ``HOT`` of the rows get a salt for each such share. There are
    fewer than ``HOT`` of them, which bounds what is broadcast, and ``table`` repeats their
    rows fewer than 2 * ``HOT`` times. ``hot``: what ``hot_keys`` gave for these rows.
    """
    hot = F.broadcast(hot_keys(rows, key) if hot is None else hot)
    salts = F.when(F.col(key).isNull(), HOT).otherwise(F.coalesce("__salts", F.lit(1)))  # null keys match nothing
    salt = F.pmod(F.xxhash64(deal), salts).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__salts")
    copies = table.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)).cast("int") - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, __salts) of the keys with more than 1 / ``HOT`` of the rows; read from files, so cheap to repeat."""
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total)
    return counts.select(key, F.ceil(F.col("n") * HOT / F.lit(max(1, total))).alias("__salts"))
