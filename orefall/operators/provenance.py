"""An order-free digest of a table, and the record of what a result was made from."""

from __future__ import annotations

import platform
from datetime import UTC, datetime

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the values of a row, and in place of a null.
BETWEEN, NULL = "\x1f", "\x00"
LIMBS = 4


def row_text(columns: list[str]) -> Column:
    return F.concat_ws(BETWEEN, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in columns])


def digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (rows, digest): the same for any order and partitioning, another after one changed, added or repeated row.

    Rows' hashes of 128 bits are added limb by limb modulo 2^32, so that tasks add up what they read and only sums are
    shuffled. columns: which, in their order; all by default, by name.
    """
    h = F.md5(row_text(columns or sorted(df.columns)).cast("binary"))
    limbs = df.select(*[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)").alias(f"l{i}") for i in range(LIMBS)])
    sums = limbs.agg(F.count("*").alias("rows"), *[(F.coalesce(F.sum(f"l{i}"), F.lit(0)) % F.lit(2**32)).cast("long").alias(f"l{i}") for i in range(LIMBS)])
    return sums.select("rows", F.concat(*[F.lower(F.lpad(F.hex(f"l{i}"), 8, "0")) for i in range(LIMBS)]).alias("digest"))


def record(inputs: dict[str, DataFrame], scope: str, config: dict[str, str]) -> DataFrame:
    """(scope, input, rows, digest, config, engine, at): one row for each input of a result, to be stored beside it."""
    at = datetime.now(UTC).replace(tzinfo=None)
    settings = F.create_map(*[F.lit(x) for k in sorted(config) for x in (k, str(config[k]))]) if config else F.create_map().cast("map<string,string>")
    out = None
    for name in sorted(inputs):
        one = digest(inputs[name]).select(F.lit(scope).alias("scope"), F.lit(name).alias("input"), "rows", "digest", settings.alias("config"), F.lit(f"spark {pyspark.__version__}, python {platform.python_version()}").alias("engine"), F.lit(at).alias("at"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a result has an input at least")
    return out


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(input, change) of two records: added, removed or changed."""
    both = before.select("input", F.col("digest").alias("a"), F.col("rows").alias("m")).join(now.select("input", F.col("digest").alias("b"), F.col("rows").alias("n")), "input", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when((F.col("a") != F.col("b")) | (F.col("m") != F.col("n")), "changed")
    return both.select("input", change.alias("change")).where("change is not null")
