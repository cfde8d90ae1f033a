"""Column names and types of uploaded tables, from strings alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"
CODE = r"^[+-]*0[^.]"
DATE = r"^\d{4}-\d{2}-\d{2}$"
STAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def column_names(header: list[str], most: int = 63) -> list[str]:
    """No quotes or line ends, blanks become col_i, at most `most` bytes of whole characters, repeats numbered in order."""
    out: list[str] = []
    for i, raw in enumerate(header, start=1):
        base = " ".join(raw.replace('"', "").splitlines()).strip() or f"col_{i}"
        name, n = _cut(base, most), 1
        while name in out:
            n += 1
            name = _cut(base, most - len(f"_{n}")) + f"_{n}"
        out.append(name)
    return out


def _cut(s: str, most: int) -> str:
    return s.encode()[:most].decode(errors="ignore")


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _every(test: Column, value: Column) -> Column:
    return (F.count(value) > 0) & F.coalesce(F.bool_and(F.when(value.isNotNull(), test)), F.lit(False))


def type_of(c: Column) -> Column:
    """Aggregate: numeric, boolean, date, timestamp or text, in this order. Blanks say nothing; leading zeros make codes."""
    v = _given(c)
    plain = F.regexp_replace(v, ",", "")
    numeric = F.lower(plain).rlike(NUMBER) & ~plain.rlike(CODE)
    date = v.rlike(DATE) & F.try_to_date(v, "yyyy-MM-dd").isNotNull()
    stamp = v.rlike(DATE) & F.try_to_date(v, "yyyy-MM-dd").isNotNull() | v.rlike(STAMP) & F.try_to_timestamp(v).isNotNull()
    return (
        F.when(_every(numeric, v), "numeric").when(_every(F.lower(v).isin("true", "false"), v), "boolean").when(_every(date, v), "date").when(_every(stamp, v), "timestamp").otherwise("text")
    )


def column_types(df: DataFrame) -> DataFrame:
    """(column, type) of all columns in one pass."""
    one = df.agg(*[type_of(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    return one.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "type")


def typed(df: DataFrame) -> DataFrame:
    """df of strings with each column cast to its inferred type; blanks become null, thousands separators go.

    Numbers keep their largest number of decimals exactly; exponents need doubles.
    """
    kinds = {r["column"]: r["type"] for r in column_types(df).collect()}
    scale = {c: F.max(F.length(F.regexp_extract(F.regexp_replace(F.col(f"`{c}`"), ",", ""), r"\.(\d+)$", 1))).alias(c) for c, k in kinds.items() if k == "numeric"}
    powers = {c: F.bool_or(F.lower(F.col(f"`{c}`")).rlike("[a-z]")).alias(c + "\0e") for c in scale}
    seen = df.agg(*scale.values(), *powers.values()).first() if scale else {}
    out = []
    for c in df.columns:
        v, k = _given(F.col(f"`{c}`")), kinds[c]
        if k == "numeric":
            v = F.regexp_replace(v, ",", "").cast("double" if seen[c + "\0e"] else f"decimal(38,{min(seen[c] or 0, 18)})")
        elif k != "text":
            v = v.cast({"boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz"}[k])
        out.append(v.alias(c))
    return df.select(*out)


def enum_values(df: DataFrame, columns: list[str], most: int = 12, longest: int = 40) -> DataFrame:
    """(column, values): sorted distinct values of each column; null if there are none, over `most`, or one is too long.

    Each value is counted once for a task, then once for all, so that a column of many values gathers nowhere.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    distinct = long.where(F.col("value").isNotNull()).distinct()
    few = distinct.groupBy("column").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("len")).where((F.col("n") <= most) & (F.col("len") <= longest))
    lists = distinct.join(F.broadcast(few.select("column")), "column").groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("values"))  # one row a column; at most `most` values
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(lists, "column", "left")
