"""Who may see which rows. Filters stand on the base relation, before any statistic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.config import User
from orefall.errors import CodedError


def may_see(user: User, visibility: str = "visibility", owner: str = "owner_id") -> Column:
    return F.lit(True) if user.is_admin else (F.col(visibility) == "public") | (F.col(owner) == user.user_id)


def visible(df: DataFrame, user: User) -> DataFrame:
    return df.where(may_see(user))


def business(filters: dict[str, list[str]]) -> Column:
    """Each key's values are alternatives, keys are joined by AND. Kind and filename are compared, lists are overlapped."""
    parts = []
    for key, values in filters.items():
        if values:
            scalar = key in ("document_kind", "filename", "source_name")
            parts.append(F.col(key).isin(*values) if scalar else F.arrays_overlap(F.col(key), F.array(*map(F.lit, values))))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def scoped(df: DataFrame, filename: str | None = None, source: str | None = None) -> DataFrame:
    """Exact scope of one document or one source."""
    if filename and source:
        raise CodedError("scope_conflict", "a document and a source cannot both be the scope")
    if filename:
        return df.where(F.col("filename") == filename)
    return df.where(F.col("source_name") == source) if source else df


def write_decision(user: User) -> Column:
    """What a write to a row would answer: ok, not_found, forbidden, admin_required."""
    return (
        F.when(F.col("owner_id").isNull(), "not_found")
        .when(F.lit(user.is_admin), "ok")
        .when(F.col("owner_id") != user.user_id, F.when(F.col("visibility") == "public", "forbidden").otherwise("not_found"))
        .when(F.col("visibility") == "public", "admin_required")
        .otherwise("ok")
    )
