"""Who may see a row, and which rows a filter keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def may_see(tenant: str, groups: list[str], shared: str = "shared") -> Column:
    """A row's tenant is the reader's or the shared one, and a group is in common; missing values fail closed."""
    own = F.col("tenant").isin(tenant, shared)
    common = F.arrays_overlap("acl_groups", F.array(*map(F.lit, groups)).cast("array<string>"))
    return F.coalesce(own & common, F.lit(False))


def visible(df: DataFrame, tenant: str, groups: list[str], shared: str = "shared") -> DataFrame:
    return df.where(may_see(tenant, groups, shared))


def marked(df: DataFrame, tenant: str, groups: list[str], shared: str = "shared") -> DataFrame:
    """All rows, with whether the reader is allowed to see each: for reports of violations."""
    return df.withColumn("allowed", may_see(tenant, groups, shared))


def filtered(df: DataFrame, any_of: dict[str, list] | None = None, after: tuple[str, str] | None = None, before: tuple[str, str] | None = None) -> DataFrame:
    """Rows that meet all conditions. No condition keeps all rows; an empty list matches nothing; times are strict."""
    for name, values in (any_of or {}).items():
        df = df.where(F.col(name).isin(*values) if values else F.lit(False))
    kind = dict(df.dtypes)
    if after:
        df = df.where(F.col(after[0]) > F.lit(after[1]).cast(kind[after[0]]))
    if before:
        df = df.where(F.col(before[0]) < F.lit(before[1]).cast(kind[before[0]]))
    return df


def first_failing(rules: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first rule that a row breaks."""
    reason = None
    for name, breaks in rules:
        reason = F.when(breaks, name) if reason is None else reason.when(breaks, name)
    return reason.otherwise(kept)
