"""Tenant- and visibility-scoped reads.

``hidden`` tables have (space, row_id) of hidden rows. Reads are composed plans: Catalyst turns the anti and semi joins
into broadcast or sort-merge joins as sizes ask, and pushes filters and columns through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values


def hidden_rows(crdt_rows: DataFrame) -> DataFrame:
    """(space, tbl, row_id) of rows whose stored visibility hides them."""
    return crdt_rows.where(values.is_hidden(F.col("visibility"))).select("space", "tbl", "row_id").distinct()


def visible(domain: DataFrame, hidden: DataFrame, *, spaces: DataFrame | list | None = None, row_id: str = "id", space: str = "space", include_hidden: bool = False) -> DataFrame:
    """Rows of the reader's spaces that are not hidden (F1, F2).

    A row without metadata is visible, and so is one with a null id (an outer join that missed). ``spaces`` None is an
    administrator's read of all spaces; no spaces at all let only null ids through. ``include_hidden`` skips the
    visibility test, never the tenancy (S8).
    """
    rows = domain
    if spaces is not None:
        absent = F.col(row_id).isNull()
        if isinstance(spaces, DataFrame):
            own = spaces.select(F.col(spaces.columns[0]).alias("_space")).distinct()
            rows = rows.where(~absent).join(own, F.col(space) == F.col("_space"), "left_semi").unionByName(rows.where(absent))
        else:
            rows = rows.where(F.col(space).isin(list(spaces)) | absent) if spaces else rows.where(absent)
    if include_hidden:
        return rows
    gone = hidden.select(F.col("space").alias("_space"), F.col("row_id").alias("_row"))
    return rows.join(gone, (F.col(space) == F.col("_space")) & (F.col(row_id) == F.col("_row")), "left_anti")


def find(rows: DataFrame, *, where: Column | None = None, order_by: list[Column] | None = None, limit: int | None = None, offset: int = 0, space: str = "space") -> DataFrame:
    """Filter, order and page visible rows, without the tenancy column (S1-S3, O1, O2). Pages are taken after visibility."""
    out = rows if where is None else rows.where(where)
    if order_by:
        out = out.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.drop(space)


def count(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """The number of visible rows."""
    return (rows if where is None else rows.where(where)).agg(F.count("*").alias("n"))


def include_object(root: DataFrame, target: DataFrame, hidden_target: DataFrame, *, fk: str, target_id: str, space: str = "space") -> DataFrame:
    """Roots with their referenced row (J1). A root whose target is hidden is dropped; one without a target stays."""
    gone = hidden_target.select(F.col("space").alias("_space"), F.col("row_id").alias("_row"), F.lit(True).alias("_hidden"))
    marked = target.join(gone, (F.col(space) == F.col("_space")) & (F.col(target_id) == F.col("_row")), "left").drop("_space", "_row", space)
    joined = root.join(marked, F.col(fk) == F.col(target_id), "left")
    return joined.where(F.col("_hidden").isNull()).drop("_hidden")


def include_list(root: DataFrame, children: DataFrame, *, root_id: str, fk: str, columns: list[str], order_by: list[str], limit: int | None = None, offset: int = 0, name: str = "children") -> DataFrame:
    """Roots with their visible children as an array in order, empty where there are none.

    Paging within each parent ranks children by a window; without paging the arrays are built by one aggregate.
    """
    rows = children.select(F.col(fk).alias("_fk"), *[F.col(c) for c in dict.fromkeys([*order_by, *columns])]).where("_fk is not null")
    if limit is not None or offset:
        place = F.row_number().over(W.partitionBy("_fk").orderBy(*order_by))
        rows = rows.withColumn("_n", place).where(F.col("_n") > offset)
        rows = rows.where(F.col("_n") <= offset + limit) if limit is not None else rows
    kept = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.struct(*columns).alias("child"))
    lists = rows.groupBy("_fk").agg(F.sort_array(F.collect_list(kept)).alias("_list"))
    lists = lists.select("_fk", F.transform("_list", lambda x: x["child"]).alias(name))
    joined = root.join(lists, F.col(root_id) == F.col("_fk"), "left").drop("_fk")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def required(ids: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ids without a row (S7, J12): callers raise where there is any."""
    return ids.join(rows.select(*keys), keys, "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of given ids as a semi join, never a long IN list."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
