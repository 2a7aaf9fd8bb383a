"""Row operators: inserts, merges, deletes, seeds. Each returns the new table as a plan; writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def insert_ignoring_duplicates(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is new are inserted; those of a known key are left out."""
    return insert(table, rows.join(table.select(key), key, "left_anti"))


def insert_batch_or_nothing(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The whole batch is inserted, or none of it if any of its keys is known."""
    clash = rows.join(table.select(key), key, "left_semi").agg(F.count("*").alias("_clash"))
    return insert(table, rows.join(F.broadcast(clash)).where("_clash = 0").drop("_clash"))


def _merge(table: DataFrame, changes: DataFrame, key: str, how: str) -> DataFrame:
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    pick = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in table.columns]
    return table.join(new, key, how).select(*pick)


def update_merge(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Non-null columns of ``changes`` replace those of rows with the same key; null does not clear a column."""
    return _merge(table, changes, key, "left")


def upsert_merge(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """As update_merge(), and rows of unknown keys are inserted."""
    return _merge(table, changes, key, "full")


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids, key, "left_anti")


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The parents without ``ids`` (as "parents") and each child table without rows whose link is one of them."""
    gone = {name: child.join(ids.withColumnRenamed(key, link), link, "left_anti") for name, (child, link) in children.items()}
    return {"parents": delete_ids(parents, ids, key)} | gone


def replace_by_parent(children: DataFrame, fresh: DataFrame, link: str) -> DataFrame:
    """Idempotent reprocessing: the old children of every parent in ``fresh`` go, the fresh ones come."""
    return insert(children.join(fresh.select(link).distinct(), link, "left_anti"), fresh)


def seed_if_absent(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return insert_ignoring_duplicates(table, rows, key)


def relate(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Appends edges (in, out); duplicates stay."""
    return insert(edges, new)


def relate_once(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Appends edges that are not there yet."""
    return insert(edges, new.distinct().join(edges.select("in", "out"), ["in", "out"], "left_anti"))


def point_lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def valid_rows(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The table with ``problem``: the first failed check's name, or null for a valid row."""
    problem = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()))
    return table.withColumn("problem", problem)


def page(table: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset is not negative")
    return table.orderBy(*order).offset(offset).limit(limit)


def saved(table: DataFrame, rows: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Saves rows: new keys are inserted with both stamps, known ones merged with ``updated`` alone; nulls clear nothing."""
    stamped = rows.withColumn("updated", now)
    return upsert_merge(table, stamped.join(table.select(key), key, "left_anti").withColumn("created", now).unionByName(stamped.join(table.select(key), key, "left_semi").withColumn("created", F.lit(None).cast(table.schema["created"].dataType))), key)


def patched(single: DataFrame, **values: Column) -> DataFrame:
    """A one-row table with these columns set; the others stay."""
    return single.withColumns(values)


def non_null_update(table: DataFrame, **values: Column) -> DataFrame:
    """Columns take the values that are not null."""
    return table.withColumns({c: F.coalesce(v, F.col(c)) for c, v in values.items()})


def sort_key(text: str, allowed: tuple[str, ...]) -> list[Column]:
    """Ordering from "column asc|desc"; other columns or directions are an error. Ties go by id."""
    column, _, way = text.strip().partition(" ")
    if column not in allowed or way.strip().lower() not in ("", "asc", "desc"):
        raise ValueError(f"cannot sort by {text!r}")
    return [F.desc(column) if way.strip().lower() == "desc" else F.asc(column), F.asc("id")]
