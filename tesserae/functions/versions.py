"""Version comparison with pre-releases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(version: Column) -> Column:
    """Sortable: the release numbers without trailing zeros, then whether it is final, then the pre-release's name and number."""
    plain = F.regexp_replace(F.lower(F.trim(version)), "^v", "")
    release = F.transform(F.split(F.regexp_extract(plain, r"^([0-9.]+)", 1), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    # Zeros at the end don't count: arrays compare number by number, and a shorter one comes first.
    last = F.array_max(F.transform(release, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    numbers = F.slice(release, F.lit(1), F.coalesce(last, F.lit(0)))
    pre = F.regexp_extract(plain, r"^[0-9.]+[-_.]?([a-z]+)", 1)
    number = F.coalesce(F.regexp_extract(plain, r"^[0-9.]+[-_.]?[a-z]+[-_.]?([0-9]+)", 1).try_cast("int"), F.lit(0))
    rank = F.when(pre == "", 3).when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).otherwise(2)
    return F.struct(numbers.alias("n"), rank.alias("r"), number.alias("k"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0)
