"""Property bags (VARIANT objects) and small text aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def build_props(**cols: Column) -> Column:
    """Object from named columns; NULL-valued keys are left out."""
    return F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()])))


def props_text(**cols: Column) -> Column:
    """The same object as comparable JSON text."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))


def prop(name: str, dtype: str, props: str = "props") -> Column:
    """Lenient typed read: a missing key or malformed value gives NULL, not a failed job."""
    return F.try_variant_get(F.col(props), f"$.{name}", dtype)


def bounded_list(col: Column | str, sep: str = ", ") -> Column:
    """Sorted distinct text list. For value sets of fixed size (nations, brands, classes) only."""
    joined = F.array_join(F.array_sort(F.collect_set(col)), sep)
    return F.when(joined != "", joined)


def round_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """num/den of two whole numbers, rounded half up in integer arithmetic (exact)."""
    scale = 10 ** digits
    n, d = num.cast("bigint"), den.cast("bigint")
    return F.floor((n * (2 * scale) + d).cast("decimal(30,0)") / (d * 2)).cast("double") / scale
