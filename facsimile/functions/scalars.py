"""Small scalar helpers (composite key, casts, fixed formats, hashing)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key(cols: Sequence[str], sep: str = "\t") -> Column:
    """``a<sep>b<sep>c`` for output only; grouping uses the columns."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def to_double(c: str, strict: bool = False) -> Column:
    """String -> double; ``try_cast`` (null on bad input) unless strict."""
    return F.col(c).cast("double") if strict else F.expr(f"try_cast(`{c}` AS DOUBLE)")


def to_string(c: str) -> Column:
    """Number -> string."""
    return F.col(c).cast("string")


def fixed4(c: str) -> Column:
    """``format(x, '.4f')`` - no thousands separators."""
    return F.format_string("%.4f", F.col(c))


def sha256_hex(c: str) -> Column:
    """SHA-256 hex of the value's string form."""
    return F.sha2(F.col(c).cast("string"), 256)


def sig_round_sql(x: str, digits: int = 9) -> str:
    """Round to ``digits`` significant digits (same text in Spark and DuckDB)."""
    scale = f"power(10.0, floor(log10(abs({x}))) - {digits - 1})"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 THEN {x} "
            f"ELSE round({x} / {scale}, 0) * {scale} END)")


def sig_round(c: str, digits: int = 9) -> Column:
    return F.expr(sig_round_sql(f"`{c}`", digits))
