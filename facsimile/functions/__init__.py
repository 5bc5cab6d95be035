"""Column-level helpers.

Numeric formulas are written once as SQL text (``dialect`` = ``"spark"`` or
``"duckdb"``) so the Spark job (via ``F.expr``) and the DuckDB oracle evaluate
the very same expression; only the hex-to-integer step differs by dialect.
"""
