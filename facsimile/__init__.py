"""facsimile: synthetic look-alike tables on Spark.

Profile a table of credit contracts, fit a statistical model to it, sample a
synthetic table of any size and score how close the two are.  Every step is a
lazy DataFrame job; random draws come from a portable counter-based hash so
results do not depend on partitioning or retries.

Sub-packages
------------
sources    inputs and sinks (tagged multi-source load, CSV/TSV, metadata)
functions  Column-level helpers (hash uniforms, normal CDF/quantile, formats)
operators  the library proper (profile, generate, marginals, copula, evaluate,
           constraints, drivers, distributed scans)
plans      end-to-end jobs and the query catalogue used by ``__spark_entry__``
"""

__version__ = "0.1.0"
