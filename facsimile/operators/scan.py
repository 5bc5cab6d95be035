"""W1 / J1 support: running sums and ordinals that never put a group in one task.

A window ``partitionBy(group).orderBy(x)`` sends a whole group to one task;
if one group holds a third of the data that task holds a third of the data.
Here the rows are range-partitioned on (group, order) and sorted there: the only
shuffle.  One pass over each sorted partition gives running sums of each group's
chunk (numpy on Arrow batches, the layout stays as it is), the chunk totals (one
row per group and partition) are prefix-summed, and the offsets are joined back.
With no group keys the same code yields a global order statistic.

Rows that agree in (group, order) can't be parted by range, so callers either add
what tells rows apart to ``order`` or aggregate equal values first.

The sorted intermediate is written to the shared checkpoint folder before its
totals are taken, so both uses read the same rows even if range bounds would be
sampled anew on recomputation.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, IntegralType, StructField, StructType

from ..session import materialize, shuffle_partitions
from .joins import join_null_safe, sized_broadcast


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _differs(before: pa.Array, now: pa.Array) -> np.ndarray:
    """Where two arrays differ, null being equal to null."""
    same = pc.fill_null(pc.equal(before, now), False)
    return ~pc.or_(same, pc.and_(pc.is_null(before), pc.is_null(now))).to_numpy(zero_copy_only=False)


def _local_pass(keys: Sequence[str], sums: Sequence[str], next_of: str | None):
    """mapInArrow body over a sorted partition.

    Adds the partition's number, running sums within each group's chunk, whether
    the row is its chunk's first or last, and the next row's value in the chunk.
    A batch's last row waits for the next batch, as it may not be its chunk's last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None
        carry = dict.fromkeys(sums, 0)
        key_before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows > 1:
                out, carry, key_before = emit(part, batch, batch.num_rows - 1, carry, key_before)
                yield out
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield emit(part, held, 1, carry, key_before)[0]

    def emit(part, batch, rows, carry, key_before):
        """The first ``rows`` rows; what follows them in the batch is looked at only."""
        n = batch.num_rows
        first = np.zeros(n, bool)
        first[0] = key_before is None
        for k, name in enumerate(keys):
            column = batch.column(name)
            first[1:] |= _differs(column.slice(0, n - 1), column.slice(1))
            if key_before is not None:
                first[0] |= bool(_differs(key_before[k], column.slice(0, 1))[0])
        last = np.append(first[1:], rows == n)[:rows]
        starts = np.flatnonzero(first[:rows])
        columns, names, kept = list(batch.slice(0, rows).columns), list(batch.schema.names), {}
        columns += [pa.array(np.full(rows, part, np.int32)), pa.array(first[:rows]), pa.array(last)]
        names += ["__pid", "__first", "__last"]
        for name in sums:
            v = pc.fill_null(batch.column(f"__v_{name}"), 0).to_numpy(zero_copy_only=False)[:rows]
            run_ = np.cumsum(v)
            before = np.concatenate(([0], run_))[starts]  # what the chunk's sum starts from
            chunk = np.cumsum(first[:rows]) - 1
            local = np.where(chunk < 0, run_ + carry[name], run_ - (before[np.maximum(chunk, 0)] if len(before) else 0))
            columns.append(pa.array(local.astype(v.dtype)))
            names.append(f"__loc_{name}")
            kept[name] = local[-1]
        if next_of is not None:
            value = batch.column(next_of)
            after = pa.concat_arrays([value.slice(1), value.slice(0, 0) if rows < n else pa.nulls(1, value.type)]).slice(0, rows)
            columns.append(pc.if_else(pa.array(last), pa.scalar(None, value.type), after))
            names.append("__lead")
        keys_now = [batch.column(name).slice(rows - 1, 1) for name in keys]
        return pa.RecordBatch.from_arrays(columns, names), kept, keys_now

    return run


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 sums: Mapping[str, str | Column], *, partitions: int | None = None,
                 tag: str = "scan", next_of: str | None = None) -> DataFrame:
    """Add inclusive running sums (ROWS frame) of ``sums`` within ``keys`` in ``order``.

    ``order`` should be a total order within each group for reproducible
    results when the summed values differ among ties.  ``next_of`` adds
    ``__next_<col>``: the value of that column on the following row of the
    group (null on the last), bridging range-partition boundaries.
    """
    keys = list(keys)
    order_cols = [_as_col(o) for o in order]
    n = partitions or shuffle_partitions(df.sparkSession)
    base = df.withColumns({f"__v_{name}": _as_col(c) for name, c in sums.items()})
    base = base.withColumns({f"__v_{name}": F.col(f"__v_{name}").cast(
        "long" if isinstance(base.schema[f"__v_{name}"].dataType, IntegralType) else "double") for name in sums})
    layout = [*[F.col(k) for k in keys], *order_cols]
    ranged = base.repartitionByRange(n, *layout).sortWithinPartitions(*layout)
    fields = [*base.schema.fields, StructField("__pid", IntegerType()), StructField("__first", BooleanType()), StructField("__last", BooleanType()),
              *[StructField(f"__loc_{name}", base.schema[f"__v_{name}"].dataType) for name in sums]]
    if next_of is not None:
        fields.append(StructField("__lead", base.schema[next_of].dataType))
    local = materialize(ranged.mapInArrow(_local_pass(keys, list(sums), next_of), StructType(fields)), tag)
    # one row for each chunk: its totals, and with next_of what it begins with
    chunks = local.where("__last").select(*keys, "__pid", *[F.col(f"__loc_{name}").alias(f"__tot_{name}") for name in sums])
    w_pid = Window.partitionBy(*keys).orderBy("__pid")
    w_prev = w_pid.rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum(f"__tot_{name}").over(w_prev), F.lit(0)).alias(f"__off_{name}") for name in sums]
    if next_of is not None:
        begins = local.where("__first").select(*keys, "__pid", F.col(next_of).alias("__begin"))
        chunks = join_null_safe(chunks, begins, keys + ["__pid"])
        offs.append(F.lead("__begin").over(w_pid).alias("__next_first"))
    offsets = chunks.select(*keys, "__pid", *offs)
    joined = join_null_safe(local, sized_broadcast(offsets), keys + ["__pid"])
    out = joined.withColumns({name: F.col(f"__loc_{name}") + F.col(f"__off_{name}") for name in sums})
    if next_of is not None:
        out = out.withColumn(f"__next_{next_of}", F.when(F.col("__last"), F.col("__next_first")).otherwise(F.col("__lead")))
        out = out.drop("__lead", "__next_first")
    return out.drop(*[f"__{kind}_{name}" for name in sums for kind in ("v", "loc", "off")], "__pid", "__first", "__last")


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            name: str = "ordinal", *, partitions: int | None = None,
            next_of: str | None = None) -> DataFrame:
    """0-based position of each row within its group (global if no keys)."""
    out = running_sums(df, keys, order, {f"__cnt_{name}": F.lit(1)},
                       partitions=partitions, tag="ordinal", next_of=next_of)
    return out.withColumn(name, F.col(f"__cnt_{name}") - 1).drop(f"__cnt_{name}")
