"""Running sums inside groups, however large a group is."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.shared import saved


def running(df: DataFrame, group: str, order: list, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``run_<c>`` for each column ``c``: the sum (or exclusive or) of its values
    in the row's group up to the row, itself included.

    ``group`` is a bigint without nulls; ``order`` orders the rows of a group totally, the
    summed columns are bigints without nulls. Rows are dealt out by ranges of group and
    order, so a group of any size is cut over as many tasks as it needs; each task sums its
    own rows, and what lies before is added from a table of at most two rows for each task.
    Pass narrow rows; they are written once.
    """
    columns = [(c, False) for c in sums] + [(c, True) for c in xors]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = first = None
        total = [0] * len(columns)
        of_first: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(names.index(group)).to_numpy()
            opens = np.r_[True, key[1:] != key[:-1]]
            begin = np.flatnonzero(opens)
            where = np.cumsum(opens) - 1
            out = []
            for i, (name, is_xor) in enumerate(columns):
                x = batch.column(names.index(name)).to_numpy()
                upto = np.bitwise_xor.accumulate(x) if is_xor else np.cumsum(x)
                before = upto[begin] ^ x[begin] if is_xor else upto[begin] - x[begin]
                if last is not None and key[0] == last:
                    before[0] = before[0] ^ total[i] if is_xor else before[0] - total[i]
                out.append(upto ^ before[where] if is_xor else upto - before[where])
            if first is None:
                first = int(key[0])
            if key[0] == first:
                end = int(begin[1]) - 1 if len(begin) > 1 else len(key) - 1
                of_first = [int(x[end]) for x in out]
            last, total = int(key[-1]), [int(x[-1]) for x in out]
            same = [pa.array(np.full(len(key), v), t) for v, t in ((part, pa.int32()), (False, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), *same], schema=_arrow(batch.schema, columns))
        if first is not None:
            ends = [(first, of_first)] + ([(last, total)] if last != first else [])
            blank = [pa.nulls(len(ends), f.type) for f in batch.schema]
            blank[names.index(group)] = pa.array([g for g, _ in ends], pa.int64())
            values = [pa.array([v[i] for _, v in ends], pa.int64()) for i in range(len(columns))]
            same = [pa.array([part] * len(ends), pa.int32()), pa.array([True] * len(ends))]
            yield pa.RecordBatch.from_arrays([*blank, *values, *same], schema=_arrow(batch.schema, columns))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    fields += [f"run_{c} bigint" for c, _ in columns] + ["part int", "is_end boolean"]
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    written = saved(ordered.mapInArrow(run, ", ".join(fields)), "running")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.bit_xor if is_xor else F.sum)(f"run_{c}").over(before).alias(f"carry_{c}") for c, is_xor in columns]
    # At most two rows for each task that wrote.
    carry = written.where("is_end").select("part", group, *carried).where(f"carry_{columns[0][0]} IS NOT NULL")
    rows = written.where("NOT is_end").join(F.broadcast(carry), ["part", group], "left")
    zero = F.lit(0).cast("bigint")
    plus = [
        (F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"carry_{c}", zero)) if is_xor else F.col(f"run_{c}") + F.coalesce(f"carry_{c}", zero)).alias(f"run_{c}")
        for c, is_xor in columns
    ]
    return rows.select(*names, *plus)


def _arrow(schema: pa.Schema, columns) -> pa.Schema:
    more = [pa.field(f"run_{c}", pa.int64()) for c, _ in columns] + [pa.field("part", pa.int32()), pa.field("is_end", pa.bool_())]
    return pa.schema([pa.field(f.name, f.type) for f in schema] + more)
