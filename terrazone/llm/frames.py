"""Arrow-batched maps over a table with a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from terrazone.llm import kernels, store

#: For a slice of documents, their bytes and offsets: a value for each document and result column.
Kernel = Callable[[np.ndarray, np.ndarray], dict[str, object]]


def enrich(docs: DataFrame, setup: Callable[[], Kernel], fields: str, text: str = "text", keep: list[str] | None = None, most: int = kernels.SLICE_BYTES) -> DataFrame:
    """Adds to the kept columns what a kernel says of each text, in one pass without a shuffle.

    setup runs once in each Python worker. Null texts reach the kernel as empty. A kept column that has the
    name of a result column gives way to it.
    """
    store.tune(docs.sparkSession)
    added = _parse_datatype_string(fields)
    names = [x.name for x in added]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    schema = StructType([*inner.schema.fields[:-1], *added.fields])
    arrow = to_arrow_schema(schema)
    types = [arrow.field(x).type for x in names]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = setup()
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = kernels.flat(batch.column(width))
            for lo, hi in kernels.slices(off, most):
                made = kernel(data, off[lo : hi + 1])
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(width)]
                columns += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], type=kind) for n, kind in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*keep, *names)
