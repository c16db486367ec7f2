"""Plain Python functions as columns, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def by_row(kind: T.DataType, f: Callable) -> Callable[..., Column]:
    """The column function ``g(go, *columns)`` of a function of one row's values; a struct is returned as a tuple.

    Rows where ``go`` is not true are null and never reach ``f``; a batch without any other costs nothing.
    The function takes a batch, not an iterator of them: Spark gives each of the latter Python workers of its own,
    while all of the former that stand side by side in a query share one worker a task.
    """
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(go: pa.Array, *columns: pa.Array) -> pa.Array:
        at = pc.indices_nonzero(go)
        if not len(at):
            return pa.nulls(len(go), arrow)
        rows = zip(*(c.take(at).to_pylist() for c in columns))
        done = pa.array([f(*row) for row in rows], arrow)
        if len(at) < len(go):
            place = np.full(len(go), -1)
            place[at.to_numpy()] = np.arange(len(at))
            done = done.take(pa.array(place, mask=place < 0))
        return done

    return run
