"""Vectors of counts, put together in tasks."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a packed vector that one task puts together.
PACK = 1 << 16


def packed_bytes(cells: DataFrame, cell: str, value: str, size: int, kind: str = "u1") -> bytearray:
    """A vector of `size` values on the driver from rows of cells, absent ones 0; a cell stands in one row.

    Tasks put PACK cells each together, so what reaches the driver are the bytes of the vector and no row for each cell.
    """
    dtype = np.dtype(kind)

    def pack(group: pa.Table) -> pa.Table:
        at = group.column("_cell").to_numpy()
        part = np.zeros(PACK, dtype)
        part[at % PACK] = group.column("_value").to_numpy()
        return pa.table({"_part": pa.array([int(at[0]) // PACK], pa.int32()), "_bytes": pa.array([part.tobytes()], pa.binary())})

    rows = cells.select(F.col(cell).cast("int").alias("_cell"), F.col(value).alias("_value"), F.expr(f"cast({cell} div {PACK} as int)").alias("_part"))
    out = bytearray(size * dtype.itemsize)
    for r in rows.groupBy("_part").applyInArrow(pack, "_part int, _bytes binary").collect():
        start = r._part * PACK * dtype.itemsize
        out[start : start + PACK * dtype.itemsize] = r._bytes[: len(out) - start]
    return out
