"""Row plumbing shared by the text operators: Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text handed to a kernel at once; a single longer text still goes through whole.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between an executor and its Python workers; each side holds one or two for every running task.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lets the session send texts to Python in batches of BATCH_BYTES, where it would send larger ones.

    By default a batch is bounded by rows, and ten thousand long texts are more than a task should hold at a time.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def lean(run: Callable) -> Callable:
    """The same function over batches, which gives a task's freed memory back to the system when the task ends.

    Python workers outlive their tasks; what an allocator keeps for later would add up beside the next tasks' memory.
    """

    def wrapped(batches):
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield start, stop
        start = stop


def with_id(id_field: T.StructField, ddl: str) -> T.StructType:
    """A schema that begins with the id as it came."""
    return T.StructType([id_field, *T.StructType.fromDDL(ddl).fields])


def map_texts(
    df: DataFrame,
    kernel: Callable[[], Callable[[list], dict[str, list]]],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One output row per input row: the id as it came, then what the kernel derives from the text.

    ``kernel()`` runs once per task and returns a function from a list of texts (None for null) to named
    columns.  Ids may be null or repeated: they pass through Arrow untouched.  Other input columns are not read.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    schema = with_id(rows.schema["doc_id"], fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = kernel()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts):
                made = work(texts.slice(start, stop - start).to_pylist())
                cols = [ids.slice(start, stop - start).cast(arrow.field(0).type)]
                cols += [pa.array(made[f.name], type=f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return rows.mapInArrow(run, schema)
