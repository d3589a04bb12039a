"""Helpers shared by the corpus operators: table access, word rules, shared checkpoints, Arrow batches."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and U+0009 to U+000D.  bytes.split() uses the same six bytes.
SPACES = r"[ \t\n\x0B\f\r]+"
#: Characters of a word: everything else.
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it many times in ``body``, also inside lambdas of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def barrier(value: Column) -> Column:
    """``value``, behind which the optimizer moves no later filter.

    A filter on a computed column is otherwise pushed below the projection, which evaluates a long
    expression a second time.  The condition always holds.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured, as in local tests."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into consecutive slices of about ``most`` text bytes, so that workers hold little at once.

    A single longer text makes a slice of its own: texts are never cut.
    """
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8; null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def appended(df: DataFrame, text: str, fields: str, make: Callable[[pa.RecordBatch, list[bytes]], list[list]], most: int = 4_000_000) -> DataFrame:
    """``df`` with columns computed in Python from bounded slices of its rows.

    ``make`` gets a slice and its texts as UTF-8 and returns a list for each of ``fields`` (a DDL string).  Columns
    of ``df`` that have the name of a new one are replaced.  No shuffle: rows stay where they are.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    names = [f.name for f in new]
    kept = [c for c in df.columns if c not in names]
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            made = make(batch, column_bytes(batch, text))
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(x, t) for x, (_, t) in zip(made, arrow, strict=True))], [*kept, *names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in kept), *new]))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compressed, and safe from the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Key and rows of each group, from rows sorted by ``keys``; one batch is held at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, key=lambda row: tuple(row[k] for k in keys))


def bucket_count(size: int) -> int:
    """Buckets for a table of so many bytes: 8 to 128 MB each, and no more buckets than Spark takes."""
    return max(1, min(100_000, -(-size // min(128_000_000, max(8_000_000, size // 500)))))


#: Tables that :func:`bucketed` made and nothing has dropped: path by name.
_TABLES: dict[str, str] = {}


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: joins by it do not shuffle the table again."""
    spark = df.sparkSession
    name = f"docloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _TABLES[name] = path
    table = spark.table(name)
    table.docloom_table = name
    return table


def named_like(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, a selection of ``table``, which :func:`dropped` drops as a whole."""
    df.docloom_table = table.docloom_table
    return df


def dropped(table: DataFrame) -> None:
    """Drop a table of :func:`bucketed` with its files, once no later step reads it."""
    _drop(table.sparkSession, table.docloom_table)


def _drop(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop(name))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> int:
    """Drop all tables that the operators of this process still hold; results that were not written yet are lost.  Returns their number."""
    names = list(_TABLES)
    for name in names:
        _drop(spark, name)
    return len(names)
