"""What the operators share: words, blocks of rows inside a task, tables written between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: A word in Spark's and DuckDB's regular expressions. ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null document number inside a task; such a document comes before all others.
NULL_ID = -(2**63)

#: Bytes of text that a task turns into arrays at once.
BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a session without a cluster may do without the setting: its one machine gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="footfall-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage: later steps read the files, also after an executor is lost, and do not run
    the earlier steps again.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each; a longer text is a slice of its own."""
    start = size = 0
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], extra: T.StructField | None = None) -> DataFrame:
    """``mapInArrow`` that keeps all columns, whatever their names, and may add one at the end.

    ``run`` gets the columns as c0, c1, ...; the one named text is called ``text``.
    """
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    fields = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)]
    fields += [T.StructField("extra", extra.dataType)] if extra else []
    out = docs.toDF(*names).mapInArrow(run, T.StructType(fields))
    return out.toDF(*docs.columns, *([extra.name] if extra else []))
