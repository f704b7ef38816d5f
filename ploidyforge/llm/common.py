"""Helpers shared by the training-data operators: staging tables, raw file sinks, Arrow mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: ASCII white space, and words as runs of anything else.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch in the queries of this subpackage; Spark's default is 64 MB a task and direction.
BATCH_BYTES = "4m"

_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a
    temporary one, the same for the whole application; any other master is an error, as no folder is known to be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="forge-")
            atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
        folder = f"file://{_OWN_FOLDERS[app]}"
    return folder.rstrip("/")


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches for the queries of this subpackage, which are applications of their own, unless the session
    says otherwise. Operators leave the session as it is."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64MB", "67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/forge/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; frames that still read it can't be used any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and reread it: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, whose batches Spark bounds by rows and bytes; fn gets them cut further, to SLICE_BYTES or one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(piece for batch in batches for piece in slices(batch))

    return df.mapInArrow(run, schema)


#: Bytes of the slices in which Python reads an Arrow batch.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = max(1, -(-batch.nbytes // SLICE_BYTES))
    step = max(1, -(-batch.num_rows // n))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


#: Bytes of the batches that are worked on at once where many texts share their words.
CHUNK_BYTES = 8 << 20


def gathered(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined up to most bytes, so that a word is worked on once for many texts."""
    waiting, n = [], 0
    for batch in batches:
        if waiting and n + batch.nbytes > most:
            yield as_one(waiting)
            waiting, n = [], 0
        waiting.append(batch)
        n += batch.nbytes
    if waiting:
        yield as_one(waiting)


def as_one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches)
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in whole.columns], names=whole.column_names)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def write_blobs(df: DataFrame, column: str, path: str, terminator: bytes) -> None:
    """Write each value of a binary column to a file of its own, byte for byte, followed by terminator.

    Spark's text writer is used as a raw byte sink, so that its commit protocol covers retries and lost
    executors on any Hadoop file system. File names keep the order of partitions and of rows in them.
    """
    (df.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
       .option("encoding", "ISO-8859-1").option("lineSep", terminator.decode("latin-1")).text(path))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files written by write_blobs: file (name in the folder), length, content; empty files carry no blob."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content"))


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes [offset, offset + length) of one file of any Hadoop file system, read by the driver."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def crc32_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def sql_words(text: str) -> str:
    """DuckDB list of the words of a text."""
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def lowered(text: str) -> bytes:
    """UTF-8 of the text with A-Z in lower case and all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")



def quoted(columns: list[str], of: str = "") -> list:
    """Columns by their exact names, which may hold dots or backticks."""
    return [F.col((of + "." if of else "") + "`" + c.replace("`", "``") + "`") for c in columns]


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it new among columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
