"""What the training-data operators share: tables, scratch space, small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null doc_id where ids are compared or joined.
NO_ID = -(1 << 63)

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text without nulls (null: empty); other columns only if named."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """texts() with a doc_id that can be joined on: a null becomes NO_ID; unkeyed() turns it back."""
    return texts(docs, *more).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def unkeyed(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def free(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    context = spark.sparkContext
    if context.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        root = f"{base.rstrip('/')}/aerolith-{context.applicationId}"
        _roots[context.applicationId] = root
        atexit.register(_drop, spark, root)
    return _roots[context.applicationId]


def _drop(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a few numbers that are worth a task; tasks that even the smallest table may have.
ROWS, TASKS = 50_000, 12


def gathered(df: DataFrame, rows: int, each: int = ROWS) -> DataFrame:
    """df, of rows rows at most, in no more partitions than these are worth, whatever the number of shuffle partitions; the number grows with rows and none is shuffled."""
    return df.coalesce(max(TASKS, -(-rows // each)))


def staged(df: DataFrame, name: str, rows: int | None = None, each: int = ROWS) -> DataFrame:
    """df written to the shared scratch folder and read again: cuts lineage, survives lost executors. rows: how many there are at most, if that is known."""
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = gathered(df, rows, each)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(batch, column: int, limit: int):
    """Slices of an Arrow batch of at most limit bytes in the column, or of one row."""
    sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)]
    at = 0
    while at < len(sizes):
        n, size = 1, sizes[at]
        while at + n < len(sizes) and size + sizes[at + n] <= limit:
            size += sizes[at + n]
            n += 1
        yield batch.slice(at, n)
        at += n


def least_count(words: DataFrame, most: int) -> int:
    """The smallest c of words for which at most so many rows have as much or more, to a sixteenth of a power of two."""
    cell = F.floor(16 * F.log2(F.col("c").cast("double")))
    cells = sorted(((r.low, r.n) for r in words.groupBy(cell).agg(F.min("c").alias("low"), F.count("*").alias("n")).collect()), reverse=True)
    least, n = (cells[0][0] + 1 if cells else 1), 0
    for low, more in cells:
        n += more
        if n > most:
            break
        least = low
    return least


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and z: the text as zstd bytes, for shuffles that carry whole texts; other columns only if named."""
    import pyarrow as pa
    from pyspark.sql import types as T

    rows = docs.select("doc_id", "text", *more)
    schema = T.StructType([rows.schema[0], T.StructField("z", T.BinaryType()), *rows.schema[2:]])

    def run(batches):
        import zstandard

        code = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([code.compress(t.as_buffer() or b"") for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, *batch.columns[2:]], schema.names)

    return rows.mapInArrow(run, schema)
