"""Incremental re-runs: a ledger of what each part was made from, so that only parts whose input or configuration changed are made again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.sources.text import staged

LEDGER = "part string, fingerprint string, rows long, run long"


def fingerprints(inputs: DataFrame, part: str, config: dict) -> DataFrame:
    """part, rows, fingerprint: changes with any value of any row, with a row more or less, and with the configuration; not with the order of rows.

    Hashes of rows are added up, so this is one aggregation that combines before it shuffles. Columns go by name.
    """
    settings = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    columns = sorted(inputs.columns)
    nulls = F.concat_ws("", *(F.col(c).isNull().cast("int").cast("string") for c in columns))  # a hash skips nulls
    h, g = F.xxhash64(*columns, nulls), F.xxhash64(nulls, *reversed(columns))
    sums = inputs.groupBy(F.col(part).cast("string").alias("part")).agg(F.count("*").alias("rows"), *(F.sum(x.cast("decimal(38,0)")).cast("string").alias(n) for x, n in ((h, "__h"), (g, "__g"))))
    return sums.select("part", "rows", F.sha2(F.concat_ws(":", F.lit(settings), F.lit(",".join(columns)), F.col("rows").cast("string"), "__h", "__g"), 256).alias("fingerprint"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: a row for each part and run that made it; a null fingerprint says that the part's input was gone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger") if there else spark.createDataFrame([], LEDGER)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """part, fingerprint of what holds now; a row a part."""
    by = Window.partitionBy("part").orderBy(F.desc("run"))
    return entries(spark, folder).withColumn("k", F.row_number().over(by)).where("k = 1 AND fingerprint IS NOT NULL").select("part", "fingerprint")


def run(inputs: DataFrame, part: str, job: Callable[[DataFrame], DataFrame], config: dict, folder: str) -> list[str]:
    """Makes the parts whose fingerprint isn't the ledger's, and says which. job keeps the column part and works on each part by itself.

    Results lie in folders by part and fingerprint; the ledger's row is written after them. A run that fails in between
    leaves results that nothing points to, and the next run writes over them. A part without input rows is taken out.
    Parts are months or days: their number is bounded by the calendar, so they fit into a broadcast; a null part has none.
    """
    spark = inputs.sparkSession
    now = staged(fingerprints(inputs.where(F.col(part).isNotNull()), part, config), "fingerprints")
    have = latest(spark, folder)
    number = (entries(spark, folder).agg(F.max("run")).first()[0] or 0) + 1
    todo = now.join(F.broadcast(have), ["part", "fingerprint"], "left_anti")
    gone = have.join(F.broadcast(now), "part", "left_anti").select("part", F.lit(None).cast("string").alias("fingerprint"), F.lit(0).cast("long").alias("rows"))
    changes = staged(todo.select("part", "fingerprint", "rows").unionByName(gone), "changes")
    made = sorted(r.part for r in changes.where("fingerprint IS NOT NULL").select("part").collect())
    if made:
        few = F.broadcast(changes.where("fingerprint IS NOT NULL").select(F.col("part").alias("__part"), F.col("fingerprint").alias("__fingerprint")))
        mine = lambda df: df[part].cast("string") == F.col("__part")
        some = inputs.join(few, mine(inputs), "left_semi")
        out = job(some)
        marked = out.join(few, mine(out)).withColumnsRenamed({"__part": "part_key", "__fingerprint": "part_fingerprint"})
        marked.repartition("part_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_key", "part_fingerprint").parquet(f"{folder}/data")
    if not changes.isEmpty():
        changes.withColumn("run", F.lit(number).cast("long")).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")  # a row a part
    return made


def results(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger's latest rows point to."""
    data = spark.read.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/data").withColumn("part_key", F.col("part_key").cast("string"))
    have = latest(spark, folder).select(F.col("part").alias("part_key"), F.col("fingerprint").alias("part_fingerprint"))
    return data.join(F.broadcast(have), ["part_key", "part_fingerprint"], "left_semi").drop("part_key", "part_fingerprint")
