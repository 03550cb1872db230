"""What the corpus operators share: reading tables, the folder all machines see, row counts of batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory when texts are very long.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if all runs in this process
    (as in tests), else an error: executors elsewhere couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of `written` that nobody has released.
_WRITTEN: list[str] = []


def written_so_far() -> int:
    return len(_WRITTEN)


def release(spark: SparkSession, keep: DataFrame, since: int) -> None:
    """Deletes the tables of `written` since there were so many, but those that keep reads: for who has written what it
    needs of them."""
    read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()}
    for path in [p for p in _WRITTEN[since:] if p.split(":", 1)[-1].lstrip("/") not in read]:
        _WRITTEN.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    """By Hadoop's file system, as the folder may be in any store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


class Scratch:
    """Tables of one run that nothing needs once its result is written: `clear` deletes them from the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:03}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        _delete(self.spark, self.folder)


_SHIPPED: set[str] = set()


def python_ready(spark: SparkSession) -> None:
    """Before Python runs on executors: bounded Arrow batches, and this package's code for those that lack it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp()) / "sluice_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(target))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def leading(array: Column, most: int, holds: Callable[[Column], Column]) -> Column:
    """How many of the first elements of a sorted array (of `most` at most) hold, by binary search."""
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def halved(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["low"] + at["high"], 1)
        here = (mid < at["high"]) & F.coalesce(holds(F.get(array, mid)), F.lit(False))
        return span(F.when(here, mid + 1).otherwise(at["low"]), F.when(here, at["high"]).otherwise(mid))

    return F.aggregate(F.array_repeat(F.lit(0), F.lit(max(1, most.bit_length()))), span(F.lit(0), F.size(array)), halved, lambda at: at["low"])


def text_of(column: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, values: list[Column], by_label: bool = False) -> DataFrame:
    """doc_id, label and values (computed from docs) of at most `rows` labelled documents, spread by a hash of doc_id;
    by_label: half of label 0, half of 1.

    Only ids and labels are sorted and broadcast, at most `rows` of them. Of documents of one doc_id the one of
    the least values counts, so rows of docs that repeat an id don't make the sample larger; what is shuffled
    are the values of sampled rows.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if by_label:
        sample = known.where("label = 0").orderBy(*order).limit(rows // 2).unionByName(known.where("label = 1").orderBy(*order).limit(rows // 2))
    else:
        sample = known.orderBy(*order).limit(rows)
    met = docs.select("doc_id", F.struct(*values).alias("_values")).join(F.broadcast(sample), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("_values").alias("_values")).select("doc_id", "label", "_values.*")
