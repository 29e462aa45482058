"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side up to which it is broadcast; beyond it the join is dealt out by key.
BROADCAST_ROWS = 1_000_000
#: Documents in one Arrow batch, so that a batch of long texts stays small.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def checked_broadcast(small: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most limit rows, else as it is: the join is then dealt out by key."""
    return F.broadcast(small) if rows <= limit else small


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left join right on key where right has each key once, with n, its rows in left (total in all).

    A key with more than a thousandth of the rows is hot. There are fewer than a thousand of them: their rows
    of right are broadcast and those of left stay where they are. All others are dealt out by key.
    """
    hot = right.where(F.col("n") > max(1000, total // 1000)).collect()
    if not hot:
        return left.join(right, key)
    table = F.broadcast(left.sparkSession.createDataFrame(hot, right.schema))
    return left.join(table, key).unionByName(left.join(table.select(key), key, "left_anti").join(right, key))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column, row, with more columns: names inside can't clash with those of docs. select("row.*") undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id, or where it is null a hash of the text above 2 ** 62, so that such a row comes after all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftrightunsigned(F.xxhash64(F.lit("no id"), F.col(text)), 2) + F.lit(1 << 62))
