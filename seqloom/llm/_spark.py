"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a Parquet table in the shared folder and read it again.

    The table outlives any executor. It is computed once, and later readers
    prune its columns. Delete the folder when the job is over.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though a lambda in body reads it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A key is heavy if it has more than one in so many of the rows.
HEAVY = 10_000
#: Copies of one row that one task makes at a time.
COPIES = 4096


def attach(rows: DataFrame, keyed: DataFrame, key: str | list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined by key (a column or some, not null) with keyed, which has one row a key and says in column n how many of the total rows have it.

    Heavy keys are joined by a broadcast: there are at most HEAVY of them,
    whatever the data. So a task of the shuffled rest holds no key with more
    than one in HEAVY of the rows.
    """
    limit = max(1, total // HEAVY)
    heavy, rest = F.broadcast(keyed.filter(F.col(n) > limit)), keyed.filter(F.col(n) <= limit)
    names = [key] if isinstance(key, str) else key
    return rows.join(heavy, names).unionByName(rows.join(heavy.select(*names), names, "left_anti").join(rest, names))


def copies(counted: DataFrame, n: str = "n") -> DataFrame:
    """A row for each copy 0 .. n - 1 of each row of counted, in column copy (n goes). Rows of very many copies are dealt to tasks in spans."""
    spans = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES)), lambda k: F.struct((k * COPIES).alias("a"), F.least((k + 1) * COPIES, F.col(n)).alias("b")))
    few = counted.filter(F.col(n) <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = counted.filter(F.col(n) > COPIES).withColumn("_span", F.explode(spans)).repartition("_span")
    many = many.withColumn("copy", F.explode(F.sequence("_span.a", F.col("_span.b") - 1))).drop("_span")
    return few.unionByName(many).drop(n)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if a count proves it has at most so many rows, else df as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
