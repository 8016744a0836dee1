"""Helpers the corpus operators share: located rows, tables in the shared folder, words."""

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these characters.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

FILE, ROW = "__file", "__row"
AT = [FILE, ROW]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder is set for the session; only a local master may rely on
    that, a cluster has to name the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a cut that outlives executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def drop_tables(*tables: DataFrame):
    """Remove tables that keep_table wrote and nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.kept_path)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession):
    """Let go of what no frame refers to any more: Spark's cleaner removes shuffle files and broadcasts
    only once the driver has collected its garbage, which a driver with a large heap seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with two long columns that name each row: its file (hashed path) and place in it.

    They are the same whenever the table is read again, also for rows without a usable id. Rows
    that do not come straight from Parquet files are written to the shared folder first; rows that
    are located already stay as they are.
    """
    if FILE in docs.columns:
        return docs

    def place(df):
        return df.withColumns({FILE: F.xxhash64("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    try:
        rows = place(docs)
        rows.schema  # noqa: B018  resolves the names now
        return rows
    except AnalysisException:
        return place(keep_table(docs, "rows"))


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def join_small(rows: DataFrame, small: DataFrame, key: str, bound=100_000, salts=32, how="inner") -> DataFrame:
    """Join (inner or left) with a table of one row per ``key`` where a few keys hold most of ``rows``.

    The table is counted: up to ``bound`` rows it is broadcast, beyond that it is repeated once per
    salt and the rows of a key are dealt over the salts.
    """
    if small.count() <= bound:
        return rows.join(F.broadcast(small), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    many = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(many, [key, "__salt"], how).drop("__salt")
