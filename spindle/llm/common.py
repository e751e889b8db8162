"""What the operators share: tables in the folder that the cluster shares, and text columns."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression for Java, Python and DuckDB.
WHITE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset (tests on one machine), a new one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spindle-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: What this process has written to the shared folder and not deleted yet.
_made: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the process ends; results that read it don't outlive that."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _made.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def forget() -> None:
    """Delete everything that is left."""
    for path in list(_made):
        with contextlib.suppress(Exception):
            _delete(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` wrote and nothing will read again."""
    for df in tables:
        _delete(df.written_to)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
