"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
#: The same as the inside of a regular expression's class.
SPACE_CLASS = r" \t-\r"


def python_ready(spark: SparkSession) -> None:
    """Let Python workers find this package also when only the driver's sys.path has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or of a local session a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="llm-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed_at(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def landed(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows written once to the shared folder (in folders by some columns) and read back: a cut of the lineage that outlives executors."""
    return landed_at(df, fresh_path(df.sparkSession, name), by)


class Landing:
    """Lands tables as ``landed`` does, and takes away those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        path = fresh_path(self.spark, name)
        table = landed_at(df, path, by)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of these tables; without any, of all."""
        gone = [(t, path) for t, path in self.tables if not tables or any(t is x for x in tables)]
        self.tables = [x for x in self.tables if not any(x[0] is t for t, _ in gone)]
        for _, name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value, body):
    """body(value) with value computed once per row, not once per use inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
