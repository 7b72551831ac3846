"""Names that a ledger's producer chooses, and where long jobs may cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

GENESIS = "0" * 64
MAX_OBJECT_BYTES = 64 * 1024 * 1024
FORMAT_VERSION = 1
FACT_CATALOG = ("RF-01", "RF-02", "RF-03", "RF-04", "RF-05", "RF-06", "RF-07")


@dataclass(frozen=True)
class Producer:
    """The recorder that wrote a ledger.

    Its name appears in format markers, in its private directory and in report
    texts, so a ledger from another recorder is read with ``Producer("its-name")``.
    """

    name: str = "ledgerlens"
    version: str = "1.0.0"

    @property
    def label(self) -> str:
        return self.name.upper()

    @property
    def record_format(self) -> str:
        return f"{self.name}-evidence-record"

    @property
    def link_format(self) -> str:
        return f"{self.name}-link"

    @property
    def interference_key(self) -> str:
        return f"{self.name}Interference"

    @property
    def footprint(self) -> str:
        return f".{self.name}"


DEFAULT_PRODUCER = Producer()


def checkpoint_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the cluster's shared one.

    A local session without ``spark.checkpoint.dir`` gets a folder that ends with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _own_folder()
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ledgerlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def drop_run(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written.

    Iterative jobs call this between rounds: the plan stays short, the rows are
    computed once, and a lost executor re-reads files instead of replaying rounds.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: How tables of long texts are written: in row groups of a few rows and MB.  Spark's reader decodes up to
#: 4096 rows of a row group at once, so whole documents must not share larger ones.
LONG_TEXTS = {
    "parquet.block.size": 8 * 1024 * 1024, "parquet.block.row.count.limit": 128,
    "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16,
}


def settle_texts(df: DataFrame, label: str) -> DataFrame:
    """:func:`settle` for rows that hold whole documents: a task reads few of them at once."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**LONG_TEXTS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
