"""Very many files, read folder by folder, so that the driver holds few of their names at once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.settings import LONG_TEXTS, checkpoint_root

#: Files whose names the driver holds at once, where folders allow it, and entries of a folder that are looked at one by one.
FILES_AT_ONCE = 40_000
ENTRIES = 10_000
#: For the reading session alone: small files share tasks, tasks list folders, and no listing is kept.
READING = {
    "spark.sql.files.openCostInBytes": "65536", "spark.sql.sources.parallelPartitionDiscovery.threshold": "1",
    "spark.sql.hive.manageFilesourcePartitions": "false",
}


def files_below(spark: SparkSession, *paths: str) -> DataFrame:
    """Every file below ``paths``; tables made of the same frame share its listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


def _children(spark: SparkSession, path: str) -> tuple[list[str], list[str]] | None:
    """Folders and files in ``path`` as Spark would list them; None where it is no folder or holds too many."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    found = fs.listStatus(at)
    if len(found) > ENTRIES:
        return None
    folders, files = [], []
    for entry in found:
        name = entry.getPath().getName()
        if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
            continue
        (folders if entry.isDirectory() else files).append(re.sub(r"([{}\[\]*?\\])", r"\\\1", entry.getPath().toString()))
    return folders, files


def read_in_turns(
    spark: SparkSession, path: str, rows_of: Callable[[DataFrame], DataFrame], label: str, texts: bool = False,
) -> DataFrame:
    """``rows_of(files)`` for the files below ``path``, some folders at a time, written down and read back as one table.

    ``rows_of`` sees each file once and must not need the others; ``texts`` says that its rows are long.  Folders directly below ``path`` are
    taken together as long as they hold about ``FILES_AT_ONCE`` files; one folder is not taken apart.
    """
    reader = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        reader.conf.set(name, spark.conf.get(name))
    for name, value in READING.items():
        reader.conf.set(name, value)
    out = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    kept = []

    def turn(*paths: str) -> int:
        files = files_below(reader, *paths)
        rows = rows_of(files)
        rows.write.mode("append").options(**(LONG_TEXTS if texts else {})).parquet(out)
        kept[:] = [rows.schema]
        return len(files._jdf.inputFiles())

    children = _children(spark, path)
    if children is None or not any(children):
        turn(path)
    else:
        todo, loose = children
        if loose:
            turn(*loose)
        take = 1
        while todo:
            now, todo = todo[:take], todo[take:]
            each = max(1, turn(*now) / len(now))
            take = max(1, min(4 * take, int(FILES_AT_ONCE / each)))
    return spark.read.schema(kept[0]).parquet(out)
