"""Digests of a store's prefixes, so that two stores are compared without reading what they share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.settings import settle

#: Hexadecimal digits of an object id in one number, and numbers in one digest.
DIGITS, LIMBS = 15, 4
#: Digits that name a node of each level; the first is how stores are partitioned.
PREFIX, NODE = 2, 4
DIGESTS = "prefix string, files string, digest string"


def node_digests(ids: DataFrame, digits: int) -> DataFrame:
    """``node, digest`` of the distinct ``object_id`` below each node: their number and the sums of their parts.

    Ids are SHA-256 values, so different sets have one digest with a chance of about 2^-240.
    """
    limbs = [F.conv(F.substring("object_id", 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(20,0)") for k in range(LIMBS)]
    sums = [F.sum(limb).cast("string") for limb in limbs]
    return ids.select("object_id").distinct().groupBy(F.substring("object_id", 1, digits).alias("node")).agg(
        F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums).alias("digest")
    )


def file_marks(spark: SparkSession, path: str) -> DataFrame:
    """``prefix, files``: a mark of the names and lengths of each prefix's files, from the listing alone.

    Files of a store are written once and never changed, so an equal mark is equal content.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "prefix string, files string")
    named = files.select(
        F.regexp_extract("path", r"/prefix=([0-9a-f]{2})/[^/]*\z", 1).alias("prefix"),
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "length",
    )
    sums = [F.sum(F.xxhash64("name", "length", F.lit(seed)).cast("decimal(20,0)")).cast("string") for seed in (1, 2)]
    return named.groupBy("prefix").agg(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums).alias("files"))


def prefix_digests(store, kind: str) -> DataFrame:
    """``prefix, digest`` of a store's objects, at most 256 rows.

    Digests are kept beside the objects with the mark of the files they were taken from;
    only prefixes whose files changed since are read, and of those the ids alone.
    """
    spark, path = store.spark, f"{store.root}/digests/{kind}s"
    now = settle(file_marks(spark, f"{store.root}/{kind}s"), "store-files")
    try:
        kept = spark.read.schema(DIGESTS).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        kept = spark.createDataFrame([], DIGESTS)
    kept = kept.groupBy("prefix", "files").agg(F.max("digest").alias("digest"))
    known = settle(now.join(kept, ["prefix", "files"], "left"), "store-digests")
    changed = [r.prefix for r in known.where("digest IS NULL").collect()]
    held = known.where("digest IS NOT NULL").select("prefix", "digest")
    if not changed:
        return held
    ids = store.objects(kind).where(F.col("prefix").isin(changed))
    taken = node_digests(ids, PREFIX).withColumnRenamed("node", "prefix")
    taken = settle(now.join(taken, "prefix").select("prefix", "files", "digest"), "store-taken")
    taken.coalesce(1).write.mode("append").parquet(path)  # at most 256 rows
    return held.unionByName(taken.select("prefix", "digest"))


def unequal(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    """The ``name`` of every digest that is not the same in both."""
    other = two.select(name, F.col("digest").alias("other"))
    return one.join(other, name, "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select(name)


def missing_ids(here, there, kind: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Prefixes in which two stores differ, and the ids that are missing here and missing there.

    Digests of prefixes are compared first, then those of the nodes below the unequal ones;
    ids meet only below unequal nodes.
    """
    prefixes = [r.prefix for r in unequal(prefix_digests(here, kind), prefix_digests(there, kind), "prefix").collect()]
    if not prefixes:
        none = here.spark.createDataFrame([], "object_id string")
        return prefixes, none, none
    ids = [s.objects(kind).where(F.col("prefix").isin(prefixes)).select("object_id").distinct() for s in (here, there)]
    nodes = settle(unequal(node_digests(ids[0], NODE), node_digests(ids[1], NODE), "node"), "store-nodes")
    own, other = (
        i.withColumn("node", F.substring("object_id", 1, NODE)).join(nodes, "node", "left_semi").select("object_id") for i in ids
    )
    return prefixes, settle(other.join(own, "object_id", "left_anti"), "pull-ids"), settle(own.join(other, "object_id", "left_anti"), "push-ids")
