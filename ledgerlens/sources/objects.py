"""Object files and the content-addressed store of records and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.canon import canonical_json
from ledgerlens.operators.links import check_links, dangling_links
from ledgerlens.operators.record import build_records, check_read, check_records, read_objects
from ledgerlens.settings import DEFAULT_PRODUCER, LONG_TEXTS, Producer, settle, settle_texts
from ledgerlens.sources.digests import missing_ids, prefix_digests
from ledgerlens.sources.files import read_in_turns

RESULT = "source string, kind string, object_id string, status string, errors array<string>"
#: Rows of one stored file; longer appends write more files.
FILE_ROWS = 100_000
OBJECT_NAME = r"/([0-9a-f]{2})/([0-9a-f]{64})\.(record|link)\.json\z"


def embedded_record(html: Column, producer: Producer = DEFAULT_PRODUCER) -> Column:
    """The record that an exported page carries, or null."""
    pattern = (
        f'<script type="application/json" id="{producer.record_format}">([\\s\\S]*?)</script>'
    )
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def read_object_files(
    spark: SparkSession, path: str, producer: Producer = DEFAULT_PRODUCER,
    max_bytes: int | None = None,
) -> DataFrame:
    """``source, doc, errors`` for every file below ``path``.

    Where ``max_bytes`` is given it is tested on the file listing, so an oversized file is
    refused without being read.  A file whose bytes are not UTF-8 is refused, too; all others
    are still read.  Files of no bytes are not listed.  Folders are read in turns.
    """
    return read_in_turns(spark, path, lambda files: _objects_of(files, producer, max_bytes), "object-files", texts=True)


def _objects_of(files: DataFrame, producer: Producer, max_bytes: int | None) -> DataFrame:
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    too_big = files.where(~fits).select(
        F.col("path").alias("source"), F.lit(None).cast("string").alias("doc"),
        F.array(F.concat(
            F.lit("file is "), F.col("length").cast("string"),
            F.lit(f" bytes; the ingestion bound is {max_bytes}"),
        )).alias("errors"),
    )
    held = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(held), F.regexp_replace(F.make_valid_utf8(held), "^\ufeff", ""))
    is_html = F.col("source").rlike(r"(?i)\.html?\z") | F.col("text").rlike(r"^\s*<")
    embedded = embedded_record(F.col("text"), producer)
    read = files.where(fits).select(
        F.col("path").alias("source"), text.alias("text")
    ).select(
        "source",
        F.when(is_html, embedded).otherwise(F.col("text")).alias("doc"),
        F.when(F.col("text").isNull(), F.array(F.lit("cannot read: the file is not valid UTF-8")))
        .when(
            is_html & embedded.isNull(),
            F.array(F.lit("this HTML file carries no embedded evidence record")),
        ).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    return read.unionByName(too_big)


def classify_paths(files: DataFrame) -> DataFrame:
    """``path`` to ``path_class``: object, temp or stray, with the id it is filed under."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    filed = F.regexp_extract("path", OBJECT_NAME, 2)
    return files.withColumns({
        "path_class": F.when(F.col("path").rlike(OBJECT_NAME), "object")
        .when(name.startswith(".tmp-"), "temp").otherwise("stray"),
        "kind": F.nullif(F.regexp_extract("path", OBJECT_NAME, 3), F.lit("")),
        "filed_id": F.nullif(filed, F.lit("")),
    })


def _misfiled(errors: Column) -> Column:
    wrong = F.when(
        (F.col("verdict") != "invalid") & (F.col("actual_id") != F.col("filed_id")),
        F.array(F.concat(
            F.lit("misfiled: content hashes to "), "actual_id", F.lit(", filed as "), "filed_id"
        )),
    )
    return F.concat(errors, F.coalesce(wrong, F.array().cast("array<string>")))


def verify_objects(
    records: DataFrame, links: DataFrame, producer: Producer = DEFAULT_PRODUCER, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Every object re-checked against the id it is filed under, and a summary row.

    Both inputs hold ``source, filed_id, doc``.
    """
    checked_records = settle(check_records(records, producer, exact).join(
        records.select("source", "filed_id"), "source"
    ), "checked-records")
    checked_links = check_links(links, producer, exact).join(links.select("source", "filed_id"), "source")
    report = lambda df, kind, id_: df.select(
        F.lit(kind).alias("kind"), "source", F.col(id_).alias("object_id"),
        (F.size(_misfiled(F.col("errors"))) == 0).alias("ok"), _misfiled(F.col("errors")).alias("errors"),
    )
    objects = report(checked_records, "record", "record_id").unionByName(
        report(checked_links, "link", "link_id")
    )
    present = lambda df, name: df.where(
        (F.col("verdict") != "invalid") & (F.col("actual_id") == F.col("filed_id"))
    ).select(F.col("filed_id").alias(name))
    readable = checked_links.where(F.col("verdict") != "invalid")
    dangling = dangling_links(
        readable, present(checked_records, "record_id"), present(checked_links, "link_id")
    )
    counts = objects.agg(
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("store_intact"),
        F.count_if(F.col("kind") == "record").alias("record_count"),
        F.count_if(F.col("kind") == "link").alias("link_count"),
    )
    degraded = checked_records.agg(
        F.count_if(F.col("ok") & (F.col("stated_status") == "DEGRADED")
                   & (F.col("actual_id") == F.col("filed_id"))).alias("degraded_records")
    )
    loose = dangling.agg(F.count(F.lit(1)).alias("dangling_links"))
    one = F.lit(1).alias("_k")
    summary = (
        counts.select("*", one).join(degraded.select("*", one), "_k")
        .join(loose.select("*", one), "_k").drop("_k")
    )
    return objects, summary


class ObjectStore:
    """A write-once store: one Parquet table per object kind, partitioned by id prefix."""

    def __init__(
        self, spark: SparkSession, root: str, producer: Producer = DEFAULT_PRODUCER, max_bytes: int | None = None,
    ):
        """Objects above ``max_bytes`` are refused where it is given."""
        self.spark, self.root, self.producer, self.max_bytes = spark, root.rstrip("/"), producer, max_bytes

    def objects(self, kind: str) -> DataFrame:
        """``object_id, doc, prefix`` of every stored object."""
        schema = "object_id string, doc string, prefix string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}s")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _add(self, kind: str, objects: DataFrame, exact: bool) -> DataFrame:
        """Check, refuse or store; the outcome is written down before the store changes.

        Objects are judged without their texts; only the texts of those that are added move.
        """
        is_record = kind == "record"
        if is_record:
            read = read_objects(objects, exact=exact)
            checked, texts = check_read(read, self.producer), read.texts(exact)
        else:
            checked = check_links(objects, self.producer, exact)
            texts = settle(objects.select(
                "source", F.monotonically_increasing_id().alias("row"), canonical_json(F.col("doc"), exact).alias("doc"),
            ), "link-texts")
        id_col = f"{kind}_id"
        errors = F.col("errors")
        if is_record:
            note = (
                "note: this record states its own session chain is broken. Sealed broken-session "
                "records are refused by design: they are indistinguishable from forgeries."
            )
            said_broken = (F.col("verdict") == "altered") & (F.col("stated_status") == "BROKEN")
            errors = F.when(said_broken, F.concat("errors", F.array(F.lit(note)))).otherwise(errors)
        size = F.col("size")
        bytes_ = F.lit(None).cast("int") if self.max_bytes is None else F.octet_length("doc")
        sized = checked.select("source", id_col, "ok", errors.alias("errors")).join(
            texts.select("source", "row", bytes_.alias("size")), "source"
        )
        stored = self.objects(kind).select(F.col("object_id").alias(id_col), F.lit(True).alias("stored"))
        # Refused objects have no id that counts: each is a group of its own.
        one = F.when(F.col("ok"), F.col(id_col)).otherwise(F.col("source"))
        first = F.row_number().over(Window.partitionBy(one, "ok").orderBy("source")) == 1
        too_big = F.lit(False) if self.max_bytes is None else F.coalesce(size > self.max_bytes, F.lit(False))
        judged = sized.join(stored, id_col, "left").withColumns({
            "first": F.when(F.col("ok"), first).otherwise(True), "too_big": too_big,
        })
        bound = F.array(F.concat(
            F.lit(f"{kind} is "), size.cast("string"),
            F.lit(f" bytes; the ingestion bound is {self.max_bytes}"),
        ))
        outcome = settle(judged.select(
            "source", F.lit(kind).alias("kind"), F.col(id_col).alias("object_id"),
            F.when(~F.col("ok") | F.col("too_big"), "refused")
            .when(F.coalesce("stored", F.lit(False)) | ~F.col("first"), "duplicate")
            .otherwise("added").alias("status"),
            F.when(F.col("ok") & F.col("too_big"), bound).otherwise(F.col("errors")).alias("errors"),
            "row",
        ), f"add-{kind}s")
        added = texts.select("row", "doc").join(outcome.where(F.col("status") == "added").select("row", "object_id"), "row").select(
            "object_id", "doc", F.substring("object_id", 1, 2).alias("prefix")
        )
        self._append(kind, added)
        return outcome.select("source", "kind", "object_id", "status", "errors")

    def _append(self, kind: str, rows: DataFrame) -> None:
        # As many writers as the shuffle has partitions, and files of bounded length.
        spread = F.pmod(F.xxhash64("object_id"), F.lit(self.writers_per_prefix()))
        placed = rows.repartition("prefix", spread).write.option("maxRecordsPerFile", FILE_ROWS)
        placed = placed.options(**LONG_TEXTS) if kind == "record" else placed
        placed.mode("append").partitionBy("prefix").parquet(f"{self.root}/{kind}s")

    def writers_per_prefix(self) -> int:
        """Ids have 256 prefixes; with more shuffle partitions than those, each prefix gets several writers."""
        return -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 256)

    def add_records(self, objects: DataFrame, exact: bool = True) -> DataFrame:
        """``source, doc`` rows to ``source, kind, object_id, status, errors``."""
        return self._add("record", objects, exact)

    def add_links(self, objects: DataFrame, exact: bool = True) -> DataFrame:
        """S9."""
        return self._add("link", objects, exact)

    def add_sessions(
        self, raw: DataFrame, sessions: DataFrame, include_open: bool = False, exact: bool = True
    ) -> DataFrame:
        """Seal the closed sessions of a ledger; open ones are skipped unless asked for."""
        wanted = sessions if include_open else sessions.where(F.col("ended_at").isNotNull())
        skipped = sessions.join(wanted.select("id"), "id", "left_anti").select(
            F.concat(F.lit("session #"), F.col("number").cast("string")).alias("source"),
            F.lit("record").alias("kind"), F.lit(None).cast("string").alias("object_id"),
            F.lit("skipped-open").alias("status"), F.array().cast("array<string>").alias("errors"),
        )
        events = raw.join(wanted.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        sealed = build_records(events, wanted, self.producer, exact, self.max_bytes)
        docs = settle_texts(sealed.select(
            F.concat(F.lit("session #"), F.col("session_number").cast("string")).alias("source"),
            F.col("doc"), "session_id",
        ), "sealed-records")
        oversize = docs.where(F.col("doc").isNull()).select(
            "source", F.lit("record").alias("kind"), F.lit(None).cast("string").alias("object_id"),
            F.lit("refused").alias("status"),
            F.array(F.lit(f"session exceeds the ingestion bound of {self.max_bytes} bytes")).alias("errors"),
        )
        added = self.add_records(docs.where(F.col("doc").isNotNull()).select("source", "doc"), exact)
        return added.unionByName(oversize).unionByName(skipped)

    def read(self, kind: str, object_id: str, exact: bool = True) -> DataFrame:
        """One object, pruned to its prefix and checked again."""
        rows = self.objects(kind).where(
            (F.col("prefix") == object_id[:2]) & (F.col("object_id") == object_id)
        ).select(F.col("object_id").alias("source"), "doc")
        check = check_records if kind == "record" else check_links
        return rows.join(
            check(rows, self.producer, exact).where(F.col("verdict") != "invalid").select("source"), "source"
        )

    def read_links(self, exact: bool = True) -> tuple[DataFrame, DataFrame]:
        """Verified links, and the count of those that could not be read."""
        checked = check_links(
            self.objects("link").select(F.col("object_id").alias("source"), "doc"), self.producer, exact
        )
        return checked.where("ok").drop("source", "ok", "verdict", "errors", "actual_id"), checked.agg(
            F.count_if(~F.col("ok")).alias("unreadable")
        )

    def verify(self, exact: bool = True) -> tuple[DataFrame, DataFrame]:
        """A17 over the stored tables."""
        filed = lambda kind: self.objects(kind).select(
            F.concat(F.lit(f"{kind}/"), "object_id").alias("source"),
            F.col("object_id").alias("filed_id"), "doc",
        )
        return verify_objects(filed("record"), filed("link"), self.producer, exact)


def union_stores(local: ObjectStore, remote: ObjectStore, exact: bool = True) -> DataFrame:
    """Pull what is missing here through the gate, push what is missing there.

    Nothing is ever deleted, and a second run finds nothing to do.  Only prefixes whose
    digests differ are read, and of those only the texts that one side misses; stores
    that hold the same objects are told so by their file listings and kept digests.
    """
    reports, missing = [], {}
    for kind in ("record", "link"):
        prefixes, pull, push = missing_ids(local, remote, kind)
        if prefixes:
            written = settle_texts if kind == "record" else settle
            part = F.col("prefix").isin(prefixes)
            missing[kind] = (
                written(remote.objects(kind).where(part).join(pull, "object_id", "left_semi"), f"pull-{kind}s"),
                written(local.objects(kind).where(part).join(push, "object_id", "left_semi"), f"push-{kind}s"),
            )
    for kind, (pull, push) in missing.items():
        # An id may be stored with several texts; each of them is put to the gate.
        offered = pull.select(F.concat("object_id", F.lit("/"), F.sha2("doc", 256)).alias("source"), "doc").distinct()
        pulled = local._add(kind, offered, exact)
        push = push.dropDuplicates(["object_id", "doc"])
        remote._append(kind, push.select("object_id", "doc", F.substring("object_id", 1, 2).alias("prefix")))
        reports.append(pulled.select(F.lit("pull").alias("direction"), "kind", "object_id", "status", "errors"))
        reports.append(push.select(
            F.lit("push").alias("direction"), F.lit(kind).alias("kind"), "object_id",
            F.lit("added").alias("status"), F.array().cast("array<string>").alias("errors"),
        ))
        for store in (local, remote):
            prefix_digests(store, kind)  # kept for the next run
    if not reports:
        return local.spark.createDataFrame([], f"direction string, {RESULT}").drop("source")
    return reduce(DataFrame.unionByName, reports)


def write_canonical(docs: DataFrame, doc_col: str, path: str) -> None:
    """One canonical JSON document per line."""
    docs.select(F.col(doc_col).alias("value")).write.text(path)
