"""Sealed records: building and checking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.canon import (
    canonical_json, chain_hash, content_address, event_body, json_string, needs_exact, needs_exact_text, sha256,
    variant_without_key,
)
from ledgerlens.operators.chain import break_reason, canonical_docs, verify_chain
from ledgerlens.operators.facts import evaluate
from ledgerlens.operators.judge import (
    degradations, gather, integrity, interference, limitations, recorder_errors, session_flags,
)
from ledgerlens.operators.ordered import attach, seq_bucket
from ledgerlens.schemas import (
    array_at, class_of, is_object_at, number_at, number_text, payload_view, text_at, variant_at,
)
from ledgerlens.settings import (
    DEFAULT_PRODUCER, FACT_CATALOG, FORMAT_VERSION, GENESIS, Producer, settle, settle_texts,
)

HEX64 = r"^[0-9a-f]{64}(?![\s\S])"


def _member(name: str, value: Column) -> Column:
    """``,"name":value``, or nothing when the value is absent."""
    return F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit(""))


def _quoted(c: str) -> Column:
    return F.to_json(F.col(c).cast("variant"))


def event_json() -> Column:
    """Canonical JSON of a stored event; absent optionals are left out."""
    return F.concat(
        F.lit('{"actor":'), F.coalesce("actor", F.lit("null")),
        _member("blastRadius", _quoted("blast_radius")),
        _member("effectClass", _quoted("effect_class")),
        F.lit(',"hash":'), json_string(F.col("hash")),
        F.lit(',"id":'), json_string(F.col("id")),
        F.lit(',"kind":'), json_string(F.col("kind")),
        _member("missionId", _quoted("mission_id")),
        F.lit(',"monotonicTs":'), F.col("monotonic_ts").cast("string"),
        F.lit(',"payload":'), F.coalesce("payload", F.lit("null")),
        F.lit(',"prevHash":'), json_string(F.col("prev_hash")),
        _member("reversible", F.col("reversible").cast("string")),
        F.lit(',"seq":'), F.col("seq").cast("string"),
        F.lit(',"sessionId":'), json_string(F.col("session_id")),
        F.lit(',"signalTier":'), json_string(F.col("signal_tier")),
        _member("snapshotRef", F.col("snapshot_ref")),
        F.lit(',"source":'), json_string(F.col("source")),
        _member("taint", F.col("taint").cast("string")),
        _member("target", F.col("target")),
        F.lit(',"ts":'), json_string(F.col("ts")),
        F.lit("}"),
    )


def fact_json() -> Column:
    pointers = F.transform(
        "evidence",
        lambda e: F.concat(
            F.lit('{"eventId":'), json_string(e["eventId"]),
            F.lit(',"eventSeq":'), e["eventSeq"].cast("string"),
            F.lit(',"source":'), json_string(e["source"]),
            F.lit(',"ts":'), json_string(e["ts"]), F.lit("}"),
        ),
    )
    return F.concat(
        F.lit('{"confidence":'), json_string(F.col("confidence")),
        F.lit(',"evidence":['), F.array_join(pointers, ","),
        F.lit('],"id":'), json_string(F.col("fact_id")),
        F.lit(',"statement":'), json_string(F.col("statement")),
        F.lit(',"ts":'), json_string(F.col("ts")), F.lit("}"),
    )


def _json_list(name: str) -> Column:
    items = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.concat(
        F.lit("["), F.array_join(F.transform(items, lambda x: F.to_json(x.cast("variant"))), ","),
        F.lit("]"),
    )


def build_records(
    raw: DataFrame, sessions: DataFrame, producer: Producer = DEFAULT_PRODUCER,
    exact: bool = True, max_bytes: int | None = None, facts: DataFrame | None = None,
) -> DataFrame:
    """One canonical document per session, with its content address.

    A record is one value, so its session is gathered.  Where ``max_bytes`` is given,
    sessions whose events alone exceed it come back with ``doc`` null and status
    ``oversize``.
    """
    docs, view, sizes = prepared(raw, producer, exact)
    kept = docs.select("session_id", "seq", "json")
    if max_bytes is not None:
        fits = sizes.where(F.col("bytes") <= max_bytes).select("session_id")
        kept = attach(kept, fits, ["session_id"], seq_bucket(), "inner")
    listed = F.array_sort(F.collect_list(F.struct("seq", "json")))
    events = kept.groupBy("session_id").agg(
        F.array_join(F.transform(listed, lambda x: x["json"]), ",").alias("events")
    )
    fact_rows = evaluate(view) if facts is None else facts
    in_order = F.array_sort(F.collect_list(F.struct("ts", "fact_id", "tie", fact_json().alias("json"))))
    fact_lists = fact_rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("fact_count"),
        F.array_join(F.transform(in_order, lambda x: x["json"]), ",").alias("facts"),
    )
    own = session_parts(raw, view, sizes, sessions, producer, exact)
    joined = reduce(lambda a, b: a.join(b, "session_id", "left"), [*own, events, fact_lists])
    return _document(joined, producer)


def prepared(raw: DataFrame, producer: Producer, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with their JSON, the view that facts and notes read, and each session's count and bytes of events."""
    docs = canonical_docs(raw, exact).withColumn("json", event_json())
    # Facts, notes and chain read typed columns only; payloads are parsed once.
    view = settle(payload_view(raw, producer).drop("_p"), "record-view")
    sizes = docs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("count"),
        (F.sum(F.octet_length("json")) + F.count(F.lit(1))).alias("bytes"),
    )
    return docs, view, sizes


def session_parts(
    raw: DataFrame, view: DataFrame, sizes: DataFrame, sessions: DataFrame, producer: Producer, exact: bool
) -> list[DataFrame]:
    """Tables with one row per session: what a record says besides its events and facts."""
    start = view.where((F.col("signal_tier") == "groundTruth") & (F.col("kind") == "session.start"))
    identity = start.groupBy("session_id").agg(F.min_by("identity", "seq").alias("identity"))
    coverage = view.where(
        (F.col("signal_tier") == "groundTruth") & F.col("coverage_json").isNotNull()
    ).groupBy("session_id").agg(F.min_by("coverage_json", "seq").alias("coverage_json"))

    flags = session_flags(view)
    degraded = degradations(view, producer, flags)
    return [
        sessions.withColumnRenamed("id", "session_id"),
        sizes,
        integrity(degraded, verify_chain(raw, exact)).drop("events"),
        identity, coverage,
        flags.select("session_id", "closed"),
        gather(degraded, "degraded"),
        gather(limitations(view, producer, flags), "limitations"),
        gather(interference(view, producer), "interference"),
        gather(recorder_errors(view), "recorder_errors"),
    ]


def passages_of(producer: Producer) -> dict[str, Column]:
    """The texts of a record around its facts and events, and what its header says, from one row per session."""
    chain = F.concat(
        F.lit("{"),
        F.coalesce(F.concat(F.lit('"brokenAt":'), F.col("broken_at").cast("string"), F.lit(",")), F.lit("")),
        F.lit('"eventsChecked":'), F.coalesce("events_checked", F.lit(0)).cast("string"),
        F.lit(',"intact":'), F.coalesce("intact", F.lit(True)).cast("string"),
        _member("reason", _quoted("reason")),
        F.lit("}"),
    )
    # A session without a single event is intact, and has no end and no probe.
    no_probe = F.array(
        F.lit("This session has no end event. It is still running, or the wrapper died before it "
              "could close the record — anything after the last event was not observed."),
        F.lit("Command coverage was never probed for this session, so there is no measurement of "
              f"which commands {producer.label} could observe."),
    )
    empty = F.col("count").isNull()
    status = F.when(empty, "DEGRADED").otherwise(F.col("status"))
    catalog = "[" + ",".join(f'"{f}"' for f in FACT_CATALOG) + "]"
    before_facts = F.concat(
        F.lit(f'"evidence":{{"catalog":{catalog},"closed":'),
        F.coalesce("closed", F.lit(False)).cast("string"),
        F.lit(',"coverage":'), F.coalesce("coverage_json", F.lit("[]")),
        F.lit(',"facts":['),
    )
    after_facts = F.concat(
        F.lit('],"integrity":{"chain":'), chain,
        F.lit(',"degraded":'), F.when(empty, _texts(no_probe)).otherwise(_json_list("degraded")),
        F.lit(',"status":'), json_string(status),
        F.lit('},"interference":'), _json_list("interference"),
        F.lit(',"limitations":'), _json_list("limitations"),
        F.lit(',"recorderErrors":'), _json_list("recorder_errors"),
        F.lit("}"),
    )
    members = F.concat(*[
        F.coalesce(F.concat(F.lit(f',"{k}":'), F.col(f"identity.{k}")), F.lit(""))
        for k in ("gitCommit", "machineId", "model", "runtimeVersion")
    ])
    head = F.coalesce("head", F.lit(GENESIS))
    before_events = F.concat(
        after_facts,
        F.lit(f',"format":"{producer.record_format}","formatVersion":{FORMAT_VERSION},"generator":'
              f'{{"name":"{producer.name}","version":"{producer.version}"}},"identity":{{'),
        F.substr(members, F.lit(2)),
        F.lit('},"observations":{"count":'), F.coalesce("count", F.lit(0)).cast("string"),
        F.lit(',"events":['),
    )
    after_events = F.concat(F.lit(f'],"genesis":"{GENESIS}","head":"'), head, F.lit('"}'))
    subject = F.concat(
        F.lit('"subject":{"cwd":'), json_string(F.col("cwd")),
        F.lit(',"endedAt":'), json_string(F.col("ended_at")),
        F.lit(',"exitCode":'), F.coalesce(F.col("exit_code").cast("string"), F.lit("null")),
        F.lit(',"mission":'), json_string(F.col("mission")),
        F.lit(',"runtimeId":'), json_string(F.col("runtime_id")),
        F.lit(',"sessionId":'), json_string(F.col("session_id")),
        F.lit(',"sessionNumber":'), F.col("number").cast("string"),
        F.lit(',"startedAt":'), json_string(F.col("started_at")), F.lit("}"),
    )
    return {
        "before_facts": before_facts, "before_events": before_events, "after_events": after_events, "subject": subject,
        "status": status, "chain_head": head,
    }


def header_columns(passages: dict[str, Column]) -> list[Column]:
    return [
        F.col("session_id"), F.col("number").alias("session_number"), passages["status"].alias("status"),
        passages["chain_head"].alias("chain_head"), F.coalesce("count", F.lit(0)).alias("event_count"),
        F.coalesce("fact_count", F.lit(0)).alias("fact_count"), F.col("ended_at"),
    ]


def _document(joined: DataFrame, producer: Producer) -> DataFrame:
    said = passages_of(producer)
    before = F.concat(
        said["before_facts"], F.coalesce("facts", F.lit("")), said["before_events"],
        F.when(F.col("count").isNull(), "").otherwise(F.col("events")), said["after_events"],
    )
    # In steps, so that the long texts are put together and hashed once.
    texts = joined.select(*header_columns(said), before.alias("before"), said["subject"].alias("subject"))
    addressed = texts.withColumn(
        "record_id", sha256(F.concat(F.lit("{"), "before", F.lit(","), "subject", F.lit("}")))
    )
    doc = F.concat(
        F.lit("{"), "before", F.lit(',"recordId":"'), "record_id", F.lit('",'), "subject", F.lit("}")
    )
    return addressed.withColumn("doc", doc).withColumn(
        "status", F.when(F.col("doc").isNull(), "oversize").otherwise(F.col("status"))
    ).drop("before", "subject")


def _texts(items: Column) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.transform(items, lambda x: F.to_json(x.cast("variant"))), ","),
        F.lit("]"),
    )


# ---- checking (P8) ---------------------------------------------------------------------

def parse_objects(objects: DataFrame, exact: bool = True) -> DataFrame:
    """``source, doc`` to ``source, doc, v``; v is null when the text is not JSON."""
    direct = F.try_parse_json("doc")
    if not exact:
        return objects.withColumn("v", direct)
    repaired = F.try_parse_json(canonical_json(F.when(direct.isNull(), F.col("doc"))))
    return objects.withColumn("v", F.coalesce(direct, repaired))


def record_events(parsed: DataFrame, exact: bool = True) -> DataFrame:
    """Events of each document by position, with the hash their content gives."""
    e = F.col("e")
    rows = parsed.select(
        "source", text_at(F.col("v"), "$.subject.sessionId").alias("subject_id"),
        F.posexplode(array_at(F.col("v"), "$.observations.events")).alias("pos", "e"),
    )
    raw = lambda path: F.to_json(variant_at(e, path))
    cols = {
        "id": text_at(e, "$.id"), "session_id": text_at(e, "$.sessionId"),
        "seq": number_at(e, "$.seq"), "ts": text_at(e, "$.ts"), "kind": text_at(e, "$.kind"),
        "signal_tier": text_at(e, "$.signalTier"), "prev_hash": text_at(e, "$.prevHash"),
        "hash": text_at(e, "$.hash"),
        "body": body_of(e),
    }
    out = rows.select("source", "subject_id", "pos", "e", *[c.alias(k) for k, c in cols.items()])
    # Without odd numbers the variant printer's own text is canonical already.
    body = canonical_json(F.col("body"), True) if exact else F.col("body")
    return out.withColumn("computed", sha256(F.concat("prev_hash", body))).drop("body")


# The hashed members of an event, sorted; an absent one is hashed as null.
BODY_MEMBERS = (
    "actor", "blastRadius", "effectClass", "id", "kind", "missionId", "monotonicTs", "payload",
    "prevHash", "reversible", "seq", "sessionId", "signalTier", "snapshotRef", "source", "taint",
    "target", "ts",
)


def body_of(e: Column) -> Column:
    parts = []
    for i, name in enumerate(BODY_MEMBERS):
        value = F.coalesce(F.to_json(variant_at(e, f"$.{name}")), F.lit("null"))
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _structural(v: Column) -> Column:
    is_text = lambda path: F.coalesce(class_of(v, path) == "STRING", F.lit(False))
    is_number = lambda path: F.coalesce(number_at(v, path).isNotNull(), F.lit(False))
    is_object = lambda path: is_object_at(v, path)
    is_array = lambda path: array_at(v, path).isNotNull()
    is_hex = lambda path: F.coalesce(text_at(v, path).rlike(HEX64), F.lit(False))
    status = text_at(v, "$.evidence.integrity.status")
    subject, seen, evidence = is_object("$.subject"), is_object("$.observations"), is_object("$.evidence")
    rules = [
        (is_hex("$.recordId"), "recordId: expected 64 lowercase hex characters"),
        (is_text("$.generator.name") & is_text("$.generator.version"),
         "generator: expected { name, version }"),
        (subject, "subject: expected an object"),
        *[(~subject | is_text(f"$.subject.{k}"), f"subject.{k}: expected a string") for k in ("sessionId",)],
        (~subject | is_number("$.subject.sessionNumber"), "subject.sessionNumber: expected a number"),
        *[(~subject | is_text(f"$.subject.{k}"), f"subject.{k}: expected a string")
          for k in ("runtimeId", "startedAt", "cwd")],
        (seen, "observations: expected an object"),
        (~seen | F.coalesce(text_at(v, "$.observations.genesis") == GENESIS, F.lit(False)),
         "observations.genesis: expected the genesis constant"),
        (~seen | is_hex("$.observations.head"), "observations.head: expected 64 lowercase hex characters"),
        (~seen | is_number("$.observations.count"), "observations.count: expected a number"),
        (~seen | is_array("$.observations.events"), "observations.events: expected an array"),
        (evidence, "evidence: expected an object"),
        (~evidence | is_array("$.evidence.catalog"), "evidence.catalog: expected an array"),
        (~evidence | is_array("$.evidence.facts"), "evidence.facts: expected an array"),
        (~evidence | (F.coalesce(status.isin("VERIFIED", "DEGRADED", "BROKEN"), F.lit(False))
                      & is_array("$.evidence.integrity.degraded")),
         "evidence.integrity: expected { status: VERIFIED|DEGRADED|BROKEN, degraded: [] }"),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for ok, text in rules]))


def frame_errors(v: Column, format_name: str, version: int, what: str, short: str) -> Column:
    """Errors of the format marker and version, which end a check at once."""
    stated = F.coalesce(
        number_text(number_at(v, "$.formatVersion")), F.to_json(variant_at(v, "$.formatVersion")),
        F.lit("undefined"),
    )
    is_format = F.coalesce(text_at(v, "$.format") == format_name, F.lit(False))
    is_version = F.coalesce(number_at(v, "$.formatVersion") == version, F.lit(False))
    return F.when(
        ~is_format, F.array(F.lit(f"not a {what} (missing format marker)"))
    ).when(~is_version, F.array(F.concat(
        F.lit(f"{short}format version "), stated,
        F.lit(f" is not supported (supports {version}); a newer implementation may exist"),
    )))


def check_by_kind(objects: DataFrame, check, exact: bool) -> DataFrame:
    """Run ``check(objects, exact)`` without Python for all but the documents that need it."""
    if not exact:
        return check(objects, False)
    odd = F.coalesce(needs_exact(F.col("doc")), F.lit(True))
    return check(objects.where(~odd), False).unionByName(check(objects.where(odd), True))


@dataclass(frozen=True)
class ReadObjects:
    """Documents parsed and addressed once: ``source, row, v, actual_id``, and ``doc`` of the ``odd`` ones.

    ``row`` is a number of its own for every document, whatever its source.
    ``odd`` holds what the variant printer alone does not bring into canonical form, or is None.
    """

    even: DataFrame
    odd: DataFrame | None

    def texts(self, exact: bool = True) -> DataFrame:
        """``source, row, doc`` with every document in canonical form."""
        even = self.even.select("source", "row", F.to_json("v").alias("doc"))
        if self.odd is None:
            return even
        return even.unionByName(self.odd.select("source", "row", canonical_json(F.col("doc"), exact).alias("doc")))


def read_objects(objects: DataFrame, id_key: str = "recordId", exact: bool = True) -> ReadObjects:
    """Parse ``source, doc`` and take the content address of every document, in one pass that is written down."""
    v = F.col("v")
    parsed = objects.select("source", "doc", F.try_parse_json("doc").alias("v"))
    odd = F.coalesce(needs_exact_text(F.col("doc")), F.lit(False)) | v.isNull() if exact else F.lit(False)
    marked = parsed.select("source", "doc", "v", odd.alias("odd"))
    read = settle_texts(marked.select(
        "source", F.monotonically_increasing_id().alias("row"), "odd", "v", F.when(F.col("odd"), F.col("doc")).alias("doc"),
        F.when(~F.col("odd"), sha256(variant_without_key(v, id_key))).alias("actual_id"),
    ), "read-objects")
    even = read.where(~F.col("odd")).select("source", "row", "v", "actual_id")
    if not exact or read.where("odd").isEmpty():
        return ReadObjects(even, None)
    repaired = F.try_parse_json(canonical_json(F.when(v.isNull(), F.col("doc"))))
    return ReadObjects(even, settle_texts(read.where("odd").select(
        "source", "row", "doc", F.coalesce(v, repaired).alias("v"), content_address(F.col("doc"), id_key).alias("actual_id"),
    ), "read-odd"))


def check_records(
    objects: DataFrame, producer: Producer = DEFAULT_PRODUCER, exact: bool = True
) -> DataFrame:
    """``source, record_id, actual_id, stated_status, ok, verdict, errors`` per document.

    ``objects`` holds one document per ``source``, each within the object bound.
    """
    return check_read(read_objects(objects, exact=exact), producer)


def check_read(read: ReadObjects, producer: Producer = DEFAULT_PRODUCER) -> DataFrame:
    """P8 over documents that are read already."""
    checked = _check_records(read.even, producer, False)
    return checked if read.odd is None else checked.unionByName(_check_records(read.odd, producer, True))


def _check_records(parsed: DataFrame, producer: Producer, exact: bool) -> DataFrame:
    v = F.col("v")
    frame = frame_errors(v, producer.record_format, FORMAT_VERSION, f"{producer.label} evidence record", "")
    not_json = F.when(v.isNull(), F.array(F.lit("not valid JSON")))
    heads = parsed.select(
        "source",
        F.coalesce(not_json, frame, _structural(v)).alias("shape_errors"),
        text_at(v, "$.recordId").alias("record_id"),
        "actual_id",
        text_at(v, "$.subject.sessionId").alias("subject_id"),
        text_at(v, "$.observations.head").alias("head"),
        number_at(v, "$.observations.count").alias("count"),
        text_at(v, "$.evidence.integrity.status").alias("stated_status"),
        F.coalesce(F.size(array_at(v, "$.evidence.integrity.degraded")), F.lit(0)).alias("gaps"),
    )
    events = record_events(parsed, exact)
    place = F.col("pos") + 1
    by_place = events.withColumn("place", place.cast("bigint"))
    per_doc = _chain_of_documents(by_place)
    pointer_errors = _pointer_errors(parsed, by_place)
    joined = heads.join(per_doc, "source", "left").join(pointer_errors, "source", "left")
    n = F.coalesce("n", F.lit(0))
    actual_head = F.coalesce("last_hash", F.lit(GENESIS))
    intact = F.col("b").isNull()
    expected = F.when(~intact, "BROKEN").when(F.col("gaps") > 0, "DEGRADED").otherwise("VERIFIED")
    content = F.concat(
        F.array_compact(F.array(
            F.when(F.col("actual_id") != F.col("record_id"), F.concat(
                F.lit("record id: stated "), "record_id", F.lit(", canonical content hashes to "), "actual_id")),
            F.when(F.coalesce("foreign", F.lit(0)) > 0, F.concat(
                F.lit("session identity: "), F.col("foreign").cast("string"),
                F.lit(" event(s) carry a different sessionId"))),
            F.when(~intact, F.concat(
                F.lit("hash chain: event "), F.coalesce(number_text(F.col("b.seq")), F.lit("undefined")),
                F.lit(": "), F.col("b.reason"), F.lit(" ("),
                (F.col("b.place") - 1).cast("string"), F.lit(" verified before the break)"))),
            F.when(actual_head != F.col("head"), F.concat(
                F.lit("chain head: stated "), "head", F.lit(", events end at "), actual_head)),
            F.when(n != F.col("count"), F.concat(
                F.lit("event count: stated "), number_text(F.col("count")),
                F.lit(", record carries "), n.cast("string"))),
        )),
        F.coalesce("pointer_errors", F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("stated_status") != expected, F.concat(
            F.lit("integrity claim: record states "), "stated_status",
            F.lit("; these bytes verify to "), expected)))),
    )
    invalid = F.size("shape_errors") > 0
    errors = F.when(invalid, F.col("shape_errors")).otherwise(content)
    verdict = F.when(invalid, "invalid").when(F.size("errors") > 0, "altered").otherwise("verified")
    return joined.withColumn("errors", errors).select(
        "source", "record_id", "actual_id", "stated_status",
        (F.size("errors") == 0).alias("ok"), verdict.alias("verdict"), "errors",
    )


def _chain_of_documents(events: DataFrame) -> DataFrame:
    """W1 by array position; a document fits one row, so its events fit one window."""
    from pyspark.sql import Window

    stored = F.lag("hash").over(Window.partitionBy("source").orderBy("place"))
    rows = events.select(
        "source", "place", "seq", "hash",
        (F.col("session_id").eqNullSafe(F.col("subject_id"))).alias("own"),
        F.col("prev_hash").alias("prev"), stored.alias("stored"),
        F.col("computed").eqNullSafe(F.col("hash")).alias("hash_ok"),
    )
    reason = break_reason(
        F.col("place"), F.when(F.col("seq") == F.floor("seq"), F.col("seq").cast("bigint")),
        F.col("prev").eqNullSafe(F.coalesce("stored", F.lit(GENESIS))), F.col("hash_ok"),
    )
    reason = F.when(F.col("seq").isNull(), F.concat(
        F.lit("sequence gap: expected "), F.col("place").cast("string"), F.lit(", found undefined"),
    )).otherwise(reason)
    flagged = rows.withColumn("reason", reason)
    return flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("own")).alias("foreign"),
        F.max_by("hash", "place").alias("last_hash"),
        F.min_by(
            F.struct("place", "seq", "reason"), F.when(F.col("reason").isNotNull(), F.col("place"))
        ).alias("b"),
    )


def fact_pointers(parsed: DataFrame) -> DataFrame:
    """Pointers of every fact of every document, in order."""
    f, p = F.col("f"), F.col("p")
    facts = parsed.select(
        "source", F.posexplode(array_at(F.col("v"), "$.evidence.facts")).alias("fact_pos", "f")
    )
    return facts.select(
        "source", "fact_pos", text_at(f, "$.id").alias("fact_id"),
        F.posexplode(array_at(f, "$.evidence")).alias("pointer_pos", "p"),
    ).select(
        "source", "fact_pos", "fact_id", "pointer_pos",
        text_at(p, "$.eventId").alias("event_id"), number_at(p, "$.eventSeq").alias("event_seq"),
        text_at(p, "$.ts").alias("event_ts"), text_at(p, "$.source").alias("pointer_source"),
    )


def _pointer_errors(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """Pointers whose event is missing, differs, or is not ground truth."""
    last = events.groupBy("source", F.col("id").alias("event_id")).agg(
        F.max_by(F.struct("seq", "ts", "signal_tier"), "place").alias("e")
    )
    joined = fact_pointers(parsed).join(last, ["source", "event_id"], "left")
    name = F.concat("fact_id", F.lit(": cites "))
    missing = F.concat(name, F.lit("event "), "event_id", F.lit(", which is not in the record"))
    texts = F.when(F.col("e").isNull(), F.array(missing)).otherwise(F.array_compact(F.array(
        F.when(~F.col("e.seq").eqNullSafe(F.col("event_seq")), F.concat(
            name, F.lit("seq "), F.coalesce(number_text(F.col("event_seq")), F.lit("undefined")),
            F.lit(", event has seq "), F.coalesce(number_text(F.col("e.seq")), F.lit("undefined")))),
        F.when(~F.col("e.ts").eqNullSafe(F.col("event_ts")), F.concat(
            name, F.lit("ts "), F.coalesce("event_ts", F.lit("undefined")),
            F.lit(", event has ts "), F.coalesce(F.col("e.ts"), F.lit("undefined")))),
        F.when(~F.col("e.signal_tier").eqNullSafe(F.lit("groundTruth")), F.concat(
            name, F.lit("a "), F.coalesce(F.col("e.signal_tier"), F.lit("undefined")),
            F.lit("-tier event ("), "event_id", F.lit(")"))),
    )))
    rows = joined.select("source", "fact_pos", "pointer_pos", F.posexplode(texts).alias("k", "text"))
    listed = F.array_sort(F.collect_list(F.struct("fact_pos", "pointer_pos", "k", "text")))
    return rows.groupBy("source").agg(
        F.transform(listed, lambda x: x["text"]).alias("pointer_errors")
    )
