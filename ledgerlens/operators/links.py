"""Links: claims people make about records and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.addresses import address_kind, repo_signal, target_id
from ledgerlens.functions.canon import content_address, json_string, sha256
from ledgerlens.operators.record import HEX64, check_by_kind, frame_errors, parse_objects
from ledgerlens.schemas import text_at
from ledgerlens.settings import DEFAULT_PRODUCER, FORMAT_VERSION, Producer

IDENTITY = {"identity:same-repo": "merge", "identity:distinct-repos": "distinct"}
FIELDS = ("author", "ts", "type", "from", "to", "reason")


def make_links(claims: DataFrame, producer: Producer = DEFAULT_PRODUCER) -> DataFrame:
    """Claims (author, ts, type, from, to, reason) with their id and canonical document."""
    named = lambda keys: [
        p for k in keys for p in (F.lit(f'"{k}":'), json_string(F.col(k)), F.lit(","))
    ]
    head = F.concat(
        F.lit("{"), *named(("author",)),
        F.lit('"format":'), F.lit(f'"{producer.link_format}","formatVersion":{FORMAT_VERSION},'),
        *named(("from",)),
    )
    tail = F.concat(*named(("reason", "to", "ts")), F.lit('"type":'), json_string(F.col("type")), F.lit("}"))
    link_id = sha256(F.concat(head, tail))
    doc = F.concat(head, F.lit('"linkId":"'), link_id, F.lit('",'), tail)
    return claims.withColumns({"link_id": link_id, "doc": doc})


def check_links(objects: DataFrame, producer: Producer = DEFAULT_PRODUCER, exact: bool = True) -> DataFrame:
    """Row-local verdict of every link document."""
    return check_by_kind(objects, lambda o, e: _check_links(o, producer, e), exact)


def _check_links(objects: DataFrame, producer: Producer, exact: bool) -> DataFrame:
    v = F.col("v")
    parsed = parse_objects(objects, exact)
    fields = parsed.select(
        "source", "v", text_at(v, "$.linkId").alias("link_id"),
        content_address(F.col("doc"), "linkId", exact).alias("actual_id"),
        *[text_at(v, f"$.{k}").alias(k) for k in FIELDS],
    )
    frame = frame_errors(v, producer.link_format, FORMAT_VERSION, f"{producer.label} link", "link ")
    filled = lambda k: F.coalesce(F.length(k) > 0, F.lit(False))
    wrong = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
    shape = F.array_compact(F.array(
        wrong(F.col("link_id").rlike(HEX64), "linkId: expected 64 lowercase hex characters"),
        wrong(filled("author"), "author: expected a non-empty string"),
        wrong(filled("ts"), "ts: expected an ISO 8601 string"),
        wrong(filled("type"), "type: expected a non-empty string"),
        wrong(filled("from"), "from: expected an address"),
        wrong(filled("to"), "to: expected an address or URL"),
        wrong(F.col("reason").isNotNull(), "reason: expected a string (may be empty)"),
    ))
    from_kind, to_kind = address_kind(F.col("from")), address_kind(F.col("to"))
    is_identity = F.col("type").isin(*IDENTITY)
    same = repo_signal(F.col("from")).isNotNull() & repo_signal(F.col("from")).eqNullSafe(repo_signal(F.col("to")))
    sense = F.array_compact(F.array(
        wrong(from_kind != "external", F.concat(
            F.lit('from: "'), "from", F.lit('" is not an evidence address (record/link/repo)'))),
        wrong(to_kind.isNotNull(), F.concat(
            F.lit('to: "'), "to", F.lit('" is not a valid address or URL'))),
        wrong(~is_identity | (from_kind.eqNullSafe(F.lit("repo")) & to_kind.eqNullSafe(F.lit("repo"))),
              F.concat("type", F.lit(": from and to must both be repo addresses (evidence:repo/<signal>)"))),
        wrong(~(is_identity & same), F.concat("type", F.lit(": from and to name the same repository"))),
        wrong((F.col("type") != "retracts") | to_kind.eqNullSafe(F.lit("link")),
              "retracts: `to` must be a link address (evidence:link/<id>)"),
    ))
    some = lambda errors: F.when(F.size(errors) > 0, errors)
    invalid = F.coalesce(
        F.when(v.isNull(), F.array(F.lit("not valid JSON"))), frame, some(shape), some(sense)
    )
    altered = F.when(F.col("actual_id") != F.col("link_id"), F.array(F.concat(
        F.lit("link id: stated "), "link_id", F.lit(", canonical content hashes to "), "actual_id")))
    return fields.select(
        "source", "link_id", "actual_id", *FIELDS,
        F.coalesce(invalid, altered).isNull().alias("ok"),
        F.when(invalid.isNotNull(), "invalid").when(altered.isNotNull(), "altered")
        .otherwise("verified").alias("verdict"),
        F.coalesce(invalid, altered, F.array().cast("array<string>")).alias("errors"),
    )


def retracted_ids(links: DataFrame) -> DataFrame:
    """Ids that some ``retracts`` link names; one level, whatever became of that link."""
    return (
        links.where((F.col("type") == "retracts") & (address_kind(F.col("to")) == "link"))
        .select(target_id(F.col("to")).alias("link_id"))
        .distinct()
    )


def active_links(links: DataFrame) -> DataFrame:
    return links.join(retracted_ids(links), "link_id", "left_anti")


def derive_directives(links: DataFrame) -> DataFrame:
    """What active identity links ask for, endpoints in order."""
    a, b = repo_signal(F.col("from")), repo_signal(F.col("to"))
    kind = F.when(F.col("type") == "identity:same-repo", "merge").when(
        F.col("type") == "identity:distinct-repos", "distinct"
    )
    return (
        active_links(links)
        .select(kind.alias("kind"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"),
                "link_id", "author", a.isNotNull().alias("has_a"), b.isNotNull().alias("has_b"))
        .where(F.col("kind").isNotNull() & F.col("has_a") & F.col("has_b"))
        .select("kind", "a", "b", "link_id", "author")
    )


def dangling_links(links: DataFrame, record_ids: DataFrame, link_ids: DataFrame) -> DataFrame:
    """Links with a record or link endpoint that is in neither store."""
    ends = links.select("link_id", F.explode(F.array("from", "to")).alias("address")).select(
        "link_id", address_kind(F.col("address")).alias("kind"), target_id(F.col("address")).alias("id")
    )
    no_record = ends.where(F.col("kind") == "record").join(
        record_ids.select(F.col("record_id").alias("id")), "id", "left_anti"
    )
    no_link = ends.where(F.col("kind") == "link").join(
        link_ids.select(F.col("link_id").alias("id")), "id", "left_anti"
    )
    return no_record.unionByName(no_link).select("link_id").distinct()


def touching_links(links: DataFrame, signals: DataFrame, members: DataFrame) -> DataFrame:
    """Links with an endpoint among ``signals(value)`` or records of ``members(record_id)``."""
    ends = links.select("link_id", F.explode(F.array("from", "to")).alias("address")).select(
        "link_id", address_kind(F.col("address")).alias("kind"),
        repo_signal(F.col("address")).alias("value"), target_id(F.col("address")).alias("record_id"),
    )
    by_repo = ends.where(F.col("kind") == "repo").join(signals, "value", "left_semi")
    by_record = ends.where(F.col("kind") == "record").join(members, "record_id", "left_semi")
    ids = by_repo.select("link_id").unionByName(by_record.select("link_id")).distinct()
    return links.join(ids, "link_id", "left_semi")
