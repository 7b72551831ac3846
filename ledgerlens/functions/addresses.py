"""Evidence addresses and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import END

RECORD = f"^evidence:record/([0-9a-f]{{64}})(#[0-9]+)?{END}"
LINK = f"^evidence:link/([0-9a-f]{{64}}){END}"
REPO = "evidence:repo/"


def address_kind(address: Column) -> Column:
    """record, link, repo, external, or null for an address that cannot be read."""
    return (
        F.when(address.isNull() | (address == ""), F.lit(None))
        .when(address.rlike(RECORD), "record")
        .when(address.rlike(LINK), "link")
        .when(address.startswith(REPO) & (F.length(address) > len(REPO)), "repo")
        .when(address.startswith("evidence:"), F.lit(None))
        .otherwise("external")
    )


def target_id(address: Column) -> Column:
    """The record or link id that an address names."""
    found = F.coalesce(
        F.when(address.rlike(RECORD), F.regexp_extract(address, RECORD, 1)),
        F.when(address.rlike(LINK), F.regexp_extract(address, LINK, 1)),
    )
    return found


def repo_signal(address: Column) -> Column:
    return F.when(address.startswith(REPO), F.substr(address, F.lit(len(REPO) + 1)))


def repo_address(signal: Column) -> Column:
    return F.concat(F.lit(REPO), signal)


def cite(record_id: Column, seq: Column | None = None) -> Column:
    parts = [F.lit("evidence:record/"), record_id]
    if seq is not None:
        parts += [F.lit("#"), seq.cast("string")]
    return F.concat(*parts)


def cite_link(link_id: Column) -> Column:
    return F.concat(F.lit("evidence:link/"), link_id)
