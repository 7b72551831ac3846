"""Git remote URLs and root commits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import DOT, END, trimmed

# Ports that a scheme implies.
DEFAULT_PORTS = {"ssh": "22", "https": "443", "http": "80", "git": "9418"}

_URL = f"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]+)(?:/({DOT}*))?{END}"
_SCP = f"^(?:[^@]+@)?([^:/]+):({DOT}+){END}"
_AUTHORITY = f"^([^:]+)(?::([0-9]+))?{END}"


def _assembled(host: Column, port: Column, implied: Column, path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, "^/+", ""), f"/+{END}", "")
    p = F.regexp_replace(p, rf"(?i)\.git{END}", "")
    keep = (port != "") & ~port.eqNullSafe(implied)
    shown = F.when(keep, F.concat(F.lit(":"), port)).otherwise("")
    return F.when((host != "") & (p != ""), F.concat(host, shown, F.lit("/"), p))


def normalize_remote_url(raw: Column) -> Column:
    """``host[:port]/path``, or null when the text names no remote repository."""
    url = trimmed(raw)
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    authority = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"^[\s\S]*@", "")
    host = F.lower(F.regexp_extract(authority, _AUTHORITY, 1))
    port = F.regexp_extract(authority, _AUTHORITY, 2)
    ports = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])
    from_url = _assembled(host, port, F.get(F.array(ports[scheme]), F.lit(0)), F.regexp_extract(url, _URL, 3))
    from_scp = _assembled(
        F.lower(F.regexp_extract(url, _SCP, 1)), F.lit(""), F.lit(None).cast("string"),
        F.regexp_extract(url, _SCP, 2),
    )
    is_local = (url == "") | url.rlike(r"^[a-zA-Z]:[\\/]") | url.rlike(r"^[/.]")
    return (
        F.when(is_local, F.lit(None))
        .when(url.rlike(_URL), F.when(scheme != "file", from_url))
        .when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.lit(None))
        .when(url.rlike(_SCP), from_scp)
    )


def strip_url_credentials(url: Column) -> Column:
    """Drop userinfo from a URL; an scp-like user stays unless it hides a secret."""
    with_scheme = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/]*@([^/@]+(?:/" + DOT + "*)?)" + END
    scp = "^([^@]+)@([^:]+:" + DOT + "*)" + END
    hides = F.regexp_extract(url, scp, 1).contains(":")
    return (
        F.when(url.rlike(with_scheme), F.regexp_replace(url, with_scheme, "$1$2"))
        .when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+"), url)
        .when(url.rlike(scp) & hides, F.regexp_extract(url, scp, 2))
        .otherwise(url)
    )


def root_commits(lines: Column, limit: int | None = None) -> Column:
    """The 40-hex root commits, smallest first; the first ``limit`` where one is given."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike("^[0-9a-f]{40}" + END))
    return F.array_sort(kept) if limit is None else F.slice(F.array_sort(kept), 1, limit)
