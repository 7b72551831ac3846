"""Effect classes of commands and file events.

What a rule does not know stays null: ``reversible`` is a claim, not a default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import DOT, EDGE, END, S, trimmed

W = "[A-Za-z0-9_]"
# Commands that cannot be undone, with how far they reach. First match wins.
IRREVERSIBLE = (
    (f"{EDGE}rm{S}+(-{W}*[rf]{W}*{S}+)+", "repo"),
    (f"{EDGE}rmdir{S}+/s{EDGE}", "repo"),
    (f"{EDGE}git{S}+push{EDGE}{DOT}*(--force{EDGE}|-f{EDGE})", "repo"),
    (f"{EDGE}git{S}+reset{S}+--hard{EDGE}", "repo"),
    (f"{EDGE}git{S}+clean{EDGE}{DOT}*-{W}*f", "repo"),
    (f"{EDGE}git{S}+branch{S}+-D{EDGE}", "repo"),
    (f"{EDGE}drop{S}+(table|database|schema){EDGE}", "service"),
    (f"{EDGE}truncate{S}+table{EDGE}", "service"),
    (f"{EDGE}kubectl{S}+delete{EDGE}", "service"),
    (f"{EDGE}terraform{S}+destroy{EDGE}", "account"),
    (f"{EDGE}npm{S}+publish{EDGE}", "account"),
    (f"{EDGE}aws{S}+{W}+{S}+delete-", "account"),
)
# Commands that only read, and commands that reach the network.
READ_ONLY = (
    f"(?i)^(ls|dir|cat|type|head|tail|grep|rg|find|pwd|whoami|echo|"
    f"git{S}+(status|log|diff|show|branch{END})){EDGE}"
)
NETWORK = (
    f"(?i){EDGE}(curl|wget|npm{S}+(i|install|publish)|pip{S}+install|"
    f"git{S}+(push|pull|fetch|clone)){EDGE}"
)


def _signals(effect: str, blast: str, reversible: bool | Column | None) -> Column:
    flag = reversible if isinstance(reversible, Column) else F.lit(reversible)
    return F.struct(
        F.lit(effect).alias("effect_class"), F.lit(blast).alias("blast_radius"),
        flag.cast("boolean").alias("reversible"),
    )


def classify_command(command: Column) -> Column:
    cmd = trimmed(command)
    chain = F
    for pattern, blast in IRREVERSIBLE:
        chain = chain.when(cmd.rlike("(?i)" + pattern), _signals("destroy", blast, False))
    return (
        chain.when(cmd.rlike(READ_ONLY), _signals("read", "file", True))
        .when(cmd.rlike(NETWORK), _signals("network", "repo", None))
        .otherwise(_signals("execute", "repo", None))
    )


def classify_file_event(kind: Column, snapshotted: Column) -> Column:
    return (
        F.when(kind == "file.read", _signals("read", "file", True))
        .when(kind == "file.write", _signals("write", "file", snapshotted))
        .when(kind == "file.delete", _signals("destroy", "file", snapshotted))
        .otherwise(_signals("write", "file", None))
    )
