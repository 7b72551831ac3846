"""Pattern pieces that mean the same in Java and Python regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that producers treat as white space.
BLANK_CHARS = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
S = f"[{BLANK_CHARS}]"
NOT_S = f"[^{BLANK_CHARS}]"
# Any character but a line end.
DOT = "[^\n\r\u2028\u2029]"
# An ASCII word edge, and the end of the text.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
END = r"(?![\s\S])"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{S}+|{S}+{END}", "")
