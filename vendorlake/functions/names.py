"""Name rules: header sanitizing, glob routing, decompressed names.

The Python helpers act on column names and registry patterns (driver-side
metadata only).  The ``*_col`` variants are the same rules as built-in Column
expressions, for applying them to data such as file inventories or header
lines.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NON_ALNUM = re.compile(r"[^0-9a-zA-Z]+")


def sanitize_header(name: str) -> str:
    """'Order ID' -> 'order_id', 'Paid-Amount ($)' -> 'paid_amount'."""
    return _NON_ALNUM.sub("_", name.strip().lower()).strip("_")


def sanitize_col(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, "[^0-9a-zA-Z]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def glob_to_regex(pattern: str) -> str:
    """Anchored, case-sensitive regex for a shell glob (``*``, ``?``, ``[...]``).

    Written for Java's regex engine (``rlike``) and DuckDB's RE2 alike.
    """
    out, i, n = ["^"], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
            else:
                body = pattern[i:j].replace("\\", r"\\")
                i = j + 1
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append(f"[{body}]")
        elif ch.isalnum() or ch == "_":
            out.append(ch)
        else:
            out.append("\\" + ch)
    out.append("$")
    return "".join(out)


def glob_match(name: str, pattern: str) -> bool:
    return re.match(glob_to_regex(pattern), name, flags=re.DOTALL) is not None


def decompressed_name(filename: str) -> str:
    """Strip one trailing '.gz' only: 'archive.tar.gz' -> 'archive.tar'."""
    return filename[:-3] if filename.endswith(".gz") else filename


def decompressed_name_col(c: Column) -> Column:
    return F.regexp_replace(c, r"\.gz$", "")
