"""Match conditions on token tables, as Spark columns.

A condition is true for both the start and the end tag of an element, so a
step can act on each row alone. Any other column expression over the token
columns is a condition as well.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_element() -> Column:
    return F.col("kind").isin("open", "close")


def element(pattern: str = "*", ns: str | None = None) -> Column:
    """Elements by name and ancestors: "p", "div/p" (a child), "doc//p" (a descendant), "/doc/p" (from the root), with * for any name."""
    parts = re.split(r"(//|/)", pattern)
    names = "".join({"//": "/(?:.*/)?", "/": "/"}.get(x, "[^/]+" if x == "*" else re.escape(x)) for x in parts)
    if pattern == "*" and ns is None:
        return is_element()
    ok = F.col("path").rlike(f"^{names}$" if pattern.startswith("/") else f"(?:^|/){names}$") & is_element()
    return ok if ns is None else ok & (F.col("ns") == ns)


def text() -> Column:
    return F.col("kind") == "text"


def comment() -> Column:
    return F.col("kind") == "comment"


def pi(target: str | None = None) -> Column:
    ok = F.col("kind") == "pi"
    return ok if target is None else ok & (F.col("local") == target)


def attr(local: str, ns: str = "") -> Column:
    """The value of an attribute of the element (null: it has none)."""
    found = F.filter("attrs", lambda a: (a["local"] == local) & (a["ns"] == ns))
    return F.get(F.transform(found, lambda a: a["value"]), 0)


def has_attr(local: str, ns: str = "") -> Column:
    return is_element() & F.exists("attrs", lambda a: (a["local"] == local) & (a["ns"] == ns))


def within(pattern: str) -> Column:
    """Tokens below an element of this pattern, of whatever kind."""
    parts = re.split(r"(//|/)", pattern)
    names = "".join({"//": "/(?:.*/)?", "/": "/"}.get(x, "[^/]+" if x == "*" else re.escape(x)) for x in parts)
    own = F.col("path").rlike(f"(?:^|/){names}(?:/|$)")
    inner = F.col("path").rlike(f"(?:^|/){names}/")
    return F.when(is_element(), inner).otherwise(own)
