"""URI functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that form encoding keeps besides letters and digits.
FORM_SAFE = "-._~:/?#[]@!$'()*,;="
_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(uri: Column, n: int) -> Column:
    return F.regexp_extract(uri, _SPLIT, n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once. In lambdas Spark computes what is named twice twice."""
    return F.get(F.transform(F.array(value), body), 0)


def remove_dots(path: Column) -> Column:
    """A path without its . and .. segments, by one fold over the segments."""

    def folded(segments: Column) -> Column:
        return F.aggregate(
            F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == F.size(segments) - 1).alias("last"))),
            F.array().cast("array<string>"),
            lambda a, x: F.when(x["s"] == ".", F.when(x["last"], F.concat(a, F.array(F.lit("")))).otherwise(a))
            .when(x["s"] == "..", F.concat(F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a), F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
            .otherwise(F.concat(a, F.array(x["s"]))),
        )

    return let(F.split(path, "/"), lambda segments: F.array_join(folded(segments), "/"))


def resolve_uri(relative: Column, base: Column) -> Column:
    """RFC 3986 reference resolution (an empty reference gives the base without its fragment)."""

    def parts(x: Column) -> Column:
        own = [_part(x["r"], k).alias(n) for k, n in ((1, "scheme"), (3, "path"), (4, "query"), (5, "fragment"))]
        of_base = [_part(x["b"], k).alias(n) for k, n in ((1, "base_scheme"), (2, "base_authority"), (3, "base_path"), (4, "base_query"))]
        return F.struct(x["r"].alias("r"), x["b"].alias("b"), *own, *of_base)

    def resolved(x: Column) -> Column:
        path, base_path = x["path"], x["base_path"]
        merged = F.when((x["base_authority"] != "") & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), path))
        new_path = F.when(path == "", base_path).otherwise(remove_dots(F.when(path.startswith("/"), path).otherwise(merged)))
        new_query = F.when(x["r"].rlike(r"^[^#]*\?"), F.concat(F.lit("?"), x["query"])).when((path == "") & (x["base_query"] != ""), F.concat(F.lit("?"), x["base_query"])).otherwise(F.lit(""))
        tail = F.when(x["fragment"] != "", F.concat(F.lit("#"), x["fragment"])).otherwise(F.lit(""))
        scheme = F.when(x["base_scheme"] != "", F.concat(x["base_scheme"], F.lit(":"))).otherwise(F.lit(""))
        head = F.concat(scheme, F.when(x["b"].rlike(r"^[^/?#]*//"), F.concat(F.lit("//"), x["base_authority"])).otherwise(F.lit("")))
        return F.when(x["scheme"] != "", x["r"]).when(x["r"].startswith("//"), F.concat(scheme, x["r"])).otherwise(F.concat(head, new_path, new_query, tail))

    both = F.struct(F.coalesce(relative, F.lit("")).alias("r"), F.coalesce(base, F.lit("")).alias("b"))
    return let(let(both, parts), resolved)


def form_encode(value: Column) -> Column:
    """A value in form encoding: FORM_SAFE stays, space becomes +, other bytes %XX."""
    out = F.url_encode(value)
    for c in FORM_SAFE:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def form_encode_pairs(pairs: Column) -> Column:
    """array of struct(name, value) as name=value&..."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(form_encode(p["name"]), F.lit("="), form_encode(p["value"]))), "&")


def form_decode(value: Column) -> Column:
    """name=value&... as an array of struct(name, value); a pair without =, or a name that is not one, is XC0061 or XC0037."""
    pairs = F.filter(F.split(value, "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        name = F.url_decode(F.substring_index(p, "=", 1))
        bad = ~F.contains(p, F.lit("=")) | F.startswith(p, F.lit("="))
        ok = F.when(bad, F.raise_error(F.lit("[XC0037] not a list of pairs"))).when(~name.rlike(r"^[\p{L}_][\p{L}\p{N}._-]*$"), F.raise_error(F.lit("[XC0061] not a name"))).otherwise(name)
        return F.struct(ok.cast("string").alias("name"), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value"))

    return F.transform(pairs, pair)
