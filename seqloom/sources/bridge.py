"""Rows to documents and back, in columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.sequence import element_text
from seqloom.sources.xml import escape_text

#: Characters that no XML 1.0 document may hold.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def to_seq(rows: DataFrame, pos: str, doc: Column, base_uri: Column | None = None) -> DataFrame:
    """A sequence from rows: pos orders it and must be unique."""
    return rows.select(F.lit(0).cast("bigint").alias("iter"), F.col(pos).cast("bigint").alias("pos"), (F.lit(None).cast("string") if base_uri is None else base_uri).alias("base_uri"), doc.alias("doc"))


def element(name: str, content: Column | str = "", **attributes: Column) -> Column:
    """An element around text; characters that XML cannot hold are error XD0011."""
    text = content if isinstance(content, Column) else F.lit(content)
    text = F.coalesce(text.cast("string"), F.lit(""))
    safe = F.when(text.rlike(ILLEGAL), F.raise_error(F.lit("[XD0011] a character that XML cannot hold")).cast("string")).otherwise(escape_text(text))
    return element_text(name, safe, attributes)


def around(name: str, markup: Column, **attributes: Column) -> Column:
    """An element around markup."""
    return element_text(name, markup, attributes)


def attributes_of(tokens: DataFrame, match: Column, **columns: str) -> DataFrame:
    """iter, pos, ord and attributes of matched elements as columns: name=attribute."""
    from seqloom.operators.match import attr

    return tokens.filter(match & (F.col("kind") == "open")).select("iter", "pos", "ord", "id", *[attr(a).alias(c) for c, a in columns.items()])
