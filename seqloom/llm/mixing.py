"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 32-bit hash of its id, its text and, where rows
repeat, the number of the copy. For a source that is to give
a part of its words, sizes are summed by source and hash bucket; the bucket in
which the budget ends is refined twice, down to single hash values. Documents
below the threshold are taken once more: a filter, no sort, the same for every
run, and nested: a smaller budget takes a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._spark import HEAVY, SPACES, copies, materialize

#: Bits of the hash read by the histogram and its two refinements.
LEVELS = (12, 10, 10)
#: Sources whose plans may be broadcast; of more, only those of many rows are. A choice of plan: results are the same.
BROADCAST_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D (null: 0)."""
    trimmed = F.regexp_replace(text, rf"\A{SPACES}|{SPACES}\z", "")
    return F.coalesce(F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """The MD5 of a text (null: of the empty text)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix_hash(doc_id: Column, text_md5: Column, copy: Column) -> Column:
    """A number below 2 ** 32: the first 8 hexadecimal digits of an MD5 of the id (null: empty), the text's MD5 and the copy."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), text_md5, copy.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target (and its other columns) from source, source_size.

    Sources in code point order, null last, weigh as weights repeat, and share
    the total of all sizes. No target exceeds `most` times the source's size;
    the excess is shared again by weight. That is min(most * size, level *
    weight) with one level for all, found by cumulative sums in order of
    most * size / weight. One row for each source: the catalogue of sources,
    not the documents, is ordered here.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    # In this order a source is capped as long as the level of those not before it exceeds its cap.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_rows)["level"]
    return ranked.withColumn("found", level).select(*sources.columns, F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight"))).alias("target"))


def thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """source, threshold: documents with hash < threshold are taken once more.

    slim: source, size, h. plan: source, n_rows, rest (words still to take). Each level
    sums sizes by source and the next bits of the hash, only over documents in
    the bucket where the level before ended; so the first level alone reads
    all. A source has at most 2 ** 12 sums at a time. The last hash value is
    taken if that ends nearer to the budget than leaving it.
    """
    shift, state = 32, plan.select("source", "n_rows", F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("low"))
    for k, bits in enumerate(LEVELS):
        inside = with_plan(slim, state)
        inside = inside.filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << shift)))
        shift -= bits
        sums = inside.groupBy("source", "n_rows", "rest", "low", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        edge = sums.groupBy("source", "n_rows").agg(F.min(F.struct("bucket", "upto", "size", "rest")).alias("x"))
        left = F.col("x.rest") - (F.col("x.upto") - F.col("x.size"))
        low = F.shiftleft(F.col("x.bucket"), shift)
        if k == len(LEVELS) - 1:
            low = F.when(F.col("x.upto") - F.col("x.rest") < left, low + 1).otherwise(low)
        state = materialize(edge.select("source", "n_rows", left.alias("rest"), low.alias("low")), "mix-threshold")
    return state.select("source", F.col("low").alias("threshold"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(slim, plan): slim has doc_id, source, size, text_md5, copy, h of every row; plan has source, n_rows, source_size, target, full, threshold.

    Rows of equal id, source and text are numbered as copies 0, 1, ..., each
    with a hash of its own: null and repeated ids spread like others. A document is taken full times, and once more if its hash is below the
    threshold of its source: see times().
    """
    counted = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_key(F.col("text")).alias("text_md5")).groupBy("doc_id", "source", "size", "text_md5").agg(F.count(F.lit(1)).alias("n"))
    slim = materialize(copies(counted).withColumn("h", mix_hash(F.col("doc_id"), F.col("text_md5"), F.col("copy"))), "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = targets(sources, weights, most)
    plan = plan.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-targets")
    cut = thresholds(slim, plan.filter(F.col("full") < most))
    joined = plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return slim, materialize(joined.withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))).withColumn("most", F.lit(int(most)).cast("long")), "mix-plan")


def times(h: Column) -> Column:
    """How often a document is taken, from its hash and the columns of its source's plan."""
    return F.least(F.col("full") + F.when(h < F.col("threshold"), 1).otherwise(0), F.col("most"))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, ...) with the plan(source, n_rows, ...) of their source.

    A plan of at most BROADCAST_SOURCES sources is broadcast. Of a larger one,
    those with more than one in HEAVY of the rows are (at most HEAVY of them),
    so the shuffle of the rest has no heavy key.
    """
    named = plan.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if named.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(named), same).drop("_source")
    limit = max(1, named.agg(F.sum("n_rows")).first()[0] // HEAVY)
    heavy, rest = F.broadcast(named.filter(F.col("n_rows") > limit)), named.filter(F.col("n_rows") <= limit)
    return rows.join(heavy, same).unionByName(rows.join(heavy.select("_source"), same, "left_anti").join(rest, same)).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, times for every row of docs(doc_id, source, text).

    times: how often the mix holds the document; taken = times * size. A source
    whose target is t times its size gives every document floor(t) times, and
    those below its threshold once more. Null text: size 0; a null source is a
    source; rows of null or equal ids, and repeated rows, are taken each by its
    own hash; texts of any length are read whole, once; an empty table gives no
    rows; other columns are ignored.
    """
    slim, plan = mix_plan(docs, weights, most)
    out = with_plan(slim, plan).withColumn("times", times(F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")
