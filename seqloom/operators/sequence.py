"""Steps on ordered sequences of documents (or of any rows with iter, pos).

Positions are dense ranks of pos. They are found by buckets of pos: ranks run
within a bucket, and a prefix sum runs over one row a bucket, so a sequence of
any length is spread over tasks and no row crosses the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqloom.functions.errors import PipelineError, check, fail
from seqloom.operators.rewrite import Name, name_parts

#: pos values in a bucket; pos is unique within iter, so a bucket has at most so many rows.
BUCKET = 1 << 14


def _per_bucket() -> WindowSpec:
    return Window.partitionBy("iter", "_bucket").orderBy("pos")


def _bucketed(seq: DataFrame) -> DataFrame:
    # Rows without a place come first.
    return seq.withColumn("_bucket", F.coalesce(F.floor(F.col("pos") / BUCKET), F.lit(-(1 << 62))))


def with_position(seq: DataFrame, last: bool = False) -> DataFrame:
    """position (from 1 within iter) and, if asked for, last (how many there are)."""
    b = _bucketed(seq)
    counts = b.groupBy("iter", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("iter").orderBy("_bucket")
    offsets = counts.select("iter", "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("iter")).alias("last"))
    out = b.join(offsets, ["iter", "_bucket"]).withColumn("position", (F.col("_before") + F.row_number().over(_per_bucket())).cast("bigint"))
    return out.drop("_bucket", "_before") if last else out.drop("_bucket", "_before", "last")


def iterate(seq: DataFrame) -> DataFrame:
    """The for-each construct by loop lifting: every row gets an iter of its own.

    A body that is a function of DataFrames then runs once for all iterations;
    iter_position and iter_size are the two iteration functions.
    """
    return with_position(seq, last=True).withColumn("iter", F.col("position") - 1).withColumnRenamed("position", "iter_position").withColumnRenamed("last", "iter_size")


def flatten(seq: DataFrame, inner: str = "pos") -> DataFrame:
    """The outputs of all iterations as one sequence, in the order of iter, then pos."""
    numbered = with_position(seq)
    sizes = numbered.groupBy("iter").agg(F.count(F.lit(1)).alias("_n"))
    starts = _prefix_of_iters(sizes)
    return numbered.join(starts, "iter").withColumn("pos", F.col("_start") + F.col("position") - 1).withColumn("iter", F.lit(0).cast("bigint")).drop("position", "_start")


def _prefix_of_iters(sizes: DataFrame) -> DataFrame:
    """iter, _start: rows of earlier iterations; again by buckets, of iter."""
    b = sizes.withColumn("_bucket", F.floor(F.col("iter") / BUCKET))
    per = b.groupBy("_bucket").agg(F.sum("_n").alias("_b"))
    before = per.select("_bucket", (F.sum("_b").over(Window.orderBy("_bucket")) - F.col("_b")).alias("_earlier"))
    within = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("iter")) - F.col("_n")
    return b.join(before, "_bucket").select("iter", (F.col("_earlier") + within).alias("_start"))


def input_select(seq: DataFrame, match: Column, only: tuple[str, ...] | None = None) -> DataFrame:
    """A port's select: every matched element of every document as a document of the sequence, in order.

    Places are counted within each document and, by buckets, over the documents.
    only: the columns that match reads, as in parse.
    """
    from seqloom.plans.scratch import materialize
    from seqloom.sources.xml import cut

    # Each document by itself, then only their numbers are counted: no document is read twice.
    docs = materialize(cut(seq, match, only), "select")
    sizes = _bucketed(docs.groupBy("iter", "pos").agg(F.sum("n").alias("_n")))
    per = sizes.groupBy("iter", "_bucket").agg(F.sum("_n").alias("_b"))
    per = per.select("iter", "_bucket", (F.sum("_b").over(Window.partitionBy("iter").orderBy("_bucket")) - F.col("_b")).alias("_earlier"))
    starts = sizes.join(per, ["iter", "_bucket"]).select("iter", "pos", (F.col("_earlier") + F.sum("_n").over(_per_bucket()) - F.col("_n")).alias("_start"))
    placed = docs.join(starts, ["iter", "pos"]).select("iter", "_start", "base_uri", F.inline("found"))
    return placed.select("iter", (F.col("_start") + F.col("k")).cast("bigint").alias("pos"), "base_uri", "doc")


def check_cardinality(seq: DataFrame, iterations: DataFrame | None = None, code: str = "XD0007") -> DataFrame:
    """The sequence of a port that takes one document (of each row of iterations): none or several are error XD0006 (inputs) or XD0007 (outputs) when it is read."""
    sizes = seq.groupBy("iter").agg(F.count(F.lit(1)).alias("_n"))
    asked = iterations.select("iter") if iterations is not None else sizes.select("iter")
    wrong = asked.join(sizes, "iter", "left").filter(F.coalesce("_n", F.lit(0)) != 1).select("iter", F.lit(True).alias("_wrong"))
    none = seq.select("iter", "pos", "base_uri", "doc").join(wrong, "iter", "full_outer")
    return none.withColumn("doc", F.when(F.col("_wrong"), fail(code, "the port takes one document")).otherwise(F.col("doc"))).drop("_wrong")


def identity(seq: DataFrame) -> DataFrame:
    return seq


def sink(seq: DataFrame) -> None:
    """Read the sequence and drop it."""
    seq.write.format("noop").mode("overwrite").save()


def count(seq: DataFrame, limit: int = 0) -> DataFrame:
    """result: how many there are, at most limit unless it is 0. One row also for an empty sequence without iterations."""
    check(isinstance(limit, int), "XD0019", "limit is not an integer")
    rows = seq.limit(limit) if limit else seq
    n = F.count(F.lit(1))
    return rows.agg((F.least(n, F.lit(limit)) if limit else n).cast("bigint").alias("result"))


def count_each(seq: DataFrame, iterations: DataFrame, limit: int = 0) -> DataFrame:
    """iter, result for each row of iterations(iter), those without documents included."""
    n = F.count(F.lit(1))
    counted = seq.groupBy("iter").agg((F.least(n, F.lit(limit)) if limit else n).cast("bigint").alias("result"))
    return iterations.select("iter").join(counted, "iter", "left").select("iter", F.coalesce("result", F.lit(0).cast("bigint")).alias("result"))


def split_sequence(seq: DataFrame, test: Column, initial_only: bool = False, positions: bool = False, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matched, not matched). test may read position and last if asked for; a null test is false.

    initial_only: only the rows before the first failure match: an aggregate, no window.
    """
    rows = with_position(seq, last) if positions or last else seq
    tested = rows.withColumn("_ok", F.coalesce(test, F.lit(False)))
    if initial_only:
        failed = tested.filter(~F.col("_ok")).groupBy("iter").agg(F.min("pos").alias("_first"))
        tested = tested.join(failed, "iter", "left").withColumn("_ok", F.col("_first").isNull() | (F.col("pos") < F.col("_first"))).drop("_first")
    extra = [c for c in ("position", "last") if c in tested.columns and c not in seq.columns]
    return tested.filter("_ok").drop("_ok", *extra), tested.filter(~F.col("_ok")).drop("_ok", *extra)


def adjacent_runs(seq: DataFrame, key: Column) -> DataFrame:
    """run (from 0 within iter): neighbours with equal keys share it. Null keys are equal.

    Changes are found within buckets; the first row of a bucket is compared
    with the last key of the bucket before, one row a bucket.
    """
    b = _bucketed(seq.withColumn("_k", key))
    edges = b.groupBy("iter", "_bucket").agg(F.max_by(F.struct("_k"), "pos").alias("_last"))
    by_bucket = Window.partitionBy("iter").orderBy("_bucket")
    edges = edges.select("iter", "_bucket", F.lag("_last").over(by_bucket).alias("_prev"))
    before = F.coalesce(F.lag(F.struct("_k")).over(_per_bucket()), F.col("_prev"))
    b = b.join(edges, ["iter", "_bucket"]).withColumn("_before", before)
    b = b.withColumn("_new", F.when(F.col("_before").isNotNull() & F.col("_before._k").eqNullSafe(F.col("_k")), 0).otherwise(1))
    b = b.withColumn("_run", F.sum("_new").over(_per_bucket()))
    per = b.groupBy("iter", "_bucket").agg(F.sum("_new").alias("_n"))
    per = per.select("iter", "_bucket", (F.sum("_n").over(by_bucket) - F.col("_n")).alias("_earlier"))
    return b.join(per, ["iter", "_bucket"]).withColumn("run", (F.col("_earlier") + F.col("_run") - 1).cast("bigint")).drop("_bucket", "_k", "_prev", "_before", "_new", "_run", "_earlier")


def element_text(name: Name, content: Column, attributes: dict[str, Column] | None = None) -> Column:
    """An element as text, around content that is markup."""
    from seqloom.sources.xml import escape_attribute

    ns, prefix, local = name_parts(name)
    full = f"{prefix}:{local}" if prefix else local
    declared = f' xmlns{":" + prefix if prefix else ""}="{ns}"' if ns else ""
    pairs = [F.concat(F.lit(f' {k}="'), escape_attribute(F.coalesce(v.cast("string"), F.lit(""))), F.lit('"')) for k, v in (attributes or {}).items()]
    return F.concat(F.lit(f"<{full}{declared}"), *pairs, F.lit(">"), content, F.lit(f"</{full}>"))


def wrap_sequence(seq: DataFrame, name: Name, group_adjacent: Column | None = None, iterations: DataFrame | None = None) -> DataFrame:
    """One document around all of each iteration's sequence, or around each run of neighbours with equal keys.

    A document is a row, so one made of the whole sequence is as large as it:
    that is what the step without a key means. An empty sequence gives one
    empty wrapper without a key (for each row of iterations(iter), by default
    the one iteration 0), and none with one.
    """
    pieces = lambda: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc"))), lambda x: x["doc"]), "")
    if group_adjacent is None:
        each = seq.groupBy("iter").agg(F.min_by("base_uri", "pos").alias("base_uri"), pieces().alias("_c"))
        if iterations is not None:
            each = iterations.select("iter").join(each, "iter", "left")
        else:  # no row at all: an aggregate without groups still gives one
            none = seq.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(0).cast("bigint").alias("iter"), F.lit(None).cast("string").alias("base_uri"), F.lit("").alias("_c"))
            each = each.unionByName(none)
        return each.select("iter", F.lit(0).cast("bigint").alias("pos"), "base_uri", element_text(name, F.coalesce("_c", F.lit(""))).alias("doc"))
    runs = adjacent_runs(seq, group_adjacent.cast("string"))
    grouped = runs.groupBy("iter", "run").agg(F.min_by("base_uri", "pos").alias("base_uri"), pieces().alias("_c"))
    return grouped.select("iter", F.col("run").alias("pos"), "base_uri", element_text(name, F.col("_c")).alias("doc"))


def pack(left: DataFrame, right: DataFrame, name: Name) -> DataFrame:
    """Pairs of documents at equal positions under a wrapper; the longer sequence's rest is wrapped alone."""
    a = with_position(left).select("iter", "position", "base_uri", F.col("doc").alias("_a"))
    b = with_position(right).select("iter", "position", F.col("base_uri").alias("_bu"), F.col("doc").alias("_b"))
    both = a.join(b, ["iter", "position"], "full_outer")
    content = F.concat(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit("")))
    return both.select("iter", (F.col("position") - 1).alias("pos"), F.coalesce("base_uri", "_bu").alias("base_uri"), element_text(name, content).alias("doc"))


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """pack for tables: the rows of both at equal positions, as structs a and b."""
    struct = lambda d, n: with_position(d).select("iter", "position", F.struct(*d.columns).alias(n))
    return struct(left, "a").join(struct(right, "b"), ["iter", "position"], "full_outer")


def concat(*seqs: DataFrame) -> DataFrame:
    """Several bindings of one port: sequences one after the other."""
    parts = [with_position(s).withColumn("_branch", F.lit(i)) for i, s in enumerate(seqs)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sizes = union.groupBy("iter", "_branch").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("iter", "_branch", (F.sum("_n").over(Window.partitionBy("iter").orderBy("_branch")) - F.col("_n")).alias("_start"))
    return union.join(starts, ["iter", "_branch"]).withColumn("pos", F.col("_start") + F.col("position") - 1).drop("_branch", "_start", "position") if len(seqs) > 1 else seqs[0]


def compare(left: DataFrame, right: DataFrame, fail_if_not_equal: bool = False) -> DataFrame:
    """iter, pos, equal: whether the documents at a place are deep-equal; XC0019 if asked for and not."""
    from seqloom.sources.xml import canonical, parse

    a = canonical(parse(left)).withColumnRenamed("digest", "_a")
    b = canonical(parse(right)).withColumnRenamed("digest", "_b")
    equal = F.col("_a").eqNullSafe(F.col("_b"))
    if fail_if_not_equal:
        equal = F.when(equal, True).otherwise(fail("XC0019", "not equal").cast("boolean"))
    return a.join(b, ["iter", "pos"], "full_outer").select("iter", "pos", equal.alias("equal"))


def choose(seq: DataFrame, branches: list[tuple[Column, Callable[[DataFrame], DataFrame]]], otherwise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each document goes to the first branch whose test is true; none and no otherwise: XD0004.

    All branches run over their share of the rows; results are united.
    """
    tag = F.lit(None).cast("int")
    for k in reversed(range(len(branches))):
        tag = F.when(F.coalesce(branches[k][0], F.lit(False)), F.lit(k)).otherwise(tag)
    none = fail("XD0004", "no branch is true").cast("int") if otherwise is None else F.lit(-1)
    tagged = seq.withColumn("_branch", F.coalesce(tag, none))
    out = None
    for k, body in [*enumerate(b for _, b in branches), *([(-1, otherwise)] if otherwise else [])]:
        part = body(tagged.filter(F.col("_branch") == k).drop("_branch"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def try_catch(seq: DataFrame, group: Callable[[DataFrame], DataFrame], catch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of group, and those of catch for the documents that group fails on.

    Errors are data here, so one bad document does not end the job: group gives
    a column error (null, or a code with a message). If group cannot be built
    at all (a wrong option), all documents go to catch with that error.
    """
    try:
        done = group(seq)
    except PipelineError as x:
        return catch(seq.withColumn("error", F.lit(str(x))))
    good = done.filter(F.col("error").isNull()).drop("error")
    return good.unionByName(catch(done.filter(F.col("error").isNotNull())), allowMissingColumns=True)


def try_parsed(seq: DataFrame, group: Callable[[DataFrame], DataFrame], catch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """try_catch for steps on tokens: group maps the tokens of the documents that can be read to a sequence.

    catch gets the others as rows iter, pos, base_uri, doc, code, message, or
    all documents if group cannot be built. Documents are read once, into a
    table that both branches use.
    """
    from seqloom.plans.scratch import materialize
    from seqloom.sources.xml import parse

    tokens = materialize(parse(seq, errors=True), "try")
    try:
        good = group(tokens.filter("kind <> 'error'"))
    except PipelineError as x:
        return catch(seq.withColumn("code", F.lit(x.code)).withColumn("message", F.lit(x.message)))
    bad = tokens.filter("kind = 'error'").select("iter", "pos", F.col("local").alias("code"), F.col("value").alias("message"))
    return good.unionByName(catch(seq.join(bad, ["iter", "pos"])), allowMissingColumns=True)


def until_unchanged(seq: DataFrame, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat body until every document is deep-equal to its last state; a body that loses or adds documents is XD0006.

    Each round is written to the shared folder, and only documents that still
    change go on.
    """
    from seqloom.plans.scratch import materialize
    from seqloom.sources.xml import canonical, parse

    done, now = None, materialize(seq, "until")
    while True:
        new = materialize(body(now), "until")
        a = canonical(parse(now)).withColumnRenamed("digest", "_a")
        b = canonical(parse(new)).withColumnRenamed("digest", "_b")
        state = materialize(a.join(b, ["iter", "pos"], "full_outer").select("iter", "pos", F.when(F.col("_a").isNull() | F.col("_b").isNull(), fail("XD0006", "the body gives one document").cast("boolean")).otherwise(F.col("_a") == F.col("_b")).alias("_same")), "until")
        still = new.join(state.filter("_same"), ["iter", "pos"], "left_semi")
        done = still if done is None else done.unionByName(still)
        now = materialize(new.join(state.filter(~F.col("_same")), ["iter", "pos"], "left_semi"), "until")
        if not now.limit(1).count():
            return done
