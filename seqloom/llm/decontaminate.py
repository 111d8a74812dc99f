"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window (item-sized: 10 words, or a shorter item's all words) is
cut into shingles of up to 5 words. Shingles are ordered by rarity, their
document frequency over all documents; since a contained window needs every
one of its shingles, the rarest alone is its prefix. Occurrences of prefix
shingles in documents are joined with the windows, bounded by length and
position, and each candidate window is verified shingle by shingle at its
places, which is exact containment of its words (up to 64-bit hashes).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.llm._spark import materialize

WINDOW = 10
#: Shingles of the benchmark that one pass over the documents looks for (32 MB on each executor). The windows of a larger benchmark are dealt to blocks, one pass each.
BLOCK = 4_000_000


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return pc.cast(batch.column(name), pa.binary()).to_pylist()


def _as_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def row_key() -> Column:
    """128 bits of doc_id and text: equal rows share a key and have equal results."""
    return F.concat_ws(":", F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1)))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win, n (words), k (shingle length), shingles of every window of items(item_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), _texts(batch), strict=True):
                h, counts = W.words([text])
                n = min(window, len(h))
                if not n:
                    continue
                k = min(W.SHINGLE, n)
                wins, _ = W.windows(h, counts, n, short=False)
                runs, _ = W.windows(h, counts, k, short=False)
                m = n - k + 1
                rows = np.lib.stride_tricks.sliding_window_view(runs.view(np.int64), m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(wins)), pa.array(wins.view(np.int64)), pa.array(np.full(len(wins), n), pa.int32()), pa.array(np.full(len(wins), k), pa.int32()), _as_lists(rows.ravel(), np.full(len(wins), m), pa.int64())],
                    names=["item_id", "win", "n", "k", "shingles"],
                )

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(cut, "item_id string, win long, n int, k int, shingles array<long>")


def _occurrences(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, uid, n_words, k, at, shingles: where the wanted shingles (sorted, by length) occur in each document.

    One row a document with k = 5 whether or not any occurs, and one for each
    shorter length of which any occurs.
    """
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids, texts = batch.column("doc_id"), batch.column("uid"), _texts(batch)
            at, size = 0, 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < W.SLICE * 4):
                    size += len(texts[to] or b"")
                    to += 1
                h, counts = W.words(texts[at:to])
                for k, codes in {W.SHINGLE: np.zeros(0, np.uint64), **known.value}.items():
                    runs, n_runs = W.windows(h, counts, k, short=False)
                    hit = np.zeros(0, np.int64)
                    if len(codes) and len(runs):
                        # A table by the first 20 bits drops nearly all runs before the search.
                        maybe = np.zeros(1 << 20, dtype=bool)
                        maybe[codes >> np.uint64(44)] = True
                        hit = np.flatnonzero(maybe[runs >> np.uint64(44)])
                        place = np.minimum(np.searchsorted(codes, runs[hit]), len(codes) - 1)
                        hit = hit[codes[place] == runs[hit]]
                    ends = np.cumsum(n_runs)
                    doc = np.searchsorted(ends, hit, side="right")
                    per = np.bincount(doc, minlength=to - at)
                    rows = np.arange(to - at) if k == W.SHINGLE else np.flatnonzero(per)
                    if not len(rows):
                        continue
                    pos = hit - (ends - n_runs)[doc]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, to - at).take(pa.array(rows)), uids.slice(at, to - at).take(pa.array(rows)), pa.array(counts[rows], pa.int64()), pa.array(np.full(len(rows), k), pa.int32()), _as_lists(pos, per[rows], pa.int32()), _as_lists(runs[hit].view(np.int64), per[rows], pa.int64())],
                        names=["doc_id", "uid", "n_words", "k", "at", "shingles"],
                    )
                at = to

    return docs.select("doc_id", row_key().alias("uid"), "text").mapInArrow(find, "doc_id long, uid string, n_words long, k int, at array<int>, shingles array<long>")


def _block(docs: DataFrame, wins: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contained_windows for windows whose shingles, each, fit one pass."""
    wanted: dict[int, list[int]] = {}
    for k, s in each.toLocalIterator():
        wanted.setdefault(k, []).append(s)
    hits = materialize(_occurrences(docs, {k: np.sort(np.array(v, dtype=np.int64).view(np.uint64)) for k, v in wanted.items()}), "decon-occurrences")
    base = hits.filter(F.col("k") == W.SHINGLE).select("doc_id", "uid", "n_words")
    some = hits.filter(F.size("at") > 0).drop("doc_id").dropDuplicates(["uid", "k"])
    pairs = F.posexplode(F.arrays_zip("at", F.col("shingles").alias("shingle"))).alias("i", "x")
    one = some.select("uid", "n_words", "k", pairs).select("uid", "n_words", "k", "i", F.col("x.at").alias("at"), F.col("x.shingle").alias("shingle"))
    rarity = one.groupBy("k", "shingle").agg(F.count_distinct("uid").alias("df"))
    # The rarest shingle of each window, with its place in the window; a window with a shingle in no document is nowhere.
    unique = wins.select("win", "n", "k", "shingles").dropDuplicates(["win", "n", "k"])
    ranked = unique.select("win", "n", "k", F.posexplode("shingles").alias("j", "shingle")).join(rarity, ["k", "shingle"], "left")
    prefix = ranked.groupBy("win", "n", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "j")).alias("r")).filter("r.df > 0")
    index = prefix.select("win", "n", "k", F.col("r.shingle").alias("shingle"), F.col("r.j").alias("j")).join(unique.withColumnRenamed("shingles", "need"), ["win", "n", "k"])
    index = materialize(index, "decon-index")
    start = F.col("at") - F.col("j")
    candidates = one.join(index, ["k", "shingle"]).filter((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("i") >= F.col("j")))
    lists = some.select("uid", "k", F.col("at").alias("all_at"), F.col("shingles").alias("all"))
    first, m = F.col("i") - F.col("j") + 1, F.size("need")
    exact = (F.slice("all", first, m) == F.col("need")) & (F.element_at("all_at", first) == start) & (F.element_at("all_at", first + m - 1) == start + m - 1)
    found = candidates.join(lists, ["uid", "k"]).filter(exact).select("uid", "win", "n", "k", start.alias("start"))
    owners = materialize(wins.select("win", "n", "k", "item_id").distinct(), "decon-owners")
    return base, materialize(found.join(owners, ["win", "n", "k"]).select("uid", "item_id", "start", "n"), "decon-found")


def contained_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(base, found): base has doc_id, uid, n_words of every document; found has uid, item_id, start, n of every occurrence of a window."""
    wins = materialize(item_windows(items, window), "decon-windows")
    n = wins.select("k", F.explode("shingles")).distinct().count()
    blocks = 1
    if n > BLOCK:
        # Neighbouring windows share shingles but may be dealt apart, so shingles count once for each different window; a tenth is left for uneven dealing.
        uses = wins.dropDuplicates(["win", "n", "k"]).agg(F.sum(F.size("shingles"))).first()[0]
        blocks = math.ceil(uses / (0.9 * BLOCK))
    base, found = None, None
    for b in range(blocks):
        # Dealt by window, so that an item of any size is spread over the blocks.
        part = wins.filter(F.pmod(F.xxhash64("win", "n", "k"), F.lit(blocks)) == b)
        own, more = _block(docs, part, part.select("k", F.explode("shingles").alias("shingle")).distinct())
        base, found = base or own, found.unionByName(more) if found else more
    return base, found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs(doc_id, text).

    n_hit: words inside any occurrence of any window. A null text has no words
    and no hits, an item with null text no windows; a null item id counts as
    the empty string; items of equal id count once; repeated rows stay; an
    empty table of items leaves all documents clean; texts of any length are
    read whole, some MB at a time; other columns are ignored.
    """
    base, found = contained_windows(docs, items, window)
    spans = found.groupBy("uid", "start").agg(F.max("n").alias("n"))
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))).groupBy("uid").agg(F.sum("new").alias("n_hit"))
    ids = found.select("uid", "item_id").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    ids = ids.select("uid", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("joined"))
    out = base.join(hit, "uid", "left").join(ids, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("joined", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
