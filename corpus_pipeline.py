"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

Each stage works on all that the one before kept, and its decisions take
effect. All but the last return the columns of documents.

In every stage: null ids, texts and sources are values like others; an empty or
null text has no words; texts of any length are read whole; repeated rows are
rows of their own, but for near_duplicates, which keeps one of them; an empty
table gives no rows; columns other than those of documents are dropped, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from seqloom.llm._spark import copies, if_small, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows of a table of ids that may be broadcast to filter the documents; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy rejects go, those without text among them. Row by row."""
    policy = quality.POLICIES[max(quality.POLICIES)]
    columns = [c for c in COLUMNS if c != "doc_id"]
    return quality.ledger(docs, *columns).filter(quality.passes(policy)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one of the least id (null last), then of the least key of id and text; of rows equal in these, one.

    Decided row by row: an id may be repeated with other texts, and rows
    without an id are told apart by their classes.
    """
    classes = materialize(ngram_join.jaccard_classes(docs, uid=decontaminate.row_key()), "pipeline-classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    leads = classes.groupBy("set_key").agg(F.min(place).alias("lead"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leads = materialize(leads.select("set_key", F.col("lead.uid").alias("_lead"), (F.col("lead.uid") != F.col("last.uid")).alias("differ")), "pipeline-leads")
    # The rows that go are few beside those that stay, so the filter is an anti join with them.
    losers = classes.join(if_small(leads.filter("differ"), BROADCAST_IDS), "set_key").filter("uid <> _lead").select(F.col("uid").alias("_uid")).distinct()
    losers = materialize(losers, "pipeline-losers")
    rows = docs.select(*COLUMNS, decontaminate.row_key().alias("uid"))
    same = F.col("uid") == F.col("_uid")
    kept = rows.join(if_small(losers, BROADCAST_IDS), same, "left_anti")
    again = classes.join(if_small(leads, BROADCAST_IDS), "set_key").filter("uid = _lead").groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = materialize(again.select(F.col("uid").alias("_uid")), "pipeline-repeated")
    if not repeated.limit(1).count():
        return kept.select(*COLUMNS)
    repeated = if_small(repeated, BROADCAST_IDS)
    one = kept.join(repeated, same, "left_semi").groupBy("uid").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").select(*COLUMNS).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go, and with them rows of equal id and text. An item without words has no window."""
    _, found = decontaminate.contained_windows(docs, table(spark, sf_dir, "benchmark"))
    hit = if_small(found.select(F.col("uid").alias("_uid")).distinct(), BROADCAST_IDS)
    return docs.select(*COLUMNS, decontaminate.row_key().alias("uid")).join(hit, F.col("uid") == F.col("_uid"), "left_anti").select(*COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, of repeated rows each by its own hash.

    A row's share follows from its id, its text and its source's plan, so texts
    are not shuffled, but for rows that are repeated: of those, equal rows are
    counted and numbered.
    """
    slim, plan = mixing.mix_plan(docs)
    key = F.md5(F.concat_ws("|", *(F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("")) for c in ("doc_id", "source")), F.col("_md5")))
    rows = docs.select(*COLUMNS, mixing.text_key(F.col("text")).alias("_md5")).withColumn("_key", key)
    repeated = materialize(slim.filter("copy = 1").withColumnRenamed("text_md5", "_md5").select(key.alias("_key")), "pipeline-repeated")
    numbered = rows.withColumn("copy", F.lit(0).cast("long"))
    if repeated.limit(1).count():
        repeated = if_small(repeated, BROADCAST_IDS)
        counted = rows.join(repeated, "_key", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
        numbered = numbered.join(repeated, "_key", "left_anti").unionByName(copies(counted))
    taken = mixing.with_plan(numbered, plan).withColumn("_times", mixing.times(mixing.mix_hash(F.col("doc_id"), F.col("_md5"), F.col("copy"))))
    return taken.filter("_times > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy")).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its shard and place, as sharding gives them; one row for each copy in the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("shards", shards),
]

#: SQL cannot express the Jaccard join; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
