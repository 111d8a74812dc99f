"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one bit for each failed rule; a policy is a version and a
mask of the bits that reject. New policies and ablations read the ledger, not
the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._spark import SPACE, SPACES, let

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule name -> its bit. Bits are never reused.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "duplicate_lines": 3, "word_length": 4}
BASE_MASK = 1 << RULES["few_words"] | 1 << RULES["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, by version."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


POLICIES = {
    1: Policy(1, ("few_words", "repeated_words")),
    2: Policy(2, ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length")),
}


def _repeated_words(words: Column) -> Column:
    """Words inside any run of WINDOW words that occurs twice or more in the array, the first included.

    The runs' 64-bit hashes are compared with their distinct number first;
    only a text with repeats is sorted. Time n log n in the words of a text.
    """
    n = F.size(words)
    # get() reads from 0; the lambda only sees the array and the place.
    runs = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = let(
            by_hash,
            lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()),
        )
        spans = let(F.array_sort(repeats), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spans)

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(runs, covered)).cast("long")


def measurements(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of a text (null: the empty text)."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(t, rf"\A{SPACES}|{SPACES}\z", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(
        words,
        lambda w: let(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                F.size(ln).cast("long").alias("n_lines"),
                _repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    )


def failures() -> Column:
    """The bits of the rules that the measured row fails."""
    fails = {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 5 * F.col("word_chars"),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 30 * F.col("n_words")) | (F.col("word_chars") < F.col("n_words") * 3 / 2),
    }
    bits = F.lit(0).cast("long")
    for name, test in fails.items():
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << RULES[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id (and the columns keep), the measurements and failed_bits for every row of docs(doc_id, text).

    Row by row, no shuffle. A null text is measured as the empty text: no
    words, so it fails few_words. Repeated rows stay; an empty table gives no
    rows; columns of docs that are not asked for are dropped, so their names
    cannot clash.
    """
    measured = docs.select("doc_id", *keep, measurements(F.col("text")).alias("_m")).select("doc_id", *keep, "_m.*")
    return measured.withColumn("failed_bits", failures())


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, failed, only: documents that fail a rule of the policy, and those that no other of its rules rejects.

    Counts by bit pattern first (at most 2 ** rules of them), then by rule.
    """
    counted = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("rule", F.explode(F.array(*map(F.lit, policy.rules))))
    bit = F.element_at(F.create_map(*[F.lit(x) for r in policy.rules for x in (r, 1 << RULES[r])]), F.col("rule")).cast("long")
    has = F.col("bits").bitwiseAND(bit) != 0
    return each.groupBy("rule").agg(F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(has & (F.bit_count("bits") == 1), F.col("n"))), F.lit(0)).alias("only"))


def judge(docs: DataFrame, policy: Policy = POLICIES[2]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_bits, policy_version of every row of docs(doc_id, text).

    Row by row, no shuffle. A null or empty text has no words and fails
    few_words; texts of any length are measured whole; repeated rows and null
    ids stay, each judged alone, so there are no ties; other columns are
    dropped, so their names cannot clash; an empty table gives no rows.
    """
    rows = ledger(docs)
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failed_bits", F.lit(policy.version).alias("policy_version"))
