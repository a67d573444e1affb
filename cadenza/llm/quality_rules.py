"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit per failed rule beside the
measurements. A policy is a named, versioned set of rules: applying one, or asking what each rule
does on its own, needs only the ledger (bitwise operations and a single aggregation).

Everything here is built from DataFrame functions.

Defined results: null or empty text has no words, fails `few_words` and is rejected; repeated rows are
judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE_CHARS, computed, text_of, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window for repeats.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`failed` is a condition on the measurements; `bit` never changes once given out."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


POLICIES = (
    Policy("base", 1, BASE),
    Policy("web", 1, (*BASE, "many_symbols")),
    Policy("web", 2, (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words")),
)


def _repeated_at(s: str) -> Column:
    """Positions of the windows whose hash occurs twice, from the column `s` of (hash, position) in order:
    equal windows stand side by side, so that a text of any length takes n log n."""
    return F.filter(
        F.transform(
            F.col(s),
            lambda x, j: F.when(
                (F.get(F.col(s), j - 1)["h"] == x["h"]) | (F.get(F.col(s), j + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda p: p.isNotNull(),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.col("_t")
    hashed = F.col("_hw")
    staged = (
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
        .select("doc_id", "_t", words_of(text).alias("_w"), F.split(text, "\n").alias("_l"))
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.filter("_l", lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("_l"),
            F.transform("_w", lambda x: F.xxhash64(x)).alias("_hw"),
        )
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.when(
                F.col("n_words") > WINDOW,
                F.transform(
                    F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
                    lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(WINDOW))),
                ),
            ).alias("_win"),
        )
    )
    # most documents repeat no window: the sort is only for those that do
    staged = staged.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"),
            F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_win")
    staged = staged.withColumn("_at", F.sort_array(_repeated_at("_s"))).drop("_s")
    covered = F.aggregate(
        F.col("_at"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return computed(staged.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements, and `failed_bits` with the bit of every rule that failed."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed_bits", bits)


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, out: str = "kept") -> DataFrame:
    return led.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablation(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that are kept without it."""
    mask = policy.mask(rules)
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    # documents are first counted by their pattern of bits: at most 2 ^ rules rows go on
    patterns = led.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    used = [r for r in rules if r.name in policy.rules]
    entries = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used))
    return (
        patterns.select("bits", "n", F.explode(entries).alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def quality_report(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The ledger with the verdicts of the base rules and of `policy`."""
    base = Policy("base", 1, BASE).mask()
    led = apply_policy(ledger(docs), policy)
    failed = F.col("failed_bits").bitwiseAND(F.lit(base).cast("long")) != 0
    return led.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"),
        "failed_bits",
        "n_lines",
    )
