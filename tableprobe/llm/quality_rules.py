"""Quality rules as a bitmask ledger: every rule is evaluated once; its failure is one bit.

``ledger`` stores measurements and failure bits, ``apply_policy`` reads a verdict of a versioned policy off
the bits, and ``ablation`` tells by bitwise aggregation what each rule does, without touching a text again.
Only DataFrame functions are used; no row leaves its partition and nothing is shuffled but ``ablation``'s
few counters.

Defined cases: a null or blank text has zero words and fails ``few_words``; a rule whose value is null does
not fail; repeated rows get a ledger row each; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import WORD_CHAR, WORD_GAP

WINDOW = 5


def _adjacent_equal(items: Column, field: str) -> Column:
    """Those structs of a sorted array whose field equals that of a neighbour."""
    same = lambda a, b: F.coalesce(F.get(items, a)[field] == F.get(items, b)[field], F.lit(False))
    return F.filter(items, lambda x, k: same(k, k - 1) | same(k, k + 1))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of ``_measured`` with the id first."""
    return _measured(docs, F.col(id_col).alias("_key"), text_col).withColumnRenamed("_key", id_col)


def _measured(docs: DataFrame, key: Column, text_col: str) -> DataFrame:
    """_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_caps and n_bangs of every whole text.

    Repeated windows are found by sorting 64-bit hashes within the row; windows whose hashes repeat are then
    compared as text, so a collision cannot count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, n, hashes = F.col("_words"), F.col("n_words"), F.col("_hashes")
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    first = docs.select(
        key,
        F.array_remove(F.split(text, WORD_GAP), "").alias("_words"),
        with_word.alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_caps"),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_bangs"),
    )
    counted = first.select(
        "_key", "_words", "n_symbols", "n_caps", "n_bangs",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), (n - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    hashed = counted.withColumn("_hashes", F.when(n >= WINDOW, windows).otherwise(empty("bigint")))
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    sorted_ = hashed.withColumn("_sorted", F.when(repeats, pairs).otherwise(empty("struct<h:bigint,i:int>")))
    spelled = F.sort_array(
        F.transform(
            _adjacent_equal(F.col("_sorted"), "h"),
            lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, WINDOW), " ").alias("w"), x["i"].alias("i")),
        )
    )
    found = sorted_.withColumn("_spelled", spelled)
    starts = F.sort_array(F.transform(_adjacent_equal(F.col("_spelled"), "w"), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    # Not deterministic in name only: else a filter on a measurement would be moved below these projections,
    # and every step above written out inside the next one's lambda.
    covered = F.when(F.monotonically_increasing_id() >= 0, covered)
    return found.select(
        "_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered.cast("long").alias("n_repeat_words"), "n_caps", "n_bangs",
    )


@dataclass(frozen=True)
class Rule:
    """One failure condition, SQL over the measurements. Its place in the list of rules is its bit."""

    name: str
    fails: str


#: The rules of the production ledger. Bits are given once; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 and 20 * n_dup_lines > n_words"),
    Rule("word_length", "word_chars > 40 * n_words"),
    Rule("shouting", "100 * n_caps > 30 * word_chars"),
    Rule("exclamations", "100 * n_bangs > 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version: the rules that count, and how many of them a document may fail."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        place = {r.name: k for k, r in enumerate(rules)}
        return sum(1 << place[name] for name in self.rules)


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure_bits (bit k: rule k failed) of each row of docs."""
    return measure(docs, id_col, text_col).withColumn("failure_bits", failure_bits(rules))


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        failed = F.coalesce(F.expr(rule.fails), F.lit(False))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.bit_count(F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))) <= policy.allowed


def apply_policy(ledger_: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with policy_version and kept."""
    return ledger_.withColumns({"policy_version": F.lit(policy.version), "kept": passes(policy, rules)})


def accepted(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, that the policy keeps; they travel with their measurements,
    so nothing is joined."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_key")
    return _measured(docs, row, text_col).withColumn("failure_bits", failure_bits(rules)).filter(passes(policy, rules)).select("_key.*")


def ablation(ledger_: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per rule of the policy: documents that fail it, that fail it alone (and would be kept without
    it), and the bits that are ever and always set. Every count is one conditional sum over masked bits."""
    mask = F.lit(policy.mask(rules)).cast("long")
    seen = ledger_.select(F.col("failure_bits").bitwiseAND(mask).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    chosen = [(k, r.name) for k, r in enumerate(rules) if r.name in policy.rules]
    per_rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in chosen])).alias("r")
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    rejected = F.bit_count("b") > policy.allowed
    rescued = rejected & (F.bit_count(F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit")))) <= policy.allowed)
    return (
        seen.select("b", "n", per_rule)
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(rescued, F.col("n")).otherwise(0)).alias("n_only"),
            F.bit_or("b").alias("bits_ever"),
            F.bit_and("b").alias("bits_always"),
        )
    )
