"""Quality rules as a bitmask ledger, on SQL functions only.

Every rule is evaluated once per document.  The ledger row holds the
measurements and one ``long`` whose bit ``i`` says that rule ``i`` failed.
Policies are versioned masks over those bits, so trying another policy, or
asking what a single rule costs, is a bitwise pass over the narrow ledger and
never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleselect.llm.common import crc32_utf8

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""
    name: str
    bit: int
    fails: str


RULES = [
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_density", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("exclamations", 5, "10 * n_exclaims > 5 * n_words"),
    Rule("digits", 6, "100 * n_digits > 40 * word_chars"),
]


@dataclass(frozen=True)
class Policy:
    """A document is kept when at most ``allowed`` of the rules named fail."""
    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules: list[Rule]) -> int:
        bits = {r.name: r.bit for r in rules}
        return reduce(lambda m, n: m | (1 << bits[n]), self.rules, 0)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = [
    BASE,
    Policy("v1", ("few_words", "repeated_windows", "symbol_density", "repeated_lines")),
    Policy("v2", tuple(r.name for r in RULES)),
]


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, text_crc32`` and the measurements.

    ``n_repeat_words`` is the number of words covered by 8-word windows that
    occur twice or more in the text.  Windows are compared by a 64-bit hash
    of their words.  The windows of a text are numbered in place, sorted by
    hash, and the starts of the repeated ones merged, so the cost is
    ``n log n`` in the text's length; texts without a repeated window stop at
    a hash-set size.  A null text has no words; extra columns are ignored.
    """
    w = WINDOW_WORDS
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.select("doc_id", "t", F.array_remove(F.split("t", SPACE_RUN), "").alias("words"),
                 F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"))
    t = t.select(
        "doc_id", crc32_utf8(F.col("t")).alias("text_crc32"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _count_chars(F.col("t"), SYMBOLS).alias("n_symbols"),
        _count_chars(F.col("t"), "!").alias("n_exclaims"),
        _count_chars(F.col("t"), "0123456789").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("wh"))
    keep = [c for c in t.columns if c != "wh"]
    t = t.select(*keep, F.when(F.col("n_words") >= w, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("wh") - w, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(w)])))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    # (hash, start) pairs in hash order, only where some window occurs twice
    t = t.select(*keep, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    t = t.select(*keep, F.when(F.col("s").isNotNull(), F.sort_array(F.filter(F.transform(
        "s", lambda e, k: F.when((F.get("s", k - 1)["x"] == e["x"]) | (F.get("s", k + 1)["x"] == e["x"]), e["i"])),
        lambda i: i.isNotNull()))).alias("starts"))
    return t.select(*keep, F.when(F.col("starts").isNull(), F.lit(0)).otherwise(
        F.aggregate(F.transform("starts", lambda x, k: F.when(k == 0, F.lit(w)).otherwise(
            F.least(F.lit(w), x - F.get("starts", k - 1)))), F.lit(0), lambda a, x: a + x)
    ).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Measurements plus ``failed``: bit ``rule.bit`` is set where it fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return measure(docs).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def verdict(policy: Policy, rules: list[Rule] = RULES, failed: str = "failed") -> Column:
    """True where the policy keeps the document."""
    return F.bit_count(F.col(failed).bitwiseAND(F.lit(policy.mask(rules)).cast("long"))) <= policy.allowed


def ablation(led: DataFrame, policies: list[Policy] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """For each policy and rule: documents dropped by the policy, documents
    on which the rule fails, and documents that only this rule drops (kept if
    the rule were taken out).  One pass: the ledger is first reduced to
    counts per distinct bitmask, of which there are at most ``2 ** rules``.
    An empty ledger gives no rows.
    """
    masks = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p.version, r.name, p.mask(rules), 1 << r.bit, p.allowed)
            for p in policies for r in rules if r.name in p.rules]
    # one entry per policy and rule: a constant of the configuration
    both = masks.withColumn("p", F.explode(F.array(*[F.struct(
        F.lit(v).alias("version"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("mask"),
        F.lit(b).cast("long").alias("bit"), F.lit(a).alias("allowed")) for v, n, m, b, a in rows])))
    both = both.select("failed", "n", "p.*")
    hit = F.bit_count(F.col("failed").bitwiseAND(F.col("mask")))
    rest = F.bit_count(F.col("failed").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not("bit")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return both.groupBy("version", "rule").agg(
        total(hit > F.col("allowed")).alias("policy_dropped"),
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("rule_failed"),
        total((hit > F.col("allowed")) & (rest <= F.col("allowed"))).alias("only_this_rule"))
