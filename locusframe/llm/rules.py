"""Quality rules as a bitmask ledger.

Every rule is measured once per document. The ledger stores the measurements and,
bit by bit, which rules failed; a policy is a versioned set of bits, so that another
policy, or an ablation that leaves one rule out, needs bit operations only and never
the texts again. All expressions are built-in functions; the ledger is a projection
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over the measurements; null counts as passed."""

    name: str
    bit: int
    fails: str


#: Fixed numbers of the rules; a rule's bit never changes, new rules get new bits.
RULES = (
    Rule("too_few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
    Rule("stub_lines", 6, "n_lines >= 10 and n_words < 2 * n_lines"),
)
BASE = ("too_few_words", "repeated_windows")

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
    "v3": tuple(r.name for r in RULES),
}


def mask_of(names, rules=RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def _repeated(words: Column, window: int) -> Column:
    """How many words lie in a ``window``-word window that occurs twice or more.

    Windows are named by hash and sorted with their positions; equal neighbours are
    repeats. Covered words are summed over the starts in order, each start adding
    what lies before the next one.
    """
    names = F.transform(
        F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("i")),
    )
    order = F.sort_array(names)
    starts = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"])
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x
    )
    # a one-element transform binds a value once, where an expression would be evaluated at each use
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(order, lambda s: bind(starts(s), covered)).cast("long")


def ledger(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules=RULES, window: int = 5) -> DataFrame:
    """One row per row of ``docs``: the keys, the measurements, ``failures`` (long bits).

    A null or empty text has no words: all counts are 0 and ``too_few_words`` fails.
    Rows are judged one by one, so repeated rows and null keys stay as they are; an
    empty table gives an empty ledger; other columns of ``docs`` are not read.
    """
    d = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # a generated row is computed once: a filter on a verdict is not pushed below it, where
    # every use of a measurement would be evaluated anew
    once = lambda **cols: F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    d = d.select(
        *keys,
        "_text",
        once(
            _words=F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""),
            _lines=F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
        ),
    )
    d = d.select(
        *keys,
        once(
            n_words=F.size("_words").cast("long"),
            word_chars=F.length(F.translate("_text", BLANKS, "")).cast("long"),
            n_symbols=(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            n_lines=F.size("_lines").cast("long"),
            n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            n_repeat_words=_repeated(F.col("_words"), window),
        ),
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return d.withColumn("failures", failures)


def apply_policy(led: DataFrame, policy: str = "v2", rules=RULES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``, by bit operations alone."""
    base, own = mask_of(BASE, rules), mask_of(POLICIES[policy], rules)
    return led.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(base)) != 0).withColumn("kept", F.col("failures").bitwiseAND(F.lit(base | own)) == 0)


def ablations(led: DataFrame, policy: str = "v2", rules=RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that only it rejects.

    The ledger is first reduced to a row per distinct bit pattern (partial sums on
    each executor), so what is shuffled does not depend on the number of documents.
    """
    names = [r for r in rules if r.name in POLICIES[policy]]
    mask = mask_of(POLICIES[policy], rules)
    patterns = led.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("p")).agg(F.count("*").alias("n"))
    per = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in names]))
    x = patterns.select("p", "n", per.alias("r")).select("p", "n", "r.*")
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("p").bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("p") == F.col("b"), F.col("n")).otherwise(0)).alias("only_by_this"),
        F.sum(F.when(F.col("p").bitwiseAND(F.bitwise_not("b")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs``, all columns, that the policy keeps.

    The verdict is computed beside the columns under a name that ``docs`` does not
    have, so no join is needed and repeated rows stay repeated.
    """
    own = "_row"
    while own in docs.columns:
        own += "_"
    packed = docs.select(F.struct(*docs.columns).alias(own), F.col("text").alias("text"))
    led = apply_policy(ledger(packed, keys=(own,)), policy)
    return led.where("kept").select(f"{own}.*")
