"""Quality rules as a ledger of failure bits.

measure() and ledger() look at each text once and keep, per document, the
measurements and one bit per failed rule. Policies are versioned sets of rules:
a verdict is `failed_rules & mask == 0`, so a new policy or an ablation reads
the ledger and never the texts. Everything is a column expression.

Defined results: a null or empty text has no words, every count is 0 and it
fails `few_words`; repeated rows are judged alike, one result row each; a very
long text is measured whole; null ids stay null; an empty table gives an empty ledger; input columns whose names clash
with measurements are not read and not returned by ledger().
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.text import trimmed, whole, words_of_trimmed
from pointloom.scratch import fresh

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"

#: Rules in bit order: name -> condition under which a document fails, on the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "symbol_ratio": "4 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "2 * word_chars < 3 * n_words",
    "long_words": "word_chars > 30 * n_words",
}
#: Version -> the rules that it applies. Published versions are never edited.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_trigrams"),
    "web-1": ("few_words", "repeated_trigrams", "symbol_ratio", "duplicate_lines"),
    "web-2": tuple(RULES),
}
PRODUCTION = "web-2"


def mask_of(rules: Sequence[str], order: Mapping[str, str] = RULES) -> int:
    at = {name: k for k, name in enumerate(order)}
    return sum(1 << at[name] for name in rules)


def measure(docs: DataFrame, text: str = "text", into: str = "measured") -> DataFrame:
    """docs with a struct column of measurements. Each step is a projection of its own, so shared arrays are made once."""
    keep = docs.columns
    t, w, lines, tri, order, hit = (fresh(keep, f"__{x}") for x in ("text", "words", "lines", "tri", "order", "hit"))
    df = docs.withColumn(t, whole(text)).withColumn(w, words_of_trimmed(trimmed(F.col(t))))
    df = df.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: trimmed(x) != ""))
    # hash of the three words from each position on; positions that begin no window are cut off
    df = df.withColumn(tri, F.slice(F.transform(F.col(w), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    again = F.size(F.array_distinct(F.col(tri))) < F.size(tri)
    df = df.withColumn(order, F.when(again, F.sort_array(F.transform(F.col(tri), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col(order), j)["h"], F.lit(False))
    df = df.withColumn(hit, F.filter(F.col(order), lambda x, j: same(x, j - 1) | same(x, j + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.col(hit), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    n = F.size(w).cast("long")
    return df.withColumn(
        into,
        F.struct(
            n.alias("n_words"),
            F.char_length(F.array_join(F.col(w), "")).cast("long").alias("word_chars"),
            F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
            F.when(F.col(hit).isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        ),
    ).select(*keep, into)


def failure_bits(measured: str, rules: Mapping[str, str] = RULES) -> Column:
    """One bit per failed rule; conditions name fields of the struct column."""
    fields = {x: f"`{measured}`.{x}" for x in (*MEASURES, "n_lines")}
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        said = " ".join(fields.get(x, x) for x in condition.split())
        bits = bits.bitwiseOR(F.when(F.expr(said), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, measurements, failed_rules), one row for each input row."""
    df = measure(docs.select(F.col(id_col), F.col(text)), text, "measured")
    return df.select(id_col, "measured.*", failure_bits("measured", rules).alias("failed_rules"))


def verdict(bits: Column | str, policy: str | Sequence[str] = PRODUCTION, rules: Mapping[str, str] = RULES) -> Column:
    """True where no rule of the policy has failed."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) == 0


def ablations(book: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per policy and rule: rejected by the policy, failing the rule, and rejected by this rule alone.

    The ledger is first counted by its bit pattern, of which there are at most
    2^rules whatever the corpus; the rest is bitwise arithmetic on those counts.
    """
    patterns = book.groupBy("failed_rules").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(mask_of(names, rules)).cast("long").alias("mask"), F.lit(mask_of([r], rules)).cast("long").alias("bit")) for v, names in policies.items() for r in names]
    seen = F.col("failed_rules").bitwiseAND(F.col("r.mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    return (
        patterns.withColumn("r", F.explode(F.array(*rows)))
        .groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule"))
        .agg(total(seen != 0).alias("rejected"), total(seen.bitwiseAND(F.col("r.bit")) != 0).alias("failing"), total(seen == F.col("r.bit")).alias("only_this_rule"))
    )


def keep_good(docs: DataFrame, policy: str | Sequence[str] = PRODUCTION, text: str = "text") -> DataFrame:
    """The documents that pass the policy, with their own columns.

    The measurements go through explode() as an array of one: a filter on what it
    gives isn't pushed under the steps of measure(), which would do them again
    for every element of their arrays.
    """
    into = fresh(docs.columns, "__measured")
    once = fresh([*docs.columns, into], "__once")
    judged = measure(docs, text, into).withColumn(once, F.explode(F.array(into)))
    return judged.where(verdict(failure_bits(once), policy)).select(*docs.columns)
