"""Quality rules whose cutoffs are chosen under a guarantee on false rejections.

Each rule is a ratio of a document, high where it is bad. A document labelled good that a
rule would reject is a false rejection. For each stratum (a band of document lengths) and
rule, cutoffs are tried from lax to strict; a cutoff is certified when the exact binomial
test rejects "the rate of false rejections is over ``limit``" at its share of ``delta``
(Bonferroni over strata and rules; the cutoffs of one rule are tested in a fixed order that
stops at the first failure, which needs no further correction). The strictest certified
cutoff is used; a rule without one rejects nothing. A document is kept if it passes the
fixed base rules and every certified cutoff of its stratum.

Everything on the rows is built-in functions. Defined results: null and empty texts have no
words, so they fail the base rules; documents without a label, and labels without a
document, take no part in choosing; repeated rows are measured one by one; several labels
of one id count as bad unless all are good; without labels no rule rejects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import stored, table

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Share of the good documents of a stratum that one rule may reject, and the chance of being wrong about any of it.
LIMIT, DELTA = 0.005, 0.05
#: Upper ends of the bands of document length, in words.
BANDS = (150, 600, 2400)
#: Cutoffs tried for every rule, lax to strict, as parts of a thousand.
CUTOFFS = tuple(range(1000, 0, -25)) + (20, 15, 10, 5)


def _words(text: Column) -> Column:
    # A trimmed text has no empty word at either end; an empty one has a single empty word.
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS, -1))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, also where ``use`` names it inside a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words stand in a window of three that is found again in the same text.

    A window is one number: its place in as many low bits as the text needs, its hash in the
    rest. After sorting, equal windows are neighbours; the words are compared as well, so equal
    hashes of different windows don't count.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)

    def code(w: Column, i: Column, high: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))

    def covered(w: Column, codes: Column, high: Column) -> Column:
        at = lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")
        n = F.size(codes)

        def same(x: Column, y: Column) -> Column:
            i, j = at(x), at(y)
            words_equal = (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
            return (x.bitwiseAND(high) == y.bitwiseAND(high)) & words_equal

        found = F.filter(
            codes,
            lambda x, j: ((j + 1 < n) & same(x, F.get(codes, j + 1))) | ((j > 0) & same(x, F.get(codes, j - 1))),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(at(x), at(x) + 1, at(x) + 2)))))

    high = F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(F.size(words))))
    count = _bound(
        words,
        lambda w: _bound(
            high, lambda h: _bound(F.sort_array(F.transform(places, lambda i: code(w, i, h))), lambda c: covered(w, c, h))
        ),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(count).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts the rules use, for every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", _words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    text = F.col("text")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_shouted"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Name to parts of a thousand, each over the columns of ``measure``."""

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("int")

    return {
        "symbols": ratio("n_symbols", "word_chars"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeat_words": ratio("n_repeat_words", "n_words"),
        "shouted": ratio("n_shouted", "word_chars"),
        "long_words": F.when(F.col("n_words") > 0, F.least(F.lit(1000), F.floor(25 * F.col("word_chars") / F.col("n_words")))).otherwise(0).cast("int"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    return sum((F.when(F.col("n_words") > band, 1).otherwise(0) for band in BANDS), F.lit(0))


def binomial_tail(errors: int, n: int, rate: float) -> float:
    """P(X <= errors) for X binomial(n, rate), exact up to rounding."""
    if n <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(min(errors, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> dict[tuple[int, str], int]:
    """(stratum, rule) to the strictest certified cutoff. labels: doc_id, quality."""
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    )
    held = measured.join(good, "doc_id", "left_semi").where(~base_failed())
    named = rules()
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in named.items())))
    # How many good documents have each value: 4 strata x 5 rules x 1001 values at most, at any size.
    counts = held.select(stratum().alias("stratum"), values.alias("r")).groupBy("stratum", "r.rule", "r.value").count().collect()
    by: dict[tuple[int, str], dict[int, int]] = {}
    for row in counts:
        by.setdefault((row["stratum"], row["rule"]), {})[row["value"]] = row["count"]
    share = delta / ((len(BANDS) + 1) * len(named))
    out = {}
    for key, histogram in by.items():
        n = sum(histogram.values())
        for cutoff in CUTOFFS:
            errors = sum(c for v, c in histogram.items() if v >= cutoff)
            if errors >= limit * n or binomial_tail(errors, n, limit) > share:
                break
            out[key] = cutoff
    return out


def judge(measured: DataFrame, cutoffs: dict[tuple[int, str], int]) -> DataFrame:
    """``measured`` with base_failed, rejected_by (names of the rules) and kept."""
    named = rules()
    broken = [
        F.when((stratum() == band) & (named[rule] >= cutoff), F.lit(rule))
        for (band, rule), cutoff in sorted(cutoffs.items())
    ]
    rejected = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    out = measured.withColumns({"base_failed": base_failed(), "rejected_by": rejected})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op10_quality_rules(spark, sf_dir):
    measured = stored(measure(table(spark, sf_dir, "documents")), "rule-measures")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge(measured, certified(measured, labels))
