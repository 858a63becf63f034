"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule compares one ratio of a document with a cutoff. The cutoffs of all rules move
together from loose to strict in fixed steps, the *levels*; a document falls at the first level
at which any rule rejects it. For each stratum (the language) the levels are tried in order on
its labelled good documents: a level is allowed while an exact binomial bound shows that all
rules together reject at most ``risk`` of them. Levels are a fixed sequence that ends with the
first one not shown, so they need no correction among themselves; strata share ``delta``
(Bonferroni). With probability ``1 - delta`` no stratum loses more than ``risk`` of its good
documents to the rules. A stratum without an allowed level rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.plans.lineage import written

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Rule -> (ratio over the counts below, its loosest and its strictest cutoff).
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / word_chars", 0.4, 0.001),
    "dup_lines": ("n_dup_lines / n_words", 0.3, 0.002),
    "echoes": ("n_echo_words / n_words", 0.8, 0.01),
    "word_length": ("word_chars / n_words", 12.0, 5.0),
}
LEVELS = 32
RISK, DELTA = 0.01, 0.05
#: Strata whose levels are broadcast, at most.
MOST_STRATA = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more: equal hashes are neighbours once sorted."""

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, zero, step)["n"]

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(placed), of_sorted)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, the columns of ``COUNTS`` and ``n_echo_words`` (words equal to the one
    before); a null text has no words, lines or symbols.

    ``explode`` of a one-element array holds a computed array fixed, so that the
    expressions over it do not each split the text again.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", F.explode(F.array(F.array_remove(F.split(whole, BLANK + "+"), ""))).alias("_words"))
    w = F.col("_words")
    ends = F.size(w) - WINDOW + 1
    hashes = F.when(
        ends > 1,
        F.transform(F.sequence(F.lit(1), F.greatest(ends, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", F.explode(F.array(hashes)).alias("_hashes"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w, F.col("_hashes")).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_echo_words"),
    )


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms; for k <= n p."""
    import math

    odds = math.log(p / (1 - p))
    first = n * math.log(1 - p)
    zero = F.struct(first.alias("l"), F.exp(first).alias("s"))

    def step(a: Column, i: Column) -> Column:
        x = a["l"] + F.log((n - i + 1) / i) + odds
        return F.struct(x.alias("l"), (a["s"] + F.exp(x)).alias("s"))

    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), zero, step)["s"]).otherwise(F.exp(first))


def cutoffs(rule: str) -> list[float]:
    """Of each level, loose to strict, in equal ratios."""
    _, loose, strict = RULES[rule]
    return [round(loose * (strict / loose) ** (i / (LEVELS - 1)), 6) for i in range(LEVELS)]


def fall() -> Column:
    """The first level at which a rule rejects the document; ``LEVELS``: none does."""

    def first(rule: str) -> Column:
        ratio = F.expr(RULES[rule][0])
        return F.size(F.filter(F.array(*map(F.lit, cutoffs(rule))), lambda c: c >= ratio))

    return F.when(F.col("n_words") > 0, F.least(*map(first, RULES))).otherwise(LEVELS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def allowed(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, level)``: the strictest allowed level of each stratum that has one.

    ``counted`` has ``doc_id``, ``stratum``, the counts and ``fall``. ``labels`` has ``doc_id`` and
    ``quality``; null labels are left out, and a document with several labels is good if one of
    them says so. Documents that the base rule rejects take no part: the bound is on what the
    method itself rejects.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1")
    rows = counted.where(~base_failed()).select("doc_id", "stratum", "fall").join(good, "doc_id", "left_semi")
    n = rows.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col("fall") <= i).alias(f"k{i}") for i in range(LEVELS)))
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k")) for i in range(LEVELS))))
    share = delta / F.count("*").over(Window.partitionBy("level"))  # a row a stratum in each level
    tried = n.select("stratum", "n", each).withColumn("share", share)
    # Stricter levels reject no less, so what holds at a level holds at all looser ones.
    held = tried.where((F.col("k") <= F.col("n") * risk) & (_tail(F.col("n"), F.col("k"), risk) <= F.col("share")))
    return held.groupBy("stratum").agg(F.max("level").alias("level"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``(row, *COUNTS, base_failed, kept)`` of every row: ``row`` is a struct of the columns named
    in ``keep`` (all by default), whatever their names.

    ``docs`` needs ``doc_id``, ``text`` and the stratum. A null text has no words, lines or symbols
    and fails the base rule, as an empty one does; very long texts are counted whole. A null
    stratum counts as an empty one; a stratum without enough good labels rejects nothing. Empty tables
    give empty results; repeated rows are judged alike; null ids have no label.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (keep or docs.columns)))
    own = docs.select(row.alias("row"), "doc_id", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), "text")
    counted = written(with_counts(own).drop("text").withColumn("fall", fall()), "counted")
    levels = written(allowed(counted, labels, risk, delta), "levels")
    if levels.count() <= MOST_STRATA:  # a number each; else the join is a shuffled one
        levels = F.broadcast(levels)
    failed = base_failed()
    found = counted.join(levels, "stratum", "left")
    return found.select("row", *COUNTS, failed.alias("base_failed"), (~failed & ~F.coalesce(F.col("fall") <= F.col("level"), F.lit(False))).alias("kept"))
