"""Substring search over an inverted index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions.kernels import let
from evigrid.plans.lineage import written

#: Grams of a term whose postings are looked up, the rarest ones.
PROBES = 6


def lower_each(text: Column) -> Column:
    """Lower case character by character: as many characters as before, whatever their neighbours.

    Whole-text rules make two characters of a dotted capital I and tell the sigma that ends a word.
    """
    return F.lower(F.translate(text, "İΣ", "iσ"))


def upper_each(text: Column) -> Column:
    """Upper case character by character; what has no capital of one character (ß gives SS) stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def grams(text: Column, sizes: tuple[int, ...] = (3,)) -> Column:
    """Distinct grams of these sizes of a text in lower case, by characters."""

    def of_size(c: Column, k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(c)), lambda i: F.concat(*(F.get(c, i + j) for j in range(k))))
        return F.filter(each, lambda g: F.length(g) == k)

    def of(c: Column) -> Column:
        return F.array_distinct(F.concat(*(of_size(c, k) for k in sizes)))

    return let(F.split(lower_each(text), ""), of)


def index(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index: ``(gram, id)``, written once; a posting for each distinct gram of one to three characters of a text."""
    rows = texts.select(F.col(id_col).alias("id"), F.explode(grams(F.col(text_col), (1, 2, 3))).alias("gram"))
    return written(rows.select("gram", "id"), "trigrams")


def candidates(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term_id, id)`` of the texts that have all the probed grams of a term; shorter terms are grams themselves.

    Only the rarest ``PROBES`` grams of a term are intersected, so that the postings read follow the
    rare ones; a gram that no text has ends its term. Counting is a partial aggregate.
    """
    own = F.when(F.length("term") >= 3, grams(F.col("term"))).otherwise(F.array(lower_each(F.col("term"))))
    asked = terms.select("term_id", F.explode(own).alias("gram"))
    known = asked.select("gram").distinct()
    often = postings.join(known, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    ranked = asked.join(often, "gram", "left").na.fill(0, ["often"])
    best = F.slice(F.array_sort(F.collect_list(F.struct("often", "gram"))), 1, PROBES)
    probes = ranked.groupBy("term_id").agg(best.alias("p")).where("p[0].often > 0")
    wanted = probes.select("term_id", F.size("p").alias("n"), F.explode("p.gram").alias("gram"))
    hits = wanted.join(postings, "gram").groupBy("term_id", "id", "n").agg(F.count("*").alias("m"))
    return hits.where("m = n").select("term_id", "id")


def search(texts: DataFrame, id_col: str, text_col: str, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term_id, id)`` of all texts that contain a term, whatever the case; ``terms`` has ``term_id, term``.

    What the index finds is verified on the text. Null texts and terms, and empty terms, match nothing.
    """
    one = texts.select(F.col(id_col).alias("id"), lower_each(F.col(text_col)).alias("text"))
    given = terms.select("term_id", lower_each(F.col("term")).alias("term")).where("term <> ''")
    return candidates(postings, given).join(given, "term_id").join(one, "id").where(F.contains("text", F.col("term"))).select("term_id", "id")
