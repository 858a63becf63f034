"""Decision rules over scored pairs, and which of their proposals wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of several proposals the most cautious wins.
PRIORITY = ("reject", "queue_review", "promote", "auto_merge")
MERGE_FROM, REVIEW_FROM = 0.90, 0.50

Rule = Callable[[], tuple[str, Column, Column]]
_rules: dict[str, Rule] = {}


def rule(f: Rule) -> Rule:
    """Registers a rule: it gives (kind, condition, reason)."""
    _rules[f.__name__] = f
    return f


@rule
def high_confidence_auto_merge() -> tuple[str, Column, Column]:
    hit = (F.col("score") >= MERGE_FROM) & (F.col("decisive_tier") == 1)
    return "auto_merge", hit, F.lit("tier 1 and a score of 0.90 or more")


@rule
def review_band() -> tuple[str, Column, Column]:
    return "queue_review", (F.col("score") >= REVIEW_FROM) & (F.col("score") < MERGE_FROM), F.lit("score from 0.50 to below 0.90")


@rule
def watchlist_hit() -> tuple[str, Column, Column]:
    return "queue_review", F.coalesce(F.col("on_watchlist"), F.lit(False)), F.lit("an entity is on a watchlist")


@rule
def no_overlap_promotion() -> tuple[str, Column, Column]:
    return "promote", (F.col("n_entities") == 0) & (F.col("n_evidence") > 0), F.lit("evidence without a shared entity")


def with_unmatched(pairs: DataFrame, draft: DataFrame) -> DataFrame:
    """``pairs`` and a row for each draft identity that is in none: no known identity, no entity, a score of
    0 and its pieces of evidence. ``draft`` has ``identity`` and ``evidence_id``."""
    own = draft.groupBy(F.col("identity").alias("draft")).agg(F.countDistinct("evidence_id").alias("n_evidence"))
    alone = own.join(pairs.select("draft"), "draft", "left_anti").withColumns({"score": F.lit(0.0), "n_entities": F.lit(0).cast("long")})
    return pairs.unionByName(alone, allowMissingColumns=True)


def proposals(pairs: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each rule that fires. A rule whose condition is null does not."""
    rules = _ranked(names)
    each = pairs.where(_any(rules)).select("*", F.explode(F.array(*map(F.lit, range(len(rules))))).alias("_rule"))
    at = each.where(_any([(*r[:2], r[2] & (F.col("_rule") == k), r[3]) for k, r in enumerate(rules)]))
    return at.select(*pairs.columns, *_fields(rules, [F.col("_rule") == k for k in range(len(rules))]))


def _ranked(names: tuple[str, ...] | None) -> list[tuple[str, str, Column, Column]]:
    """``(rule_id, kind, condition, reason)`` in the order in which one wins over another: of a pair all have
    one score, so that is by caution, then name."""
    found = [(n, *_rules[n]()) for n in names or tuple(_rules)]
    return sorted(found, key=lambda r: (PRIORITY.index(r[1]), r[0]))


def _any(rules: list[tuple[str, str, Column, Column]]) -> Column:
    """Whether a rule fires."""
    out = F.lit(False)
    for _, _, hit, _ in rules:
        out = out | F.coalesce(hit, F.lit(False))
    return out


def _fields(rules: list[tuple[str, str, Column, Column]], when: list[Column]) -> list[Column]:
    """``priority, rule_id, kind, reason`` of the first rule whose ``when`` holds."""
    out = {c: F for c in ("priority", "rule_id", "kind", "reason")}
    for (name, kind, _, reason), hit in zip(rules, when):
        for c, v in (("priority", F.lit(PRIORITY.index(kind))), ("rule_id", F.lit(name)), ("kind", F.lit(kind)), ("reason", reason)):
            out[c] = out[c].when(hit, v)
    return [v.alias(c) for c, v in out.items()]


def decided(pairs: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The winning proposal of each pair for which a rule fires, chosen inside the row: ``pairs`` has a
    row a pair. As ``resolved(proposals(pairs))``, without its shuffle and sort."""
    rules = _ranked(names)
    won = dict(zip(("priority", "rule_id", "kind", "reason"), _fields(rules, [hit for _, _, hit, _ in rules])))
    return pairs.where(_any(rules)).select(*pairs.columns, *(won[c] for c in ("rule_id", "kind", "priority", "reason")))


def resolved(proposed: DataFrame, keys: tuple[str, ...] = ("draft", "known")) -> DataFrame:
    """The winning proposal of each pair: by caution, then score, then rule name."""
    w = Window.partitionBy(*keys).orderBy("priority", F.desc("score"), "rule_id")
    return proposed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def marked(draft: DataFrame, watchlist: DataFrame) -> DataFrame:
    """``draft`` with ``listed``: whether its value is on the list, in any case. The mark goes through
    ``correlate.scores`` as ``on_watchlist``, so that the pairs are made once."""
    values = watchlist.select(F.lower(F.trim("value")).alias("_v")).distinct().withColumn("listed", F.lit(True))
    return draft.join(values, F.lower(F.trim("value")) == F.col("_v"), "left").drop("_v").withColumn("listed", F.coalesce("listed", F.lit(False)))


def on_watchlist(matched: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Pairs with a matched value on the list: ``(draft, known, on_watchlist)``."""
    hits = matched.join(watchlist.select(F.lower("value").alias("value")).distinct(), "value", "left_semi")
    return hits.select("draft", "known").distinct().withColumn("on_watchlist", F.lit(True))
