"""Validation and set-based ingestion of evidence envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.functions.normalize import normalize
from evigrid.plans.lineage import partitions

# The vocabularies of entity and relationship types.
ENTITY_TYPES = (
    "email", "username", "phone", "domain", "ip", "ipv4", "ipv6", "url", "wallet", "btc", "eth", "hash",
    "md5", "sha1", "sha256", "cve", "asn", "mac", "iban", "vat", "user_agent", "certificate", "person",
    "company", "image",
)
RELATIONSHIP_TYPES = (
    "owns", "uses", "same_person", "hosted_on", "resolves_to", "registered_by", "links_to", "mentions",
    "verified_by", "compromised_in", "found_alongside", "rotates_to", "redirects_to", "same_as", "member_of",
    "employed_at", "located_in",
)
MAX_ENTITIES, MAX_OBSERVATIONS, MAX_RELATIONSHIPS = 500, 1000, 200
FUTURE_SKEW = "INTERVAL 5 MINUTES"


def error(path: Column, message: str, code: str) -> Column:
    return F.struct(path.alias("path"), F.lit(message).alias("message"), F.lit(code).alias("code"))


def _when(cond: Column, path: Column | str, message: str, code: str) -> Column:
    return F.when(cond, error(F.lit(path) if isinstance(path, str) else path, message, code))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _out_of_range(c: Column) -> Column:
    return F.coalesce((c < 0) | (c > 1), F.lit(True))


def _each(items: Column, checks) -> Column:
    """All errors of all items of an array; ``checks(item, index)`` gives expressions."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda e, i: F.array_compact(F.array(*checks(e, i)))))


def validated(envelopes: DataFrame, now: Column) -> DataFrame:
    """Adds ``errors`` (all of them, with their paths), ``warnings`` and ``is_valid``."""

    def entity(e: Column, i: Column) -> list[Column]:
        at = lambda f: F.format_string(f"entities[%d].{f}", i)
        return [_when(~F.coalesce(F.lower(e["type"]).isin(*ENTITY_TYPES), F.lit(False)), at("type"), "unknown entity type", "unknown_type"), _when(_blank(e["raw_value"]), at("raw_value"), "value is empty", "empty"), _when(_out_of_range(e["confidence"]), at("confidence"), "confidence is not in 0..1", "range")]

    def relation(r: Column, i: Column) -> list[Column]:
        at = lambda f: F.format_string(f"relationships[%d].{f}", i)
        known = F.coalesce(r["relationship_type"].isin(*RELATIONSHIP_TYPES) | r["relationship_type"].startswith("x-"), F.lit(False))
        ends = ("source_entity_type", "source_entity_value", "target_entity_type", "target_entity_value")
        loop = (F.lower(r["source_entity_type"]) == F.lower(r["target_entity_type"])) & (F.lower(r["source_entity_value"]) == F.lower(r["target_entity_value"]))
        return [_when(~known, at("relationship_type"), "unknown relationship type", "unknown_type"), *(_when(_blank(r[f]), at(f), "end is missing", "empty") for f in ends), _when(loop, F.format_string("relationships[%d]", i), "relationship to itself", "self_loop"), _when(_out_of_range(r["confidence"]), at("confidence"), "confidence is not in 0..1", "range")]

    def observation(o: Column, i: Column) -> list[Column]:
        at = lambda f: F.format_string(f"observations[%d].{f}", i)
        return [_when(_blank(o["observation_type"]), at("observation_type"), "type is empty", "empty"), _when(_blank(o["value"]), at("value"), "value is empty", "empty"), _when(_out_of_range(o["confidence"]), at("confidence"), "confidence is not in 0..1", "range")]

    uuid = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
    top = [
        _when(F.coalesce(F.col("schema_version") != 1, F.lit(True)), "schema_version", "schema_version must be 1", "version"),
        *(_when(_blank(F.col(c)), c, "field is required", "required") for c in ("plugin_id", "plugin_version", "target", "target_type")),
        _when(F.col("executed_at").isNull(), "executed_at", "field is required", "required"),
        _when(F.col("executed_at") > now + F.expr(FUTURE_SKEW), "executed_at", "time is in the future", "future"),
        _when(F.col("investigation_id").isNotNull() & ~F.col("investigation_id").rlike(uuid), "investigation_id", "not a UUID", "uuid"),
        _when(_out_of_range(F.col("confidence")), "confidence", "confidence is not in 0..1", "range"),
        *(_when(F.size(c) > n, c, f"more than {n}", "cap") for c, n in (("entities", MAX_ENTITIES), ("observations", MAX_OBSERVATIONS), ("relationships", MAX_RELATIONSHIPS))),
    ]
    errors = F.concat(
        F.array_compact(F.array(*top)), _each(F.col("entities"), entity),
        _each(F.col("relationships"), relation), _each(F.col("observations"), observation),
    )
    linked = lambda o, i: [_when(o["linked_entity_value"].isNotNull() & ~F.exists(F.coalesce(F.col("entities"), F.array()), lambda e: (F.lower(e["type"]) == F.lower(o["linked_entity_type"])) & (F.lower(e["raw_value"]) == F.lower(o["linked_entity_value"]))), F.format_string("observations[%d].linked_entity_value", i), "no such entity", "unlinked")]
    return envelopes.withColumn("errors", errors).withColumn("warnings", _each(F.col("observations"), linked)).withColumn("is_valid", F.size("errors") == 0)


def sanitized(envelopes: DataFrame) -> DataFrame:
    """Trimmed strings, a lower-case target type, and normal forms of all entities."""
    entity = lambda e: e.withField("type", F.lower(F.trim(e["type"]))).withField("normalized_value", normalize(e["type"], e["raw_value"], native=True))
    return envelopes.withColumns({"entities": F.transform("entities", entity), "target": F.trim("target"), "target_type": F.lower(F.trim("target_type"))})


def new_only(evidence: DataFrame, stored: DataFrame | None = None, keys: tuple[str, ...] = ("execution_id", "plugin_id"), order: str = "evidence_id") -> DataFrame:
    """Idempotent delivery: the first row of each key that is not stored yet."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = evidence.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first if stored is None else first.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def entity_id(kind: Column, value: Column) -> Column:
    """Ids from content: retries and replays give the same ones."""
    return F.sha2(F.concat_ws("\x01", kind, value), 256)


LINK = ("type", "normalized_value", "investigation_id")


def new_links(seen: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Links of entities to investigations that the link table does not have yet; a null investigation links nothing."""
    now = seen.where("investigation_id IS NOT NULL").select(*LINK).distinct()
    return now if links is None else now.join(links.select(*LINK), list(LINK), "left_anti")


def upserted_entities(seen: DataFrame, stored: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """``(type, normalized_value, raw_value, first_seen, last_seen, source_count, investigation_count)``.

    ``seen`` has ``type, normalized_value, raw_value, seen_at, investigation_id, seq``. With ``stored``,
    sources add up and the range of times grows; the stored raw value stays. An investigation counts
    only when it is first linked: ``fresh`` are the links that the store's link table did not have
    (``new_links``), and no others add to its count.
    """
    keys = ("type", "normalized_value")
    now = seen.groupBy(*keys).agg(
        F.min_by("raw_value", "seq").alias("raw_value"), F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"), F.count("*").alias("source_count"),
        F.countDistinct("investigation_id").alias("investigation_count"),
    )
    if stored is None:
        return now
    if fresh is None:
        raise ValueError("a store that has entities has links: give those that are new")
    none = F.lit(0).cast("long")
    linked = fresh.groupBy(*keys).agg(F.count("*").alias("investigation_count"))
    rows = stored.select(*now.columns, F.lit(0).alias("age")).unionByName(now.drop("investigation_count").withColumns({"investigation_count": none, "age": F.lit(1)}))
    rows = rows.unionByName(linked.withColumn("age", F.lit(2)), allowMissingColumns=True)
    return rows.groupBy(*keys).agg(
        F.min_by("raw_value", F.when(F.col("age") < 2, F.col("age"))).alias("raw_value"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("source_count").alias("source_count"),
        F.sum("investigation_count").alias("investigation_count"),
    )


def ingested(seen: DataFrame, stored: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The entities and the link table after one more batch; both are to be written before the next one."""
    fresh = new_links(seen, links)
    return upserted_entities(seen, stored, fresh), fresh if links is None else links.select(*LINK).unionByName(fresh)


def upserted_relationships(seen: DataFrame) -> DataFrame:
    """One row per (source, target, type): the highest confidence, the range of times."""
    return seen.groupBy("source_id", "target_id", "relationship_type").agg(
        F.max("confidence").alias("confidence"), F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"), F.count("*").alias("n_seen"),
    )


def provenance(seen: DataFrame) -> DataFrame:
    """One row per (relationship, evidence), with the first observation that has an id."""
    return seen.groupBy("relationship_id", "evidence_id").agg(
        F.min_by("observation_id", F.when(F.col("observation_id").isNotNull(), F.col("seq"))).alias("observation_id")
    )


# Failures that no retry mends, and those that one may.
STRUCTURAL = ("AdapterError", "ValidationError", "KeyError", "AttributeError", "TypeError", "ValueError")
TRANSIENT = (
    "TimeoutError", "asyncio.TimeoutError", "ClientConnectorError", "ClientResponseError", "ClientError",
    "ConnectionError", "OSError", "ServerDisconnectedError",
)
TRANSIENT_STATUS = (429, 500, 502, 503, 504)


def failure_class(kind: Column, status: Column) -> Column:
    return F.when(kind.isin(*STRUCTURAL), "structural").when(kind.isin(*TRANSIENT), "transient").when(status.isin(*TRANSIENT_STATUS), "transient").otherwise("structural")


def quarantined(failures: DataFrame, threshold: int = 3, hours: int = 24) -> DataFrame:
    """``(plugin_id, quarantined_at, n_failures)``: when structural failures within the window first
    reached the threshold. The state is sticky: only that first time matters."""
    w = Window.partitionBy("plugin_id").orderBy(F.col("failed_at").cast("timestamp").cast("long")).rangeBetween(-hours * 3600, 0)
    return failures.withColumn("n", F.count("*").over(w)).groupBy("plugin_id").agg(
        F.min(F.when(F.col("n") >= threshold, F.col("failed_at"))).alias("quarantined_at"),
        F.max("n").alias("n_failures"),
    ).where("quarantined_at IS NOT NULL")


def evidence_records(envelopes: DataFrame) -> DataFrame:
    """One row of evidence for each envelope; where it comes from is what its first entry of ``evidence`` says."""
    first = F.get("evidence", 0)
    kept = ("evidence_id", "investigation_id", "plugin_id", "plugin_version", "execution_id", "target")
    return envelopes.select(
        *kept, F.coalesce("raw", F.lit("{}")).alias("raw"), first["source_url"].alias("source_url"),
        first["source_reliability"].alias("source_reliability"),
    )


def observation_id(evidence: Column, place: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", evidence.cast("string"), place.cast("string")), 256)


def observation_records(envelopes: DataFrame) -> DataFrame:
    """Every observation with its place in the envelope, which is part of its id."""
    each = envelopes.select("evidence_id", F.posexplode("observations").alias("place", "o"))
    return each.select(
        observation_id(F.col("evidence_id"), F.col("place")).alias("observation_id"), "evidence_id", "place",
        "o.observation_type", "o.value", "o.confidence",
    )


def entity_observations(envelopes: DataFrame) -> DataFrame:
    """``(entity_id, observation_id)``: an entity belongs to the observation at its own place, if there is
    one; entities without a normal form have none. Each link once."""
    pairs = envelopes.select("evidence_id", F.size(F.coalesce("observations", F.array())).alias("n"), F.posexplode("entities").alias("place", "e"))
    good = pairs.where("place < n AND trim(coalesce(e.normalized_value, '')) <> ''")
    return good.select(
        entity_id(F.col("e.type"), F.col("e.normalized_value")).alias("entity_id"),
        observation_id(F.col("evidence_id"), F.col("place")).alias("observation_id"),
    ).distinct()


def linked_observations(envelopes: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_id, observation_id)`` by what observations themselves name: type, and value without case
    and outer blanks. ``entities`` has ``entity_id, type, normalized_value``; what names none has no link."""
    each = envelopes.select("evidence_id", F.posexplode("observations").alias("place", "o"))
    named = each.select(
        observation_id(F.col("evidence_id"), F.col("place")).alias("observation_id"),
        F.col("o.linked_entity_type").alias("type"),
        F.lower(F.trim("o.linked_entity_value")).alias("normalized_value"),
    )
    return named.join(entities, ["type", "normalized_value"]).select("entity_id", "observation_id").distinct()


def completed_ends(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities`` (``type, normalized_value``) and the ends of relationships that are missing there."""
    ends = [relationships.select(F.col(f"{e}_type").alias("type"), F.col(f"{e}_value").alias("normalized_value")) for e in ("source", "target")]
    new = ends[0].union(ends[1]).distinct().join(entities, ["type", "normalized_value"], "left_anti")
    return entities.select("type", "normalized_value", F.lit(False).alias("created")).union(new.withColumn("created", F.lit(True)))


def checked_entities(rows: DataFrame) -> DataFrame:
    """``rows`` (``type, raw_value``) with ``error``: what keeps a row from being stored by hand, null if nothing does."""
    unknown = ~F.coalesce(F.lower("type").isin(*ENTITY_TYPES), F.lit(False))
    empty = F.trim(F.coalesce(normalize(F.col("type"), F.col("raw_value"), native=True), F.lit(""))) == ""
    return rows.withColumn("error", F.when(unknown, "unknown entity type").when(empty, "empty normal form"))


class Adapters:
    """Sources whose results are taken in; there is no fallback for others."""

    def __init__(self, *names: str):
        self.names: set[str] = set()
        for n in names:
            self.register(n)

    def register(self, name: str, overwrite: bool = False) -> None:
        if not name:
            raise ValueError("a source needs a name")
        if name in self.names and not overwrite:
            raise ValueError(f"{name} is registered already")
        self.names.add(name)

    def taken(self, results: DataFrame, plugin: str = "plugin_id") -> DataFrame:
        """``results`` and whether each is taken in or skipped."""
        return results.withColumn("outcome", F.when(F.coalesce(F.col(plugin).isin(*sorted(self.names)), F.lit(False)), "ingested").otherwise("skipped"))


def compliance(checks: DataFrame, plugin: str = "plugin_id") -> DataFrame:
    """``(plugin, total, passed, failed, errors, compliant)`` of checks with ``outcome`` passed, failed or error."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    found = checks.groupBy(plugin).agg(F.count("*").alias("total"), n("passed").alias("passed"), n("failed").alias("failed"), n("error").alias("errors"))
    return found.withColumn("compliant", (F.col("failed") == 0) & (F.col("errors") == 0))


def submitted(targets: DataFrame, column: str = "target") -> DataFrame:
    """``(target, target_type, outcome)`` of targets handed in together: blank ones are left out, those of an
    unknown kind are skipped."""
    from evigrid.functions.classify import classify

    rows = targets.select(F.trim(F.col(column)).alias("target")).where("target <> ''")
    kind = classify(F.col("target"))
    return rows.select("target", kind.alias("target_type")).withColumn("outcome", F.when(F.col("target_type") == "unknown", "skipped").otherwise("created"))


#: Observations that a task of ``evidence_chain`` holds, about.
OBSERVED = 1 << 20


def evidence_chain(evidence: DataFrame, observed: DataFrame, entities: DataFrame) -> DataFrame:
    """The columns of ``evidence`` with ``entity_id`` of what was observed, once each, of known ``entities``.

    Both sides are distinct before they meet, so their join is: it needs no table of all its rows. The number
    of tasks follows the observations (``OBSERVED`` a task), so that a task holds no more of a larger table.
    """
    tasks = max(partitions(evidence.sparkSession), math.ceil(observed.count() / OBSERVED))
    once = lambda df: df.repartition(tasks, "evidence_id").distinct()
    known = observed.select("evidence_id", "entity_id").join(entities.select("entity_id"), "entity_id", "left_semi")
    return once(evidence).join(once(known.select("evidence_id", "entity_id")), "evidence_id")
