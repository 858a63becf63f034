"""Comparing results with golden fixtures, field by field."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Top-level fields that differ from run to run.
VOLATILE = frozenset({"request_id", "execution_id", "executed_at", "investigation_id"})
MISSING = "<missing>"


def differences(expected: object, actual: object, path: str = "", skip: frozenset[str] = frozenset()) -> Iterator[tuple[str, object, object]]:
    """``(path, expected, actual)`` where two JSON values part: another type, a missing key, another length
    of a list (then its items are not looked at), another scalar."""
    if type(expected) is not type(actual):
        yield path or "<root>", expected, actual
    elif isinstance(expected, dict):
        for key in sorted({*expected, *actual} - skip):
            yield from differences(expected.get(key, MISSING), actual.get(key, MISSING), f"{path}.{key}" if path else key)
    elif isinstance(expected, list) and len(expected) == len(actual):
        for i, pair in enumerate(zip(expected, actual)):
            yield from differences(*pair, f"{path}[{i}]")
    elif expected != actual:
        yield path or "<root>", expected, actual


def compared(rows: DataFrame, key: str, ignore: frozenset[str] = VOLATILE) -> DataFrame:
    """``(key, path, expected, actual)`` for the JSON texts ``expected`` and ``actual`` of each row; values are JSON
    again. A null text is JSON null; one that is no JSON raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, e, a in zip(*(c.to_pylist() for c in b.columns)):
                for path, x, y in differences(json.loads(e or "null"), json.loads(a or "null"), "", ignore):
                    out.append((k, path, *(json.dumps(v, sort_keys=True) for v in (x, y))))
            kinds = (b.schema.types[0], *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[key, "path", "expected", "actual"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col("expected"), F.col("actual")).mapInArrow(run, f"`{key}` {kind}, path string, expected string, actual string")
