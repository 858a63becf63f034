"""What images say of themselves: size, camera, software, time and place, from their first segments."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evigrid.session import ship

# TIFF tags of directories, of texts that are kept, and of a place; sizes of TIFF types.
EXIF_DIR, GPS_DIR = 0x8769, 0x8825
TEXTS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "changed", 0x9003: "taken"}
LATITUDE, LONGITUDE, ALTITUDE = (1, 2), (3, 4), (5, 6)
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
RATIONALS = {5: "II", 10: "ii"}
FIELDS = {"format": "string", "width": "int", "height": "int"} | dict.fromkeys(TEXTS.values(), "string") | dict.fromkeys(("latitude", "longitude", "altitude"), "double")


class _Tiff:
    """A TIFF block in either byte order; whatever points outside of it, or back, is left out."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.seen = raw, set()
        self.order = {b"II": "<", b"MM": ">"}.get(raw[:2], "")
        if not self.order or len(raw) < 8 or self._get("H", 2)[0] != 42:
            self.order = ""

    def _get(self, kinds: str, at: int) -> tuple:
        return struct.unpack_from(self.order + kinds, self.raw, at)

    def first(self) -> dict[int, tuple[int, int, int]]:
        return self.directory(self._get("I", 4)[0]) if self.order else {}

    def directory(self, at: int) -> dict[int, tuple[int, int, int]]:
        """Tag -> (type, count, place of its values)."""
        if at in self.seen or not 8 <= at <= len(self.raw) - 2:
            return {}
        self.seen.add(at)
        out = {}
        for k in range(self._get("H", at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(self.raw):
                break
            tag, kind, count = self._get("HHI", entry)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else self._get("I", entry + 8)[0]
            if size and place + size <= len(self.raw):
                out.setdefault(tag, (kind, count, place))
        return out

    def text(self, entry: tuple[int, int, int] | None) -> str | None:
        if entry is None or entry[0] != 2:
            return None
        return self.raw[entry[2] : entry[2] + entry[1]].split(b"\0")[0].decode("utf-8", "replace").strip() or None

    def number(self, entry: tuple[int, int, int] | None) -> int | None:
        return self._get({1: "B", 3: "H", 4: "I"}[entry[0]], entry[2])[0] if entry and entry[0] in (1, 3, 4) else None

    def rationals(self, entry: tuple[int, int, int] | None) -> list[float]:
        if entry is None or entry[0] not in RATIONALS:
            return []
        pairs = [self._get(RATIONALS[entry[0]], entry[2] + 8 * k) for k in range(min(entry[1], 3))]
        return [a / b for a, b in pairs] if all(b for _, b in pairs) else []

    def angle(self, directory: dict, tags: tuple[int, int]) -> float | None:
        parts = self.rationals(directory.get(tags[1]))
        if len(parts) != 3:
            return None
        return sum(p / 60**k for k, p in enumerate(parts)) * (-1 if (self.text(directory.get(tags[0])) or "").upper() in ("S", "W") else 1)


def _jpeg(raw: bytes) -> tuple[int | None, int | None, bytes]:
    width = height = None
    tiff, at = b"", 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        mark, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0" and not tiff:
            tiff = body[6:]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
        at += 2 + max(size, 2)
    return width, height, tiff


def _png(raw: bytes) -> tuple[int | None, int | None, bytes]:
    width, height = struct.unpack_from(">II", raw, 16) if len(raw) >= 24 else (None, None)
    at = 8
    while at + 8 <= len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if kind == b"eXIf":
            return width, height, raw[at + 8 : at + 8 + size]
        at += 12 + size
    return width, height, b""


def facts(raw: bytes | None) -> dict:
    """The fields of one image; those it lacks are null, and so is everything of what is no image."""
    raw = raw or b""
    if raw[:3] == b"\xff\xd8\xff":
        name, (width, height, block) = "jpeg", _jpeg(raw)
    elif raw[:8] == b"\x89PNG\r\n\x1a\n":
        name, (width, height, block) = "png", _png(raw)
    elif raw[:4] in (b"II*\0", b"MM\0*"):
        name, width, height, block = "tiff", None, None, raw
    else:
        return dict.fromkeys(FIELDS)
    tiff = _Tiff(block)
    main = tiff.first()
    if name == "tiff":
        width, height = tiff.number(main.get(256)), tiff.number(main.get(257))
    every = main | tiff.directory(tiff.number(main.get(EXIF_DIR)) or 0)
    gps = tiff.directory(tiff.number(main.get(GPS_DIR)) or 0)
    height_of = tiff.rationals(gps.get(ALTITUDE[1]))
    below = tiff.number(gps.get(ALTITUDE[0])) == 1
    found = {"format": name, "width": width, "height": height} | {n: tiff.text(every.get(t)) for t, n in TEXTS.items()}
    return found | {
        "latitude": tiff.angle(gps, LATITUDE), "longitude": tiff.angle(gps, LONGITUDE), "altitude": (-height_of[0] if below else height_of[0]) if height_of else None,
    }


def metadata(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``(key, format, width, height, make, model, software, changed, taken, latitude, longitude, altitude)`` of
    every image, as ``spark.read.format("binaryFile")`` gives them. Broken and foreign files have nulls."""
    ship(files.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evigrid.sources.images import facts

        for b in batches:
            rows = [facts(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f] for r in rows], kinds[k]) for f, k in FIELDS.items())], names=[key, *FIELDS])

    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, " + ", ".join(f"{f} {k}" for f, k in FIELDS.items())
    return files.select(key, content).mapInArrow(run, schema)
