"""Image metadata against images packed here, byte by byte, and against damaged ones."""

import random
import struct

import pytest

from evigrid.sources.images import FIELDS, facts


def tiff(order, tags, exif=(), gps=()):
    """A TIFF block of ``(tag, type, values)``; directories one after the other, values behind them."""
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 10: "ii"}
    starts = [8, 8 + 2 + 12 * (len(tags) + 2) + 4]
    starts.append(starts[1] + 2 + 12 * len(exif) + 4)
    behind = starts[2] + 2 + 12 * len(gps) + 4
    out, data = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8), b""
    for entries in ([*tags, (0x8769, 4, [starts[1]]), (0x8825, 4, [starts[2]])], exif, gps):
        out += struct.pack(order + "H", len(entries))
        for tag, kind, values in entries:
            raw = values if kind == 2 else b"".join(struct.pack(order + kinds[kind], *(v if isinstance(v, tuple) else (v,))) for v in values)
            out += struct.pack(order + "HHI", tag, kind, len(values))
            out += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", behind + len(data))
            data += raw if len(raw) > 4 else b""
        out += struct.pack(order + "I", 0)
    return out + data


def jpeg(block, width, height):
    app = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, height, width) + bytes(10) + b"\xff\xda\x00\x02" + b"\xff\xd9"


def png(block, width, height):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"eXIf", block) + chunk(b"IEND", b"")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("pack", [jpeg, png])
def test_fields(order, pack):
    gps = [(1, 2, b"S\0"), (2, 5, [(10, 1), (30, 1), (3600, 100)]), (3, 2, b"E\0"), (4, 5, [(20, 2), (0, 1), (0, 1)]), (5, 1, [1]), (6, 5, [(25, 2)])]
    block = tiff(order, [(0x010F, 2, b"Maker\0"), (0x0110, 2, b"X1\0"), (0x0132, 2, b"2024:01:02 03:04:05\0")], [(0x9003, 2, b"2023:01:02 03:04:05\0")], gps)
    got = facts(pack(block, 640, 480))
    want = {"format": pack.__name__, "width": 640, "height": 480, "make": "Maker", "model": "X1", "software": None, "changed": "2024:01:02 03:04:05", "taken": "2023:01:02 03:04:05", "latitude": -10.51, "longitude": 10.0, "altitude": -12.5}
    assert got == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()}


def test_damaged_images_crash_nothing():
    rnd = random.Random(1)
    whole = jpeg(tiff("<", [(0x010F, 2, b"Maker\0")], (), [(2, 5, [(1, 0), (1, 1), (1, 1)]), (1, 2, b"N\0")]), 6, 4)
    assert facts(whole)["latitude"] is None  # a zero below the line
    for _ in range(3000):
        raw = bytearray(whole)
        for _ in range(rnd.randint(1, 6)):
            raw[rnd.randrange(len(raw))] = rnd.randrange(256)
        assert facts(bytes(raw[: rnd.randint(0, len(raw))])).keys() == FIELDS.keys()
    assert set(facts(None).values()) == set(facts(b"GIF89a").values()) == {None}
