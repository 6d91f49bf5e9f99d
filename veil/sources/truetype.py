"""What a PDF needs of a TrueType font: glyphs of characters, their widths, and the font's measures."""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Font:
    data: bytes
    units: int
    box: tuple[int, ...]
    ascent: int
    descent: int
    widths: tuple[int, ...]
    glyphs: dict[int, int]

    def glyph(self, char: str) -> int:
        """The number of a character's glyph; 0, the font's sign for a missing one, if it has none."""
        return self.glyphs.get(ord(char), 0)

    def width(self, glyph: int) -> int:
        """In thousandths of the font's size."""
        return round(self.widths[min(glyph, len(self.widths) - 1)] * 1000 / self.units)

    def scaled(self, value: int) -> int:
        return round(value * 1000 / self.units)


def _characters(table: bytes) -> dict[int, int]:
    """Glyphs by code point, of the widest Unicode subtable (format 12, else 4)."""
    places = [struct.unpack_from(">HHI", table, 4 + 8 * i) for i in range(struct.unpack_from(">H", table, 2)[0])]
    own = {struct.unpack_from(">H", table, at)[0]: at for platform, _, at in places if platform in (0, 3)}
    out: dict[int, int] = {}
    if 12 in own:
        at = own[12]
        for i in range(struct.unpack_from(">I", table, at + 12)[0]):
            first, last, glyph = struct.unpack_from(">III", table, at + 16 + 12 * i)
            out.update((c, glyph + c - first) for c in range(first, last + 1))
    elif 4 in own:
        at = own[4]
        n = struct.unpack_from(">H", table, at + 6)[0] // 2
        row = lambda k, kind="H": struct.unpack_from(f">{n}{kind}", table, at + 14 + 2 * n * k + 2 * (k > 0))
        ends, starts, deltas, offsets = row(0), row(1), row(2, "h"), row(3)
        for i, (first, last, delta, offset) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
            for c in range(first, last + 1):
                if not offset:
                    glyph = (c + delta) & 0xFFFF
                else:
                    place = at + 16 + 6 * n + 2 * i + offset + 2 * (c - first)
                    glyph = struct.unpack_from(">H", table, place)[0] if place + 2 <= len(table) else 0
                    glyph = (glyph + delta) & 0xFFFF if glyph else 0
                if glyph and c != 0xFFFF:
                    out[c] = glyph
    return out


@functools.lru_cache(maxsize=4)
def read_font(path: str) -> Font:
    data = Path(path).read_bytes()
    if data[:4] not in (b"\0\1\0\0", b"true"):
        raise ValueError(f"{path} is not a TrueType font")
    tables = {}
    for i in range(struct.unpack_from(">H", data, 4)[0]):
        name, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
        tables[name.decode("latin-1")] = data[at : at + size]
    head, wide = tables["head"], tables["hhea"]
    n = struct.unpack_from(">H", wide, 34)[0]
    return Font(
        data, struct.unpack_from(">H", head, 18)[0], struct.unpack_from(">4h", head, 36), *struct.unpack_from(">2h", wide, 4),
        tuple(struct.unpack_from(">H", tables["hmtx"], 4 * i)[0] for i in range(n)), _characters(tables["cmap"]),
    )
