"""Width and height of an image from the first bytes of its file, as a Column expression (S19): nothing is decoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JPEG segments that are looked through before the frame's header; each holds up to 64 KB.
SEGMENTS = 512
#: They are walked in legs of so many steps; what has come to its end in one leg does not begin the next.
LEGS = (8, 56, SEGMENTS - 64)
#: JPEG markers that carry the frame's size.
FRAMES = [f"{m:02X}" for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]


def _hex(content: Column, at: Column | int, n: int) -> Column:
    return F.hex(F.substring(content, (F.lit(at) if isinstance(at, int) else at) + 1, n))


def _big(content: Column, at: Column | int, n: int) -> Column:
    return F.conv(_hex(content, at, n), 16, 10).cast("long")


def _little(content: Column, at: int, n: int) -> Column:
    turned = F.concat(*[_hex(content, at + i, 1) for i in reversed(range(n))])
    return F.conv(turned, 16, 10).cast("long")


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def _once(v: Column, of) -> Column:
    """of(v), with v worked out once however often `of` names it."""
    return F.get(F.transform(F.array(v), of), F.lit(0))


def _jpeg(content: Column) -> Column:
    """Walks from segment to segment by their lengths up to the first frame header; `over` marks a walk that has found it or can't go on."""
    none = F.lit(None).cast("struct<width:int,height:int>")
    state = lambda at, size, over: F.struct(at.cast("long").alias("at"), size.alias("size"), over.alias("over"))

    def on(at: Column, mark: Column) -> Column:
        to = F.when(mark == "FF", at + 1).when(mark.isin("01", *[f"D{i}" for i in range(8)]), at + 2).otherwise(at + 2 + _big(content, at + 2, 2))
        return F.when(mark.isin(FRAMES), state(at, _size(_big(content, at + 7, 2), _big(content, at + 5, 2)), F.lit(True))).otherwise(state(to, none, F.lit(False)))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        whole = ~s["over"] & (at + 9 <= F.length(content))
        return F.when(whole & (_hex(content, at, 1) == "FF"), _once(_hex(content, at + 1, 1), lambda mark: on(at, mark))).otherwise(state(at, s["size"], F.lit(True)))

    def leg(n: int):
        return lambda s: F.when(s["over"], s).otherwise(F.aggregate(F.array_repeat(F.lit(0), n), s, step))

    walked = state(F.lit(2), none, F.lit(False))
    for n in LEGS:
        walked = _once(walked, leg(n))
    return walked["size"]


def image_size(content: Column) -> Column:
    """struct(width, height) of PNG, JPEG, GIF, BMP and WebP files; null for others, for files that break off before, and for sizes of 0."""
    return _once(_once(content, _header), lambda z: F.when((z["width"] > 0) & (z["height"] > 0), z))


def _header(content: Column) -> Column:
    head, kind = _hex(content, 0, 2), _hex(content, 12, 4)
    bits = _little(content, 21, 4)
    webp = (
        F.when(kind == "56503858", _size(_little(content, 24, 3) + 1, _little(content, 27, 3) + 1))
        .when(kind == "56503820", _size(_little(content, 26, 2).bitwiseAND(16383), _little(content, 28, 2).bitwiseAND(16383)))
        .when(kind == "5650384C", _size(bits.bitwiseAND(16383) + 1, F.shiftright(bits, 14).bitwiseAND(16383) + 1))
    )
    signed = lambda v: F.abs(F.when(v >= 2**31, v - 2**32).otherwise(v))
    return (
        F.when(_hex(content, 0, 8) == "89504E470D0A1A0A", _size(_big(content, 16, 4), _big(content, 20, 4))).when(head == "FFD8", _jpeg(content))
        .when(_hex(content, 0, 3) == "474946", _size(_little(content, 6, 2), _little(content, 8, 2))).when(head == "424D", _size(_little(content, 18, 4), signed(_little(content, 22, 4))))
        .when((_hex(content, 0, 4) == "52494646") & (_hex(content, 8, 4) == "57454250"), webp)
    )
