"""Column expressions on pixel words. Words are BIGINT, as a 32-bit unsigned value needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(px: Column, shift: int, mask: int) -> Column:
    return F.shiftright(px, shift).bitwiseAND(F.lit(mask).cast("long")) if shift else px.bitwiseAND(F.lit(mask).cast("long"))


def alpha(px: Column) -> Column:
    return bits(px, 24, 255)


def red(px: Column, bpp: int = 32) -> Column:
    return bits(px, 10, 31) if bpp == 16 else bits(px, 16, 255)


def green(px: Column, bpp: int = 32) -> Column:
    return bits(px, 5, 31) if bpp == 16 else bits(px, 8, 255)


def blue(px: Column, bpp: int = 32) -> Column:
    return bits(px, 0, 31) if bpp == 16 else bits(px, 0, 255)


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    return (a * 16777216 + r * 65536 + g * 256 + b).cast("long")


def pack16(r: Column, g: Column, b: Column) -> Column:
    return (r * 1024 + g * 32 + b).cast("long")


def per_component(px: Column, fn, top: Column | None = None) -> Column:
    """fn on red, green and blue; the top byte is `top`, or stays."""
    return pack(alpha(px) if top is None else top, fn(red(px)), fn(green(px)), fn(blue(px)))


def div(x: Column, n) -> Column:
    """Integer division of values that aren't negative, exact at any size."""
    return F.call_function("div", x, n if isinstance(n, Column) else F.lit(n).cast("long"))


def premultiply_component(c: Column, a: Column) -> Column:
    """floor(a * c / 255), exactly: 257 * (x + 1) >> 16 is x div 255 for 0 <= x <= 65025."""
    return F.shiftright((a * c + 1) * 257, 16)


def premultiply(px: Column) -> Column:
    a = alpha(px)
    return per_component(px, lambda c: premultiply_component(c, a))


def unpremultiply_component(c: Column, a: Column) -> Column:
    """The least estimate that premultiplies back to c, in integers.

    An estimate is floor(c * 255 / a), at most 255, then one step up or down if
    it doesn't map back; for c <= a that always does. Values of c above a are
    not premultiplied data and give 255.
    """
    u = F.least(div(c * 255, a), F.lit(255))
    back = premultiply_component(u, a)
    return F.when(back < c, F.least(u + 1, F.lit(255))).when(back > c, F.greatest(u - 1, F.lit(0))).otherwise(u)


def unpremultiply(px: Column) -> Column:
    a = alpha(px)
    return F.when(a == 0, F.lit(0).cast("long")).when(a == 255, px).otherwise(per_component(px, lambda c: unpremultiply_component(c, a)))


def opaque(px: Column) -> Column:
    """The word with a zero top byte."""
    return bits(px, 0, 0xFFFFFF)


def rgb_only(px: Column) -> Column:
    return opaque(unpremultiply(px))


def alpha_as_gray(px: Column) -> Column:
    return alpha(px) * 65793  # 0x010101


def gray_level(px: Column) -> Column:
    """The common level of a gray pixel, null if it isn't gray."""
    return F.when((red(px) == green(px)) & (green(px) == blue(px)), blue(px))


def subtract(new: Column, old: Column) -> Column:
    """Byte by byte, modulo 256."""
    return _bytewise(new, old, lambda a, b: F.pmod(a - b, F.lit(256)))


def add(old: Column, delta: Column) -> Column:
    return _bytewise(old, delta, lambda a, b: F.pmod(a + b, F.lit(256)))


def _bytewise(x: Column, y: Column, fn) -> Column:
    return pack(*[fn(bits(x, s, 255), bits(y, s, 255)) for s in (24, 16, 8, 0)])


def swap_red_blue(px: Column) -> Column:
    return pack(alpha(px), blue(px), green(px), red(px))


def to_rgb15(px: Column) -> Column:
    """The five high bits of each component."""
    return pack16(F.shiftright(red(px), 3), F.shiftright(green(px), 3), F.shiftright(blue(px), 3))


def hex_word(px: Column, bpp: int) -> Column:
    return F.format_string(f"%0{ {16: 4, 24: 6, 32: 8}[bpp] }X", px)


def clear(px: Column) -> Column:
    """Zero, whatever the pixel was."""
    return F.lit(0).cast("long")
