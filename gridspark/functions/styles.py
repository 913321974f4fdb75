"""Colours, fonts and lengths of cell styles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legacy palette of indexed colours, 0 to 63.
PALETTE = (
    "#000000", "#ffffff", "#ff0000", "#00ff00", "#0000ff", "#ffff00", "#ff00ff", "#00ffff",
    "#000000", "#ffffff", "#ff0000", "#00ff00", "#0000ff", "#ffff00", "#ff00ff", "#00ffff",
    "#800000", "#008000", "#000080", "#808000", "#800080", "#008080", "#c0c0c0", "#808080",
    "#9999ff", "#993366", "#ffffcc", "#ccffff", "#660066", "#ff8080", "#0066cc", "#ccccff",
    "#000080", "#ff00ff", "#ffff00", "#00ffff", "#800080", "#800000", "#008080", "#0000ff",
    "#00ccff", "#ccffff", "#ccffcc", "#ffff99", "#99ccff", "#ff99cc", "#cc99ff", "#ffcc99",
    "#3366ff", "#33cccc", "#99cc00", "#ffcc00", "#ff9900", "#ff6600", "#666699", "#969696",
    "#003366", "#339966", "#003300", "#333300", "#993300", "#993366", "#333399", "#333333",
)

#: Length units of drawings in a pixel, at 96 pixels an inch.
EMU_PER_PIXEL = 9525


def indexed_colour(index: int) -> str | None:
    """The colour of the legacy palette, null outside of it."""
    return PALETTE[index] if 0 <= index < len(PALETTE) else None


def hex_colour(raw: Column) -> Column:
    """``#rrggbb`` from RRGGBB or AARRGGBB; anything else is null."""
    digits = F.regexp_extract(F.trim(raw), "^(?:[0-9A-Fa-f]{2})?([0-9A-Fa-f]{6})$", 1)
    return F.when(digits != "", F.concat(F.lit("#"), F.lower(digits)))


def font_family(raw: Column) -> Column:
    """The name in double quotes if it is letters, digits, spaces, dots and hyphens only, else null."""
    name = F.trim(raw)
    return F.when(name.rlike(r"^[A-Za-z0-9 .-]+\z"), F.concat(F.lit('"'), name, F.lit('"')))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and named once: expressions stay small."""
    return F.get(F.transform(F.array(value), use), 0)


def tinted(colour: Column, tint: Column) -> Column:
    """``#rrggbb`` with its HSL lightness moved towards black (tint below 0) or white (above 0)."""

    def shades(v: Column) -> Column:
        red, green, blue, high, low = (v[x] for x in ("red", "green", "blue", "high", "low"))
        spread, light = high - low, (high + low) / 2
        share = F.when(spread == 0, F.lit(0.0)).otherwise(spread / (1 - F.abs(2 * light - 1)))
        turn = F.when(spread == 0, F.lit(0.0)).when(high == red, (green - blue) / spread).when(high == green, (blue - red) / spread + 2).otherwise((red - green) / spread + 4)
        moved = F.when(v["by"] < 0, light * (1 + v["by"])).otherwise(light + (1 - light) * v["by"])
        return _let(F.struct(share.alias("share"), turn.alias("turn"), moved.alias("moved")), written)

    def written(v: Column) -> Column:
        reach = v["share"] * F.least(v["moved"], 1 - v["moved"])

        def channel(sixths: float) -> Column:
            value = _let(F.pmod(v["turn"] + sixths, F.lit(6.0)), lambda place: F.greatest(F.lit(-1.0), F.least(place / 0.5 - 3, 9 - place / 0.5, F.lit(1.0))))
            return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v["moved"] - reach * value) * 255 + 0.5)))), 2, "0")

        return F.lower(F.concat(F.lit("#"), channel(0.0), channel(4.0), channel(2.0)))

    def moved(v: Column) -> Column:
        parts = F.transform(F.array(*map(F.lit, (2, 4, 6))), lambda at: F.conv(F.substring(v["colour"], at, F.lit(2)), 16, 10).cast("double") / 255)
        by = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["tint"]))
        named = lambda p: F.struct(*[F.get(p, i).alias(n) for i, n in enumerate(("red", "green", "blue"))], F.array_max(p).alias("high"), F.array_min(p).alias("low"), by.alias("by"))
        whole = _let(parts, lambda p: _let(named(p), shades))
        return F.when((v["tint"] != 0) & v["colour"].rlike("^#[0-9A-Fa-f]{6}$"), whole).otherwise(v["colour"])

    return _let(F.struct(colour.alias("colour"), F.coalesce(tint, F.lit(0.0)).alias("tint")), moved)


def emu_to_pixels(emu: Column) -> Column:
    return F.floor(emu / EMU_PER_PIXEL + 0.5).cast("long")
