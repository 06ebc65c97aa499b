"""Boxes as x, y, width, height with the origin at the top left, and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union in [0, 1]; boxes that only touch, or have no area, give 0."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = wide * high
    union = aw * ah + bw * bh - inter
    return F.when((inter > 0) & (union > 0), F.least(F.lit(1.0), inter / union)).otherwise(zero)


def tolerant_box(bounds: Column) -> tuple[Column, ...]:
    """x, y, w, h of a JSON text whose sizes are called w/h or width/height."""

    def get(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(bounds, f"$.{n}").try_cast("double") for n in names])

    return get("x"), get("y"), get("w", "width"), get("h", "height")


def normalised_centre(b: tuple[Column, ...], width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as shares of the page, clamped to [0, 1]."""
    x, y, w, h = b

    def clamp(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    return {"cx": clamp((x + w / 2) / width), "cy": clamp((y + h / 2) / height), "cw": clamp(w / width), "ch": clamp(h / height)}


def pixels_to_points(b: tuple[Column, ...], dpi: Column) -> tuple[Column, ...]:
    return tuple(c * 72.0 / dpi for c in b)


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    clean = F.regexp_replace(hex_colour, "^#", "")

    def linear(at: int) -> Column:
        c = F.conv(F.substring(clean, at, 2), 16, 10).cast("double") / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return linear(1) * 0.2126 + linear(3) * 0.7152 + linear(5) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def contrast_passes(ratio: Column, large: Column) -> dict[str, Column]:
    """AA: 4.5, for large text 3; AAA: 7, for large text 4.5."""
    return {"passes_aa": ratio >= F.when(large, 3.0).otherwise(4.5), "passes_aaa": ratio >= F.when(large, 4.5).otherwise(7.0)}
