"""Boxes: area, intersection, overlap and the predicates on sizes and positions.

A box is four double columns x0, y0, x1, y1 in points, origin at the top left.  A box with a null side has no area.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0


def area(b: Box) -> Column:
    """F1."""
    return F.coalesce(F.greatest(F.lit(0.0), b.width) * F.greatest(F.lit(0.0), b.height) + 0.0 * (b.x0 + b.y0 + b.x1 + b.y1), F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    """area shared by two boxes; boxes that only touch share nothing."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """shared part of a's area."""
    return F.when((intersection(a, b) > 0) & (area(a) > 0), intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """shared part of the joint area."""
    joint = area(a) + area(b) - intersection(a, b)
    return F.when((intersection(a, b) > 0) & (joint > 0), intersection(a, b) / joint).otherwise(F.lit(0.0))


def relationship(a: Box, b: Box) -> Column:
    """none, equal, contained_by, contains or overlaps, seen from a."""
    ra, rb = overlap_ratio(a, b), overlap_ratio(b, a)
    return F.when(intersection(a, b) <= 0, "none").when((ra > 0.85) & (rb > 0.85), "equal").when(ra > 0.85, "contained_by").when(rb > 0.85, "contains").otherwise("overlaps")


def covers_page(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """An image so large that it is the page's background."""
    return ((w >= 0.65 * page_w) & (h >= 0.65 * page_h)) | ((w >= 0.8 * page_w) & (h >= 0.4 * page_h)) | ((h >= 0.8 * page_h) & (w >= 0.4 * page_w))


def scan_mask(bits: Column, w: Column, h: Column) -> Column:
    """P5."""
    return (bits == 1) & (w >= 140) & (h >= 140)


def tiny_image(w: Column, h: Column) -> Column:
    """P6."""
    return (w < 28) | (h < 20)


def fraction_bar(b: Box) -> Column:
    """P7."""
    return (b.height <= 3) & b.width.between(5, 65)


def scaled(v: Column, dpi: int) -> Column:
    """Pixels at a resolution to points."""
    return v * 72.0 / dpi


def into_page(v: Column, crop_size: Column, low: Column, high: Column) -> Column:
    """A position inside a crop, as a position on the page; clamped to the crop."""
    return low + F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / crop_size)) * (high - low)


def line_position(b: Box, page_w: Column, page_h: Column) -> Column:
    """Top, height, left and width in percent of the page; lines are at least 12 points high."""
    pct = lambda v, of: F.round(100 * v / of, 2)
    return F.struct(pct(b.y0, page_h).alias("top"), pct(F.greatest(F.lit(12.0), b.height), page_h).alias("height"), pct(b.x0, page_w).alias("left"), pct(b.width, page_w).alias("width"))
