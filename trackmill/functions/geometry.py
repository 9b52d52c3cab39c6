"""Boxes and points as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event rule, as fractions of the hoop box.
SIDE_MARGIN = 0.6
ABOVE_REACH = 2.5
BELOW_REACH = 1.0
CROP_SIDE_EXTRA = 1.5
CROP_BELOW_EXTRA = 0.5
NET_SIDE = 0.05
NET_DEPTH = 0.9
RIM_TO_HOOP_W = 2.4
RIM_TO_HOOP_H = 2.6
RIM_NET_PAD = 0.1
RIM_NET_DEPTH = 1.1


class Box(NamedTuple):
    """Corner coordinates; each part is a Column."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def w(self) -> Column:
        return self.x2 - self.x1

    @property
    def h(self) -> Column:
        return self.y2 - self.y1

    def struct(self) -> Column:
        return F.struct(*[getattr(self, n).alias(n) for n in self._fields])


def box(x1, y1, x2, y2) -> Box:
    """Box from numbers, column names or Columns."""
    return Box(*[F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))
                 for v in (x1, y1, x2, y2)])


def box_of(s: str | Column) -> Box:
    """Box held in a struct column with fields x1, y1, x2, y2."""
    c = F.col(s) if isinstance(s, str) else s
    return Box(*[c.getField(n) for n in Box._fields])


def side_band(b: Box, cx: Column) -> Column:
    """Is cx horizontally near the hoop?"""
    return cx.between(b.x1 - b.w * SIDE_MARGIN, b.x2 + b.w * SIDE_MARGIN)


def above_band(b: Box, cy: Column) -> Column:
    return (cy < b.y1) & (cy >= b.y1 - b.h * ABOVE_REACH)


def through_band(b: Box, cy: Column) -> Column:
    return cy.between(b.y1, b.y2 + b.h * BELOW_REACH)


def _pixels(c: Column) -> Column:
    return F.bround(c).cast("bigint")


def roi(b: Box, w: Column, h: Column) -> Box:
    """Pixel crop that holds everything the event rule can look at."""
    side = b.w * (SIDE_MARGIN + CROP_SIDE_EXTRA)
    return Box(
        F.greatest(F.lit(0), _pixels((b.x1 - side) * w)),
        F.lit(0).cast("bigint"),
        F.least(w.cast("bigint"), _pixels((b.x2 + side) * w)),
        F.least(h.cast("bigint"), _pixels((b.y2 + b.h * (BELOW_REACH + CROP_BELOW_EXTRA)) * h)),
    )


def net_roi(b: Box, w: Column, h: Column) -> Box:
    """Pixel region under a hand-drawn hoop box."""
    return Box(
        _pixels(F.greatest(F.lit(0.0), b.x1 - b.w * NET_SIDE) * w),
        _pixels(b.y2 * h),
        _pixels(F.least(F.lit(1.0), b.x2 + b.w * NET_SIDE) * w),
        _pixels(F.least(F.lit(1.0), b.y2 + b.h * NET_DEPTH) * h),
    )


def rim_net_roi(rim: Box, w: Column, h: Column) -> Box:
    """Pixel region where the net hangs below a detected rim; truncates."""
    whole = lambda c: c.cast("bigint")
    zero = F.lit(0).cast("bigint")
    return Box(
        F.greatest(zero, whole(rim.x1 - rim.w * RIM_NET_PAD)),
        F.greatest(zero, whole((rim.y1 + rim.y2) / 2)),
        F.least(whole(w), whole(rim.x2 + rim.w * RIM_NET_PAD)),
        F.least(whole(h), whole(rim.y2 + rim.w * RIM_NET_DEPTH)),
    )


def rim_to_hoop(rim: Box, w: Column, h: Column) -> Box:
    """Normalised hoop box scaled up around a detected rim."""
    cx, cy = (rim.x1 + rim.x2) / 2, (rim.y1 + rim.y2) / 2
    half_w, half_h = rim.w * RIM_TO_HOOP_W / 2, rim.h * RIM_TO_HOOP_H / 2
    return Box((cx - half_w) / w, (cy - half_h) / h, (cx + half_w) / w, (cy + half_h) / h)


def box_center(b: Box, ox: Column, oy: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Box centre inside a crop at (ox, oy), normalised to the full frame."""
    return (ox + (b.x1 + b.x2) / 2) / w, (oy + (b.y1 + b.y2) / 2) / h


def iou(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(
        zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    )
    return inter / (a.w * a.h + b.w * b.h - inter + F.lit(1e-9))


def at_hands(person: Box, ball: Box) -> Column:
    """Is the ball's centre in the padded upper part of the person's box?"""
    bx, by = (ball.x1 + ball.x2) / 2, (ball.y1 + ball.y2) / 2
    return bx.between(person.x1 - person.w * 0.15, person.x2 + person.w * 0.15) & by.between(
        person.y1 - person.h * 0.15, person.y1 + person.h * 0.6
    )
