"""Step costs between word boxes, as Column builders and as plain functions for the search kernel.

A box is given by its fractions of the page: left, top, width, height. Both forms follow one order of operations, so
that they agree to the last bit.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.config import ReadingOrder

LTR, RTL = ReadingOrder.HORIZONTAL_LTR_TTB, ReadingOrder.HORIZONTAL_RTL_TTB
V_RTL, V_LTR = ReadingOrder.VERTICAL_TTB_RTL, ReadingOrder.VERTICAL_TTB_LTR
#: Pixels by which lines may overlap, page share that is a column gap, height factors.
OVERLAP_PX, COLUMN_GAP, LINE_GAP, SAME_COLUMN = 3, 0.15, 2.0, 1.1
STEP, WRAP, FAR = 0.1, 1.0, 100.0


class Box(NamedTuple):
    left: float
    top: float
    width: float
    height: float
    page_width: int = 1000
    page_height: int = 1000
    index: int = 0
    text: str = ""
    norm: str = ""
    line_id: str | None = None

    @property
    def right(self) -> float:
        return self.left + self.width

    @property
    def bottom(self) -> float:
        return self.top + self.height


class _Plain:
    """Operations on numbers."""

    @staticmethod
    def pick(cases, other):
        return next((v for c, v in cases if c), other)

    both = staticmethod(lambda *c: all(c))
    either = staticmethod(lambda *c: any(c))
    largest = staticmethod(max)
    size = staticmethod(abs)
    root = staticmethod(math.sqrt)
    whole = staticmethod(int)


class _Columns:
    """The same operations on Columns."""

    @staticmethod
    def pick(cases, other):
        out = None
        for c, v in cases:
            v = v if isinstance(v, Column) else F.lit(v)
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(other)

    @staticmethod
    def both(*c):
        out = c[0]
        for x in c[1:]:
            out = out & x
        return out

    @staticmethod
    def either(*c):
        out = c[0]
        for x in c[1:]:
            out = out | x
        return out

    largest = staticmethod(F.greatest)
    size = staticmethod(F.abs)
    root = staticmethod(F.sqrt)
    whole = staticmethod(lambda x: x.cast("int"))


class BoxColumns:
    """The columns of a box, with a prefix or inside a struct."""

    def __init__(self, prefix: str = "", of: Column | None = None):
        at = (lambda n: of[n]) if of is not None else (lambda n: F.col(prefix + n))
        self.left, self.top, self.width, self.height = (at(n) for n in ("left", "top", "width", "height"))
        self.page_width, self.page_height = at("page_width"), at("page_height")
        self.right, self.bottom = self.left + self.width, self.top + self.height


class Geometry:
    """All relations of two boxes under one reading order."""

    def __init__(self, order: ReadingOrder = LTR, penalty: float = 25.0, columns: bool = False):
        self.order, self.penalty, self.o = order, penalty, _Columns if columns else _Plain

    def centre_distance(self, a, b):
        x = (a.left + a.width / 2) - (b.left + b.width / 2)
        y = (a.top + a.height / 2) - (b.top + b.height / 2)
        return self.o.root(x * x + y * y)

    def same_line(self, a, b):
        if self.order.vertical:
            return self.o.size(a.left - b.left) < (a.height + b.height) * SAME_COLUMN
        return self.o.both(a.top <= b.bottom, a.bottom >= b.top)

    def sequential(self, a, b):
        if self.order.vertical:
            return b.top >= a.top
        return b.left >= a.left if self.order == LTR else b.right <= a.right

    def gap(self, a, b):
        """Along the line."""
        if self.order.vertical:
            return b.top - a.bottom
        return b.left - a.right if self.order == LTR else a.left - b.right

    def line_gap(self, a, b):
        """Across lines."""
        if self.order.horizontal:
            return b.top - a.bottom
        return a.left - b.right if self.order == V_RTL else b.left - a.right

    def extent(self, a):
        return a.width if self.order.horizontal else a.height

    def _px(self, frac, size):
        return self.o.whole(frac * size)

    def wraps_line(self, a, b):
        """``b`` starts the line after ``a``."""
        o, near = self.o, LINE_GAP * self.o.largest(a.height, b.height)
        if self.order.horizontal:
            below = self._px(a.top, a.page_height) + self._px(a.height, a.page_height) < self._px(b.top, b.page_height) + OVERLAP_PX
            back = a.right > b.left if self.order == LTR else a.left < b.right
        elif self.order == V_RTL:
            below = self._px(b.left, b.page_width) + self._px(b.width, b.page_width) < self._px(a.left, a.page_width) + OVERLAP_PX
            back = a.bottom > b.top
        else:
            below = self._px(a.left, a.page_width) + self._px(a.width, a.page_width) < self._px(b.left, b.page_width) + OVERLAP_PX
            back = a.bottom > b.top
        return o.both(below, back, self.line_gap(a, b) <= near)

    def wraps_column(self, a, b):
        """``b`` starts the column after ``a``."""
        o, near = self.o, LINE_GAP * self.o.largest(a.height, b.height)
        if self.order == LTR:
            return o.either(o.both(b.left > a.right, b.bottom < a.top), o.both(b.left - a.right > COLUMN_GAP, o.size(b.top - a.top) < near))
        if self.order == RTL:
            return o.either(o.both(b.right < a.left, b.bottom < a.top), o.both(a.left - b.right > COLUMN_GAP, o.size(b.top - a.top) < near))
        beside = b.right < a.left if self.order == V_RTL else b.left > a.right
        across = a.left - b.right if self.order == V_RTL else b.left - a.right
        return o.either(o.both(beside, b.top < a.top), o.both(across > COLUMN_GAP, o.size(b.top - a.top) < near))

    def step_class(self, a, b):
        """sequential, jump, wrap, column or far."""
        inside = self.o.both(self.same_line(a, b), self.sequential(a, b))
        near = self.centre_distance(a, b) <= self.extent(a) + self.extent(b)
        return self.o.pick([(self.o.both(inside, near), "sequential"), (inside, "jump"), (self.wraps_line(a, b), "wrap"), (self.wraps_column(a, b), "column")], "far")

    def distance(self, a, b):
        if self.o is _Plain:
            return self._distance(a, b)
        gap, inside = self.gap(a, b), self.o.both(self.same_line(a, b), self.sequential(a, b))
        near = self.centre_distance(a, b) <= self.extent(a) + self.extent(b)
        return self.o.pick(
            [(self.o.both(inside, near), STEP + gap), (inside, self.penalty + gap), (self.wraps_line(a, b), WRAP + self.line_gap(a, b)), (self.wraps_column(a, b), self.penalty + gap)],
            FAR + self.centre_distance(a, b),
        )

    def _distance(self, a, b):
        """The same on numbers, without the branches that don't count."""
        if self.same_line(a, b) and self.sequential(a, b):
            near = self.centre_distance(a, b) <= self.extent(a) + self.extent(b)
            return (STEP if near else self.penalty) + self.gap(a, b)
        if self.wraps_line(a, b):
            return WRAP + self.line_gap(a, b)
        return self.penalty + self.gap(a, b) if self.wraps_column(a, b) else FAR + self.centre_distance(a, b)

    def line_position(self, a):
        """Sort keys of sentences: where the line lies, and along it for vertical orders."""
        if self.order.horizontal:
            return a.top, 0.0 if self.o is _Plain else F.lit(0.0)
        return (-(a.left + a.width) if self.order == V_RTL else a.left), a.top


def with_geometry(df, order: ReadingOrder = LTR, penalty: float = 25.0):
    """Class and cost of the step from box ``a_*`` to box ``b_*`` of each row."""
    g, a, b = Geometry(order, penalty, columns=True), BoxColumns("a_"), BoxColumns("b_")
    return df.withColumn("step_class", g.step_class(a, b)).withColumn("step_cost", g.distance(a, b))
