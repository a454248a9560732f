"""Geometry strings: parsing on the driver and as columns, and target sizes as columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?:\d+\.?\d*|\.\d+)"
#: ``[w][x[h]][+-x[+-y]]``: offsets follow an ``x`` or stand alone.
GEOMETRY = re.compile(rf"(?:({NUMBER})?x({NUMBER})?|({NUMBER})(?![+-]))?([+-]{NUMBER})?([+-]{NUMBER})?", re.A)
FLAGS = "!%@^<>"
UNBOUNDED = 4294967295


class GeometryError(ValueError):
    """A geometry string that isn't accepted."""


@dataclass(frozen=True)
class Geometry:
    width: float | None = None
    height: float | None = None
    x: float | None = None
    y: float | None = None
    flags: frozenset[str] = frozenset()

    @classmethod
    def parse(cls, text: str, flagged: bool = True) -> Geometry:
        flags = frozenset(c for c in text if c in FLAGS) if flagged else frozenset()
        bare = "".join(c for c in text if c not in flags)
        found = GEOMETRY.fullmatch(bare)
        if not text or found is None or (not bare and not flags):
            raise GeometryError(f"not a geometry: {text!r}")
        w, h, alone, x, y = found.groups()
        value = lambda s: None if s is None else float(s)
        return cls(value(w or alone), value(h), value(x), value(y), flags)


def half_away(x: float) -> int:
    """Rounds halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def nearest(x: float) -> int:
    """Rounds half up and saturates at 0."""
    return max(0, int(x + 0.5))


@dataclass(frozen=True)
class ResizeTarget:
    """kind: same, fit, exact, percent, area or cover. only: '', '<' or '>'."""

    kind: str = "same"
    width: float | None = None
    height: float | None = None
    only: str = ""

    @classmethod
    def parse(cls, text: str) -> ResizeTarget:
        g = Geometry.parse(text)
        if {"<", ">"} <= g.flags:
            raise GeometryError("< and > exclude one another")
        only = "".join(g.flags & {"<", ">"})
        neither = g.width is None and g.height is None
        if "@" in g.flags:
            return cls() if g.width is None else cls("area", nearest(g.width), None, only)
        if "%" in g.flags:
            return cls() if neither else cls("percent", g.width, g.width if g.height is None else g.height, only)
        w, h = (None if v is None else nearest(v) for v in (g.width, g.height))
        if "^" in g.flags:
            return cls() if neither else cls("cover", h if w is None else w, w if h is None else h, only)
        if "!" in g.flags:
            return cls("exact", w, h, only)
        if neither and only:
            raise GeometryError(f"{text!r} names no size to compare with")
        return cls() if neither else cls("fit", w, h, only)

    def size(self, w: Column, h: Column) -> tuple[Column, Column]:
        """Target width and height as long columns of the source's."""
        w, h = w.cast("long"), h.cast("long")
        if self.kind == "percent":
            if self.height == 100 and self.width in (None, 100):
                return w, h
            scaled = lambda v, p: v if p is None else F.round(v.cast("double") * p / 100.0).cast("long")
            return scaled(w, self.width), scaled(h, self.height)
        if self.kind == "area":
            scale = F.sqrt(F.lit(float(self.width)) / (w * h).cast("double"))
            return tuple(bounded(F.floor(v.cast("double") * scale).cast("long"), v, self.only) for v in (w, h))
        if self.kind == "exact":
            return tuple(at_least_one(bounded(v if t is None else long(t), v, self.only)) for v, t in ((w, self.width), (h, self.height)))
        if self.kind in ("fit", "cover"):
            only = self.only if self.kind == "fit" else ""
            targets = [long(UNBOUNDED if t is None else t) for t in (self.width, self.height)]
            if self.kind == "fit":
                targets = [at_least_one(bounded(t, v, only)) for t, v in zip(targets, (w, h), strict=True)]
            tw, th = targets
            narrow, wide = w * th < tw * h, w * th > tw * h  # against the target's shape
            by_height = at_least_one(F.round(w.cast("double") / h * th).cast("long"))
            by_width = at_least_one(F.round(h.cast("double") / w * tw).cast("long"))
            shrinks_width, shrinks_height = (narrow, wide) if self.kind == "fit" else (wide, narrow)
            return F.when(shrinks_width, by_height).otherwise(tw), F.when(shrinks_height, by_width).otherwise(th)
        return w, h


def long(v: float) -> Column:
    return F.lit(int(v)).cast("long")


def bounded(target: Column, source: Column, only: str) -> Column:
    """Keeps the source's size where the constraint forbids the target's."""
    return F.greatest(target, source) if only == "<" else F.least(target, source) if only == ">" else target


def at_least_one(v: Column) -> Column:
    return F.greatest(v, F.lit(1).cast("long"))


def parsed(text: Column) -> dict[str, Column]:
    """The grammar on a column of strings: numbers, flags and whether it is an error."""
    bare = F.regexp_replace(text, f"[{re.escape(FLAGS)}]", "")
    full = rf"^(?:({NUMBER})?x({NUMBER})?|({NUMBER})(?![+-]))?([+-]{NUMBER})?([+-]{NUMBER})?$"
    part = lambda k: F.regexp_extract(bare, full, k)
    number = lambda s: F.when(s != "", s).otherwise(None).cast("double")
    flagged = bare != text
    good = bare.rlike(full) & ((bare != "") | flagged)
    return {
        "width": number(F.concat(part(1), part(3))), "height": number(part(2)), "xoffset": number(part(4)), "yoffset": number(part(5)),
        "flags": F.regexp_replace(text, f"[^{re.escape(FLAGS)}]", ""), "error": ~good,
    }


@dataclass(frozen=True)
class Crop:
    """A rectangle; missing sides are the image's."""

    width: int | None = None
    height: int | None = None
    x: int = 0
    y: int = 0

    @classmethod
    def parse(cls, text: str) -> Crop:
        g = Geometry.parse(text)
        if "%" in g.flags:
            raise NotImplementedError("cropping by percentages")
        x, y = (0 if v is None else half_away(v) for v in (g.x, g.y))
        if x < 0 or y < 0:
            raise NotImplementedError("negative crop offsets")
        return cls(*(None if v is None else nearest(v) for v in (g.width, g.height)), x, y)

    @classmethod
    def parse_on_load(cls, text: str) -> Crop:
        g = Geometry.parse(text, flagged=False)
        values = (g.width, g.height, g.x, g.y)
        if any(v is None or v < 0 for v in values):
            raise GeometryError(f"not a rectangle: {text!r}")
        return cls(*map(nearest, values))


@dataclass(frozen=True)
class Blur:
    sigma: float = 1.2

    @classmethod
    def parse(cls, text: str) -> Blur:
        found = re.fullmatch(rf"([^x]*)(?:x({NUMBER}))?", text.strip(), re.A)
        if not found or not text.isascii():
            raise GeometryError(f"not a blur: {text!r}")
        if found[2] is not None:
            return cls(float(found[2]))
        if not re.fullmatch(NUMBER, found[1], re.A):
            raise GeometryError(f"not a blur: {text!r}")
        return cls()


@dataclass(frozen=True)
class Unsharp:
    radius: float = 0.0
    sigma: float = 0.0
    gain: float = 0.0
    threshold: int = 0

    @classmethod
    def parse(cls, text: str) -> Unsharp:
        found = re.fullmatch(rf"({NUMBER})(?:x({NUMBER}))?(?:\+({NUMBER})(?:\+(\d+))?)?", text, re.A)
        if not found:
            raise GeometryError(f"not an unsharp mask: {text!r}")
        r, s, g, t = found.groups()
        return cls(float(r), float(s or 0), float(g or 0), int(t or 0))
