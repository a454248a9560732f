"""Identify templates, compiled to one string expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits and colourspace of each original colour type, and extensions.
DEPTHS = {"L1": 1, "L2": 2, "L4": 4, "L8": 8, "La8": 8, "Rgb8": 8, "Rgba8": 8, "L16": 16, "La16": 16, "Rgb16": 16, "Rgba16": 16, "Rgb32F": 32, "Rgba32F": 32, "Cmyk8": 8}
SPACES = {"L1": "Gray", "L2": "Gray", "L4": "Gray", "L8": "Gray", "La8": "Gray", "L16": "Gray", "La16": "Gray", "Rgb8": "sRGB", "Rgba8": "sRGB", "Rgb16": "sRGB", "Rgba16": "sRGB", "Rgb32F": "sRGB", "Rgba32F": "sRGB", "Cmyk8": "CMYK"}
FIRST_EXTENSION = {"png": "PNG", "jpeg": "JPG", "gif": "GIF", "webp": "WEBP", "tiff": "TIFF", "bmp": "BMP", "pnm": "PBM", "ff": "FF", "qoi": "QOI", "avif": "AVIF"}
LETTERS = "wWhHXYmiMGgz"


class TemplateError(ValueError):
    """A template with an unknown letter or a dangling escape."""


def tokens(template: str) -> list[tuple[str, str]]:
    """('text', s) and ('var', letter) in order."""
    out: list[tuple[str, str]] = []
    text, at = "", 0
    while at < len(template):
        c, ahead = template[at], template[at + 1 : at + 2]
        if c == "\\":
            if ahead not in ("n", "%", "\\"):
                raise TemplateError(f"unknown escape at {at}")
            text += {"n": "\n"}.get(ahead, ahead)
            at += 2
        elif c == "%" and at and template[at - 1].isdigit() and ahead != "%":
            text, at = text + c, at + 1
        elif c == "%":
            if ahead == "%":
                text += "%"
            elif ahead and ahead in LETTERS:
                out += [("text", text)] * bool(text) + [("var", ahead)]
                text = ""
            else:
                raise TemplateError(f"unknown shorthand variable %{ahead}")
            at += 2
        else:
            text, at = text + c, at + 1
    return out + [("text", text)] * bool(text)


def looked_up(values: dict[str, object], key: Column, other: str = "") -> Column:
    """A small fixed table as one expression."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], str(kv[1]))])
    return F.coalesce(table[F.coalesce(key, F.lit(""))], F.lit(other))


def variable(letter: str) -> Column:
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    if letter in "wW":
        return F.col("width").cast("string")
    if letter in "hH":
        return F.col("height").cast("string")
    if letter in "XY":
        return F.lit("+0")
    if letter == "m":
        return looked_up(FIRST_EXTENSION, F.col("format"))
    if letter in "iM":
        return F.coalesce(F.col("filename"), F.lit(""))
    if letter == "z":
        return looked_up(DEPTHS, F.col("orig_color_type"))
    return size if letter == "G" else F.concat(size, F.lit("+0+0"))


def text(template: str | None = None) -> Column:
    """The identify text of an image row."""
    if template is not None:
        parts = [F.lit(v) if kind == "text" else variable(v) for kind, v in tokens(template)]
        return F.concat(*parts) if parts else F.lit("")
    space = looked_up(SPACES, F.col("orig_color_type"))
    return F.concat(
        variable("i"), F.lit(" "), variable("m"), F.lit(" "), variable("G"), F.lit(" "), variable("g"), F.lit(" "),
        variable("z"), F.lit("-bit "), space, F.lit("\n"),
    )
