"""Convert-style command lines, planned on the driver and run as DataFrames.

A plan is a list of steps over one image sequence: read a file, map an operator,
combine, or write. Plans are rewritten before any DataFrame is built; identify's
text is an extra output, ordered by step and image.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import identify, output, raster
from lumenframe.functions.geometry import Blur, Crop, ResizeTarget, Unsharp
from lumenframe.operators import kernels
from lumenframe.operators.combine import MODELS, combine
from lumenframe.operators.monochrome import monochrome
from lumenframe.sources import files, names

OPTIONS = {
    "auto-orient": (0, "turn the image as its EXIF block says"), "blur": (1, "blur fast"), "colorspace": (1, "model of combined images"),
    "combine": (0, "make one image of single channels"), "crop": (1, "cut out a rectangle"), "filter": (1, "kernel of later resizes"),
    "flip": (0, "mirror vertically"), "flop": (0, "mirror horizontally"), "format": (1, "template of later identifies"),
    "gaussian-blur": (1, "blur with a Gaussian"), "grayscale": (1, "convert to grey"), "identify": (0, "print characteristics"),
    "monochrome": (0, "convert to black and white"), "negate": (0, "invert"), "quality": (1, "compression of all outputs"),
    "resize": (1, "resize"), "sample": (1, "resize by nearest cells"), "scale": (1, "resize by areas"), "strip": (0, "drop EXIF and ICC"),
    "thumbnail": (1, "resize fast and drop EXIF"), "unsharp": (1, "sharpen"), "write": (1, "write the sequence so far"),
}
#: Names of grey methods, in any case.
GRAY_METHODS = ["average", "brightness", "lightness", "ms", "mean", "rms", "rec601luma", "rec601luminance", "rec709luma", "rec709luminance"]
#: A decimal number as the command line takes it.
NUMERAL = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)", re.A | re.I)


class UsageError(ValueError):
    """A command line that isn't accepted."""


@dataclass(frozen=True)
class Op:
    """kind: an option's name, or 'load-crop'. value: its parsed argument."""

    kind: str
    value: object = None
    kernel: str | None = None

    def run(self, df: DataFrame) -> DataFrame:
        v = self.value
        simple: dict[str, Callable[[DataFrame], DataFrame]] = {
            "auto-orient": raster.auto_orient, "flip": raster.flip, "flop": raster.flop, "negate": raster.negate, "monochrome": monochrome,
            "grayscale": raster.grayscale, "crop": lambda d: raster.crop(d, v), "load-crop": lambda d: raster.crop(d, v),
            "resize": lambda d: kernels.resize(d, v, self.kernel), "scale": lambda d: kernels.resize(d, v, "Box"),
            "sample": lambda d: raster.sample(d, v), "thumbnail": lambda d: kernels.thumbnail(d, v, self.kernel),
            "blur": lambda d: kernels.blur(d, v.sigma), "gaussian-blur": lambda d: kernels.gaussian_blur(d, v.sigma),
            "unsharp": lambda d: kernels.unsharp(d, v.sigma, v.threshold),
        }
        if self.kind == "grayscale" and v != "rec709luma":
            raise NotImplementedError(f"grey method {v}")
        return simple[self.kind](df)


@dataclass(frozen=True)
class Step:
    """what: read, map, combine, identify or write."""

    what: str
    op: Op | None = None
    name: names.InputName | None = None
    ops: tuple[Op, ...] = ()
    target: tuple[str, str | None] | None = None
    template: str | None = None
    model: str = "Rgb8"
    fallback: bool = True


@dataclass(frozen=True)
class Settings:
    kernel: str | None = None
    template: str | None = None
    colorspace: str | None = None
    quality: float | None = None
    strip_exif: bool = False
    strip_icc: bool = False


@dataclass
class Plan:
    steps: list[Step] = field(default_factory=list)
    settings: Settings = Settings()


def is_option(word: str) -> bool:
    return word[:1] in "-+" and word[1:2].isascii() and word[1:2].isalpha()


def value_of(option: str, text: str) -> object:
    if option in ("resize", "sample", "scale", "thumbnail"):
        return ResizeTarget.parse(text)
    if option == "crop":
        return Crop.parse(text)
    if option in ("blur", "gaussian-blur"):
        return Blur.parse(text)
    if option == "unsharp":
        return Unsharp.parse(text)
    if option == "grayscale":
        if text.lower() not in GRAY_METHODS:
            raise UsageError(f"unknown grey method: {text}")
        return text.lower()
    return text


def parse(argv: Iterable[str], is_dir: Callable[[str], bool | None] | None = None, exists: Callable[[str], bool] = os.path.exists) -> Plan:
    """The plan of a command line whose last word is the output."""
    words = list(argv)
    is_dir = is_dir or (lambda p: os.path.isdir(p) if os.path.exists(p) else None)
    if not words or is_option(words[-1]):
        raise UsageError("no output file")
    last = words.pop()
    plan, before, at = Plan(), [], 0
    while at < len(words):
        word, at = words[at], at + 1
        if not is_option(word):
            name = names.input_name(word, is_dir)
            plan.steps.append(Step("read", name=name, ops=tuple(rebound(before, plan.settings, name.modifier))))
            continue
        option, plus = word[1:], word[0] == "+"
        if option not in OPTIONS or (plus and option != "combine"):
            raise UsageError(f"unknown option: {word}")
        text = None
        if OPTIONS[option][0] or plus:
            if at >= len(words):
                raise UsageError(f"argument requires a value: {option}")
            text, at = words[at], at + 1
        plan.settings = apply(plan, before, option, text, plus, exists)
    if not any(s.what == "read" for s in plan.steps):
        raise UsageError("no input file")
    plan.steps.append(Step("write", target=names.output_name(last, exists)))
    return plan


def rebound(before: list[Op], now: Settings, modifier) -> list[Op]:
    """Operators named before any input, with the settings as they are now; a read
    modifier comes first."""
    first = [] if modifier is None else [Op("load-crop", modifier) if isinstance(modifier, Crop) else Op("resize", modifier)]
    late = {"resize", "thumbnail"}
    again = [replace(o, kernel=now.kernel) if o.kind in late else replace(o, value=now.template) if o.kind == "identify" else o for o in before]
    return first + again


def apply(plan: Plan, before: list[Op], option: str, text: str | None, plus: bool, exists: Callable[[str], bool]) -> Settings:
    """Adds an option to the plan; gives the settings from here on."""
    now = plan.settings
    if option == "filter":
        return replace(now, kernel=output.kernel_name(text))
    if option == "format":
        identify.tokens(text)
        return replace(now, template=text)
    if option == "colorspace":
        if text.lower() not in MODELS:
            raise UsageError(f"unknown colorspace: {text}")
        return replace(now, colorspace=text.lower())
    if option == "quality":
        return replace(now, quality=number(text))
    if option == "strip":
        return replace(now, strip_exif=True, strip_icc=True)
    if option in ("combine", "write"):
        if not plan.steps:
            raise UsageError(f"no images for {option}")
        if option == "write":
            plan.steps.append(Step("write", target=names.output_name(text, exists)))
        else:
            space = text.lower() if plus else now.colorspace
            if space is not None and space not in MODELS:
                raise UsageError(f"unknown colorspace: {text}")
            plan.steps.append(Step("combine", model=MODELS.get(space, "Rgb8"), fallback=not plus))
        return now
    op = Op(option, now.template if option == "identify" else value_of(option, text or ""), now.kernel if option in ("resize", "thumbnail") else None)
    if plan.steps:
        plan.steps.append(Step("identify", template=op.value) if option == "identify" else Step("map", op=op))
    else:
        before.append(op)
    return replace(now, strip_exif=True, strip_icc=False) if option == "thumbnail" else now


def number(text: str) -> float:
    if not NUMERAL.fullmatch(text.strip()):
        raise UsageError(f"not a number: {text}")
    return float(text)


TWICE_IS_NOTHING = {"flip", "flop", "negate"}
POINTWISE = {"negate", "grayscale"}


def optimised(steps: list[Step]) -> list[Step]:
    """Drops pairs that undo each other and unchanged resizes; moves crops before
    pointwise operators. Reads, writes, identifies and combines stay where they are."""
    out: list[Step] = []
    for step in steps:
        if step.what == "map" and isinstance(step.op.value, ResizeTarget) and step.op.value.kind == "same" and step.op.kind != "thumbnail":
            continue
        same = out and out[-1].what == step.what == "map" and out[-1].op == step.op
        if same and step.op.kind in TWICE_IS_NOTHING:
            out.pop()
            continue
        at = len(out)
        if step.what == "map" and step.op.kind == "crop":
            while at and out[at - 1].what == "map" and out[at - 1].op.kind in POINTWISE:
                at -= 1
        out.insert(at, step)
    return out


@dataclass
class Result:
    """``held`` are sequences that several outputs share; ``save`` lets go of them."""

    images: DataFrame
    texts: list[DataFrame]
    outputs: list[DataFrame]
    held: list[DataFrame] = field(default_factory=list)


def runs(steps: list[Step]) -> Iterator[list[Step]]:
    """Neighbouring reads of the same kind together, all other steps alone."""
    for _, same in itertools.groupby(enumerate(steps), key=lambda x: ("read", x[1].name.format, x[1].ops) if x[1].what == "read" else x[0]):
        yield [step for _, step in same]


def execute(spark: SparkSession, plan: Plan, rewrite: bool = True, read: Callable[[list[names.InputName], int], DataFrame] | None = None) -> Result:
    """Lazy: images, identify texts (``step, seq, text``) and outputs (``step, seq, path, content``).

    Inputs that stand together are one scan. A sequence that is written and then goes
    on is kept, so that it is read and computed once."""

    def files_of(names_: list[names.InputName], first: int) -> DataFrame:
        if names_[0].format == "null":
            return reduce(DataFrame.unionByName, [files.blank(spark, first + k) for k in range(len(names_))])
        return files.read_images(spark, [n.location for n in names_], names_[0].format, first)

    read = read or files_of
    sequence: DataFrame | None = None
    count = 0
    result = Result(None, [], [])
    now = plan.settings

    def identified(df: DataFrame, template: str | None, step: int) -> None:
        result.texts.append(df.select(F.lit(step).alias("step"), "seq", identify.text(template).alias("text")))

    steps = list(runs(optimised(plan.steps) if rewrite else plan.steps))
    for k, same in enumerate(steps):
        step = same[0]
        if step.what == "read":
            df = read([s.name for s in same], count)
            for op in step.ops:
                if op.kind == "identify":
                    identified(df, op.value, k)
                else:
                    df = op.run(df)
            sequence, count = (df if sequence is None else sequence.unionByName(df)), count + len(same)
        elif step.what == "map":
            sequence = step.op.run(sequence)
        elif step.what == "combine":
            sequence = combine(sequence.withColumn("__one", F.lit(1)), "__one", step.model, step.fallback).drop("__one")
            count = 1
        elif step.what == "identify":
            identified(sequence, step.template, k)
        elif step.target[1] != "null":
            if k + 1 < len(steps):
                sequence = sequence.persist(StorageLevel.MEMORY_AND_DISK)
                result.held.append(sequence)
            result.outputs.append(written(sequence, step.target, now, k, count > 1))
    result.images = sequence
    return result


def written(df: DataFrame, target: tuple[str, str | None], now: Settings, step: int, many: bool) -> DataFrame:
    """An image's format is the prefix's, else its name's, else its input's."""
    path, explicit = target
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    kind = explicit or output.FORMATS.get(ext)
    chosen = kind or output.chosen_format(F.lit(None).cast("string"), F.lit(path), F.col("format"))
    rows = files.encoded(df, chosen, now.quality, now.strip_exif, now.strip_icc)
    return rows.select(F.lit(step).alias("step"), "seq", output.numbered(F.lit(path), F.col("seq"), many).alias("path"), "content")


def write_files(rows: Iterable) -> None:
    for row in rows:
        with open(row.path, "wb") as f:
            f.write(row.content)


def save(result: Result, shared: bool | None = None) -> list[str]:
    """Writes the outputs and returns their names, in order.

    Where executors see the folder (``shared``; by default on a single machine) they
    write their own images; else, and for ``-``, images pass through the driver one
    by one."""
    import sys

    done = []
    for df in result.outputs:
        here = df.sparkSession.sparkContext.master.startswith("local") if shared is None else shared
        paths = [r.path for r in df.select("path", "seq").orderBy("seq").collect()]
        if here and "-" not in paths:
            df.select("path", "content").foreachPartition(write_files)
        else:
            for row in df.orderBy("seq").toLocalIterator():
                if row.path == "-":
                    sys.stdout.buffer.write(row.content)
                    sys.stdout.buffer.flush()
                else:
                    write_files([row])
        done += paths
    for df in result.held:
        df.unpersist()
    return done


def help_text() -> str:
    return "Usage: lumenframe [options] input... [options] output\n" + "".join(f"  -{k}{' value' if n else ''}  {text}\n" for k, (n, text) in OPTIONS.items())


def main(argv: list[str]) -> int:
    """The command line: 0, or 1 after an error."""
    import sys

    if not argv or argv[0] in ("-help", "--help"):
        print(help_text(), end="")
        return 0
    spark = SparkSession.builder.getOrCreate()
    try:
        result = execute(spark, parse(argv))
        save(result)
        for df in result.texts:
            for row in df.orderBy("seq").toLocalIterator():
                print(row.text, end="")
    except Exception as e:
        print(f"lumenframe: {e}", file=sys.stderr)
        return 1
    return 0
