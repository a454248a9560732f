"""Names on the command line: inputs with format prefix and read modifier, outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lumenframe.functions.geometry import Crop, ResizeTarget
from lumenframe.functions.output import FORMATS

STDIN = "-"


@dataclass(frozen=True)
class InputName:
    location: str
    format: str | None = None  # 'null' reads nothing
    modifier: ResizeTarget | Crop | None = None


def bracketed(name: str) -> tuple[str, str] | None:
    """``path[inner]`` split at the last opening bracket."""
    if not name.endswith("]"):
        return None
    head, mark, inner = name[:-1].rpartition("[")
    return (head, inner) if mark else None


def prefixed(name: str) -> tuple[str, str] | None:
    """``format:path`` if the format is known."""
    head, mark, rest = name.partition(":")
    known = FORMATS | {"null": "null"}
    return (known[head.lower()], rest) if mark and head.lower() in known else None


def read_modifier(text: str) -> ResizeTarget | Crop | None:
    if text.count("x") == 1 and text.count("+") == 0:
        return ResizeTarget.parse(text)
    if text.count("x") == 1 and text.count("+") == 2:
        return Crop.parse_on_load(text)
    if text and not set(text) - set("0123456789-+,"):
        if text == "0":
            return None
        raise NotImplementedError("frame selection other than [0]")
    raise ValueError(f"invalid read modifier: [{text}]")


def input_name(name: str, is_dir: Callable[[str], bool | None]) -> InputName:
    """Resolves an input. ``is_dir`` says True or False for an existing path, else None.

    The name as it stands wins if it is a file; then it is tried without its
    modifier, then without its format as well."""
    if name in ("", STDIN):
        return InputName(STDIN)
    if is_dir(name) is False:
        return InputName(name)
    cut = bracketed(name)
    path, inner = cut or (name, None)
    modifier = None if inner is None else read_modifier(inner)
    if cut and is_dir(path) is False:
        return InputName(path, None, modifier)
    found = prefixed(path)
    fmt, path = found or (None, path)
    if fmt == "null":
        return InputName(path, "null", modifier)
    if path in ("", STDIN):
        return InputName(STDIN, fmt, modifier)
    if is_dir(path) is None:
        raise FileNotFoundError(name)
    return InputName(path, fmt, modifier)


def output_name(name: str, exists: Callable[[str], bool]) -> tuple[str, str | None]:
    """(location, format). A prefix counts unless a file of the whole name exists."""
    found = None if name == STDIN or exists(name) else prefixed(name)
    return (name, None) if found is None else (found[1] or STDIN, found[0])
