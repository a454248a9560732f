"""Token ids of whole texts, with a bounded cache of encoded words.

Invented or rare words make byte-pair merging the whole cost of tokenising. A
text is cut only at single spaces between two non-blank characters: a byte-level
pre-tokeniser starts a new piece at each such space, so the ids of a text are
the ids of its cuts, one after another. Each distinct cut of a slice of texts is
looked up in a cache of words that have been met before, or else encoded by the
library's merge model. Any other kind of
tokenizer, and any text with other runs of blanks, goes to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID_OF = attrgetter("id")
#: Letters, and some numbers that are told apart afterwards.
LETTERS = re.compile(r"[^\W\d_]+").match
#: Longer pieces aren't kept, so that a number of entries bounds the bytes.
KEPT_CHARS = 48
#: Texts are cut and looked up in slices of about so many bytes.
PART_BYTES = 8 << 20

#: The library's byte-level pattern, a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(shifted)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Holds at most ``room`` words (and those of one slice) and half as many pieces and rests each, some
    150 bytes an entry and 600 at most: with the default some 60 MB."""

    def __init__(self, path: str, room: int = 250_000):
        self.path, self.room = path, room
        self.words: dict[str, bytes] = {}  # ids of words that follow one space
        self.pieces: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.kind, self.model = "sentencepiece", sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        cuttable = (
            spec["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(t["special"] and not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in spec["added_tokens"])
        )
        self.kind = "cut" if cuttable else "whole"
        if cuttable:
            import regex

            self.split = regex.compile(PIECES).findall
            self.tokenize = self.tokenizer.model.tokenize
            self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
            self.space = " ".translate(self.alphabet)
            self.added = [t["content"] for t in spec["added_tokens"]]

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def merged(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, by the library's merge model."""
        if piece.isascii() and piece.isprintable():  # these stand for themselves but the space
            spelt = piece.replace(" ", self.space)
        else:
            spelt = piece.encode().decode("latin-1").translate(self.alphabet)
        found = array("I", map(ID_OF, self.tokenize(spelt)))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def piece(self, piece: str) -> bytes:
        known = self.pieces
        ids = known.get(piece)
        if ids is None:
            ids = self.merged(piece)
            self._keep(known, piece, ids)
        return ids

    def cut(self, cut: str) -> bytes:
        """Ids of one cut, with its leading space if it has one."""
        if any(a in cut for a in self.added):
            return self._whole([cut])[0]
        return b"".join(map(self.piece, self.split(cut)))

    def rest(self, rest: str) -> bytes:
        """Ids of what follows the letters that a cut starts with."""
        known = self.rests
        ids = known.get(rest)
        if ids is None:
            ids = self.cut(rest)
            self._keep(known, rest, ids)
        return ids

    def _keep(self, known: dict[str, bytes], piece: str, ids: bytes) -> None:
        if len(piece) <= KEPT_CHARS:
            if len(known) >= self.room // 2:
                known.clear()
            known[piece] = ids

    def _known(self, names: list[str], times: np.ndarray) -> list[bytes | None]:
        """Ids of distinct words that follow one space; None for a word with a blank at
        an edge, whose text must be encoded whole.

        Letters end where anything else begins, so a word that starts with letters is
        those letters' ids and the rest's. Words met several times are kept: those
        that stand once would push out the others."""
        words, space, tokenize, swap = self.words, self.space, self.tokenize, sys.byteorder == "big"
        get, out, often = words.get, list(map(words.get, names)), (times > 1).tolist()
        for k, ids in enumerate(out):
            if ids is not None:
                continue
            word = names[k]
            if word.isalpha():
                if word.isascii() and not swap:  # ASCII letters are spelt as they are
                    ids = array("I", map(ID_OF, tokenize(space + word))).tobytes()
                else:
                    ids = self.merged(" " + word)
            elif not word or word[0].isspace() or word[-1].isspace():
                continue
            elif (stem := LETTERS(word)) and (letters := stem[0]).isalpha():
                ids = (get(letters) or self.merged(" " + letters)) + self.rest(word[stem.end() :])
            else:
                ids = self.cut(" " + word)
            out[k] = ids
            if often[k] and len(word) <= KEPT_CHARS:
                words[word] = ids
        if len(words) > self.room:  # the words of this slice are the likeliest to come again
            self.words = {w: ids for w, ids, many in zip(names, out, often, strict=True) if many and ids is not None and len(w) <= KEPT_CHARS}
        return out

    def _cut(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all texts one after another, and each text's number of them.

        Words are told apart by Arrow, so each distinct word of ``texts`` is looked up
        once. The first word of a text follows no space and stands for itself."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        begins = offsets[:-1]
        coded = split.flatten().dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int32)
        del split, coded
        firsts = [names[k] for k in at[begins].tolist()]
        known = self._known(names, np.bincount(at, minlength=len(names)))
        at[begins] = len(names) + np.arange(len(firsts))
        several = np.diff(offsets) > 1
        lone = [not s or bool(w) and not w[-1].isspace() for w, s in zip(firsts, several.tolist(), strict=True)]
        found = [*known, *(self.cut(w) if ok else None for w, ok in zip(firsts, lone, strict=True))]
        uneven = np.fromiter((x is None for x in found), bool, len(found))
        whole = np.flatnonzero(np.logical_or.reduceat(uneven[at], begins)) if uneven.any() else np.zeros(0, np.int64)
        found = [x or b"" for x in found]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        blob, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[at]
        for k in whole.tolist():
            each[offsets[k] : offsets[k + 1]] = 0
        del found
        counts = np.add.reduceat(each, begins, dtype=np.int64)
        places = np.repeat(starts[at] - (np.cumsum(each, dtype=np.int32) - each), each)
        places += np.arange(len(places), dtype=np.int32)
        flat = blob[places].tobytes()
        del places, blob
        if len(whole):
            ends = 4 * np.cumsum(counts)
            own = self._whole([texts[k].as_py() for k in whole.tolist()])
            pieces, last = [], 0
            for k, ids in zip(whole.tolist(), own, strict=True):
                pieces += [flat[last : ends[k]], ids]
                last = int(ends[k])
                counts[k] = len(ids) // 4
            flat = b"".join([*pieces, flat[last:]])
        return flat, counts

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as bytes; null is the empty text."""
        out: list[bytes] = []
        for part in self._parts(texts):
            if self.kind == "cut":
                flat, counts = self._cut(part)
                ends = (4 * np.cumsum(counts)).tolist()
                out += [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            elif self.kind == "sentencepiece":
                out += [np.array(x, "<u4").tobytes() for x in self.model.encode(part.to_pylist(), num_threads=1)]
            else:
                out += self._whole(part.to_pylist())
        return out

    def counts(self, texts: Sequence[str | None] | pa.Array) -> list[int]:
        """The number of ids of each text."""
        return [len(x) // 4 for x in self.encode(texts)]

    def _parts(self, texts: Sequence[str | None] | pa.Array) -> Iterator[pa.Array]:
        """``texts`` without nulls, in slices of some PART_BYTES; a longer text is a slice."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART_BYTES, side="right")))
            yield column.slice(at, end - at)
            at = end


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    return Encoder(located(tokenizer))


def located(tokenizer: str) -> str:
    """The file of a tokenizer on the machine that asks: a path stays as it is, a
    bare name is looked up among the installed public tokenizers."""
    if os.path.dirname(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


@lru_cache(maxsize=8)
def version(tokenizer: str) -> str:
    """Digest of the tokenizer file: counts under another version never match."""
    with open(located(tokenizer), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def default_tokenizer() -> str:
    return "byte_bpe_50k.json"
