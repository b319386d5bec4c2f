"""Character classes of the public tokenizers' split patterns, as ``re`` classes built from the Unicode database."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np

#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def ranges(major: str, top: int) -> str:
    """The characters up to top whose general category starts with major, as the inside of an ``re`` class."""
    out, start = [], None
    for point in range(top + 2):
        inside = point <= top and unicodedata.category(chr(point))[0] == major
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(out)


def top_of(text: str) -> int:
    """A bound of the text's characters: 255, 65535 or the last one. Patterns with small classes run several times faster."""
    if text.isascii():
        return 0xFF
    try:
        text.encode("latin-1")
        return 0xFF
    except UnicodeEncodeError:
        return 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode


@functools.cache
def disputed() -> re.Pattern:
    """Characters that a library with another version of Unicode may class, order or lower otherwise: those that Python leaves
    unassigned, and marks. None is below U+0300."""
    out, start = [], None
    for point in range(0x300, sys.maxunicode + 2):
        kind = unicodedata.category(chr(point)) if point <= sys.maxunicode else ""
        if (inside := kind == "Cn" or kind.startswith("M")) and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return re.compile(f"[{''.join(out)}]")


OTHER, LETTER, NUMBER, WHITE = range(4)


@functools.cache
def kinds_of_characters() -> np.ndarray:
    """For each code point whether it is a letter, a number, white space or another character (1 MB)."""
    names = "".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))
    first = np.frombuffer(names.encode("ascii"), np.uint8)[::2]
    out = np.full(len(first), OTHER, np.uint8)
    out[first == ord("L")], out[first == ord("N")] = LETTER, NUMBER
    out[[ord(c) for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c)]] = WHITE
    return out


@functools.cache
def word_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """Split of the vocabulary with word ends (word_bpe_49k), for texts up to a character."""
    letters, numbers = ranges("L", top), ranges("N", top)
    return re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
