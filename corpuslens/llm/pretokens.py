"""Splitting texts into the matches of the tokenizer's pattern, many texts at once.

Texts of ASCII, Latin letters and common punctuation are split by byte classes in numpy; a text with any
other character goes to the `regex` library. Both give the matches of PATTERN in order (see the tests).
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import public_tokenizers

from corpuslens.llm.common import distinct_spans, joined

OTHER_SPACE, SPACE, LETTER, NUMBER, OTHER = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[9, 10, 11, 12, 13]] = OTHER_SPACE
    out[32] = SPACE
    out[48:58] = NUMBER
    out[65:91] = out[97:123] = LETTER
    out[0xC3:0xCB] = LETTER  # lead bytes of U+00C0 to U+02BF; _fast_starts() takes out the two signs among them
    return out


_CLASS = _classes()
#: Bytes that send a text to the slow path: separators 1C to 1F, and lead bytes outside the fast alphabet.
_SLOW = np.zeros(256, bool)
_SLOW[0x1C:0x20] = True
_SLOW[0xCB:0xE2] = True
_SLOW[0xE3:] = True
#: Second bytes after C2 that are white space or numbers (U+0085, U+00A0, superscripts, fractions).
_SLOW_C2 = np.zeros(256, bool)
_SLOW_C2[[0x85, 0xA0, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True


@functools.lru_cache(1)
def _pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@functools.lru_cache(1)
def _byte_level():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


def slow_split(text: bytes) -> list[bytes]:
    """The matches by the `regex` library, with the white space of Unicode.

    It may know newer letters than the tokenizers do; a text with a character that Python does not know is split by
    the pre-tokenizer of their library (four times slower, equal to tiktoken's split for every character).
    """
    read = text.decode("utf-8", "replace")
    if any(unicodedata.category(c) == "Cn" for c in set(read)):
        return [read[a:b].encode() for _, (a, b) in _byte_level().pre_tokenize_str(read)]
    return [m.encode() for m in _pattern().findall(read)]


def _slow_positions(data: np.ndarray) -> np.ndarray:
    slow = _SLOW[data]
    for lead in (0xC2, 0xE2):
        at = np.flatnonzero(data == lead)
        if len(at):
            second = data[np.minimum(at + 1, len(data) - 1)]
            if lead == 0xC2:
                slow[at] |= _SLOW_C2[second]
            else:
                third = data[np.minimum(at + 2, len(data) - 1)]
                good = (second == 0x80) & (((third >= 0x90) & (third <= 0xA7)) | (third >= 0xB0)) | (second == 0x81) & (third <= 0x9E)
                slow[at] |= ~good
    return np.flatnonzero(slow)


def _fast_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes begin a match; each text is followed by one newline that belongs to none."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC2)
    if len(lead):
        kind[lead] = np.where(np.isin(data[lead + 1], (0xAA, 0xB5, 0xBA)), LETTER, OTHER)
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        kind[lead[np.isin(data[lead + 1], (0x97, 0xB7))]] = OTHER  # the signs of multiplication and division
    latin = np.flatnonzero((data >= 0xC2) & (data <= 0xCA))
    kind[latin + 1] = kind[latin]
    space = kind <= SPACE
    begins = np.empty(len(data), bool)
    begins[0] = True
    # A run of white space begins with any first white space, a run of another class with its change.
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[1:] &= ~(space[1:] & space[:-1])
    after = np.flatnonzero(~space[1:] & space[:-1]) + 1
    begins[after - 1] = True
    begins[after] = data[after - 1] != 32
    ends = starts[1:] - 1
    begins[starts[:-1]] = True
    begins[ends] = True
    quote = np.flatnonzero((data == 39) & begins)
    if len(quote):
        padded = np.concatenate([data[: quote[-1] + 4], np.zeros(4, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = quote[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
        long = quote[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]
        begins[short + 1] = False
        begins[long + 1] = False
        begins[short + 2] = True
        begins[long + 3] = True
    return begins


def split_texts(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts first..last-1: their distinct matches, the number of each match in order, and n + 1 offsets by text."""
    buffer, starts = joined(data, offsets, first, last)
    slow = np.unique(np.searchsorted(starts, _slow_positions(buffer), side="right") - 1)
    begins = _fast_starts(buffer, starts)
    is_end = np.zeros(len(buffer), bool)
    is_end[starts[1:] - 1] = True
    at = np.flatnonzero(begins)
    to = np.append(at[1:], len(buffer))
    keep = ~is_end[at]
    text_of = np.searchsorted(starts, at, side="right") - 1
    if len(slow):
        keep &= ~np.isin(text_of, slow)
    at, to, text_of = at[keep], to[keep], text_of[keep]
    words, number = distinct_spans(buffer, at, to)
    counts = np.bincount(text_of, minlength=last - first)
    if not len(slow):
        return words, number, np.concatenate([[0], np.cumsum(counts)])
    known = {w: k for k, w in enumerate(words)}
    parts, begin = [], np.concatenate([[0], np.cumsum(counts)])
    slow_set = set(slow.tolist())
    for k in range(last - first):
        if k in slow_set:
            found = slow_split(buffer[starts[k] : starts[k + 1] - 1].tobytes())
            numbers = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
            counts[k] = len(found)
        else:
            numbers = number[begin[k] : begin[k + 1]]
        parts.append(numbers)
    return list(known), np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
