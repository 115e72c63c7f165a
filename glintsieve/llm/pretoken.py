"""Cuts of a text that no pre-token of the byte-level pattern spans, so that pieces can be encoded once and reused.

A pre-token takes at most one space, at its front. Before a space that stands between two characters that are not
white space, a pre-token always begins, and no look-ahead crosses it. Texts are therefore split there.

`cuts` finds more of them in the bytes of many texts: before white space, between letters, digits and punctuation, and
around the last character of a run of white space. Characters whose class it does not know are left together with their neighbours.
"""

from __future__ import annotations

import re

import numpy as np

#: White space other than the space and the line feed.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def can_split(text: str) -> bool:
    """Whether a text may be split at its spaces: none stands beside other white space or at an end."""
    return not (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text))


def chunks(text: str) -> list[str] | None:
    """The text split at its spaces, each of which goes with what follows it, or None where it may not be split so."""
    if not can_split(text):
        return None
    parts = text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]]


# Classes of bytes: 0 unknown (nothing is cut beside it), 6 no white space but else unknown; 8 and 9 are lead bytes to look at.
_LETTER, _DIGIT, _PUNCTUATION, _APOSTROPHE, _SPACE, _SOLID, _WHITE, _LETTER_LEAD, _WHITE_LEAD = range(1, 10)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _PUNCTUATION
_CLASS[[ord("'"), ord(" ")]] = _APOSTROPHE, _SPACE
_CLASS[[9, 10, 11, 12, 13]] = _WHITE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:] = _SOLID
_CLASS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = _LETTER_LEAD  # U+00C0 to U+023F and U+0400 to U+047F, letters but two
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _WHITE_LEAD
#: White space beyond ASCII, as UTF-8; U+180E was white space in old versions of Unicode.
_WIDE_SPACE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])

_IS_SOLID, _IS_WHITE = np.zeros(16, bool), np.zeros(16, bool)
_IS_SOLID[[_LETTER, _DIGIT, _PUNCTUATION, _APOSTROPHE, _SOLID]] = True
_IS_WHITE[[_SPACE, _WHITE]] = True
_GROUP = np.arange(16)
_GROUP[_APOSTROPHE] = _PUNCTUATION
_KNOWN = (_GROUP >= _LETTER) & (_GROUP <= _PUNCTUATION)
#: By 16 times the class before and the class after: whether a pre-token always begins between them.
_PAIR = (_IS_SOLID[:, None] & _IS_WHITE) | (_KNOWN[:, None] & _KNOWN & (_GROUP[:, None] != _GROUP))
_PAIR[_APOSTROPHE, _LETTER] = False  # 's, 're and so on
_PAIR = _PAIR.ravel()


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of some UTF-8, that of its character."""
    out = _CLASS[data]
    at = np.flatnonzero(out == _LETTER_LEAD)
    if len(at):
        sign = (data[at] == 0xC3) & ((data[at + 1] == 0x97) | (data[at + 1] == 0xB7))  # × and ÷
        out[at] = out[at + 1] = np.where(sign, _SOLID, _LETTER)
    at = np.flatnonzero(out == _WHITE_LEAD)
    if len(at):
        out[at] = _SOLID
        two = at[(data[at] == 0xC2) & ((data[at + 1] == 0x85) | (data[at + 1] == 0xA0))]
        out[two] = out[two + 1] = 0
        at = at[data[at] != 0xC2]
        three = at[np.isin(data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2], _WIDE_SPACE)]
        out[three] = out[three + 1] = out[three + 2] = 0
    return out


def cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """By byte: whether a piece begins there. Pieces of a text, encoded one by one, give its ids."""
    n = len(data)
    kind = classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    out = first.copy()
    if n < 2:
        return out[:n]
    out[1:n] |= _PAIR[kind[:-1] << 4 | kind[1:]]
    # a run of white space before something else gives up its last character, which stands alone if it is no space
    white = _IS_WHITE[kind]
    at = np.flatnonzero(white[1:-1] & white[:-2]) + 1
    out[at[_IS_SOLID[kind[at + 1]] & ~first[at + 1]]] = True
    at = np.flatnonzero(kind[:-1] == _WHITE) + 1
    out[at[_IS_SOLID[kind[at]] & out[at - 1]]] = True
    return out[:n]


def strung(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces, which begin with a space and something else, and which with something else; both end with no white space."""
    kind = np.append(classes(data), np.zeros(2, np.uint8))
    head, end = offsets[:-1], _IS_SOLID[kind[offsets[1:] - 1]] & (offsets[1:] > offsets[:-1])
    return end & (kind[head] == _SPACE) & _IS_SOLID[kind[head + 1]], end & _IS_SOLID[kind[head]]
