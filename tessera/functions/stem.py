"""English stems by Porter's algorithm (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "aeiou"

# The suffixes of steps 2, 3 and 4 of the algorithm, with what stands for them.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """One letter for each of ``w``: v for a vowel (y after a consonant is one), c for a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in _VOWEL or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    """How often a vowel group is followed by a consonant group."""
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem of a word in small letters; words of one or two letters, and others than ASCII, stay."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)][-1:] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
