"""Porter's suffix stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for lower-case words.

A word is C VC VC ... V, and its measure m counts the pairs VC in front of a suffix. Each step takes the longest of
its suffixes that the word ends with, and only if the stem in front meets the step's condition is it replaced.
"""

from __future__ import annotations

import re

# Fixed values of the published algorithm: suffix and what replaces it, longest first where one ends in another.
_STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VC = re.compile(r"vc")


def _kinds(word: str) -> str:
    """v or c for each letter; y is a vowel behind a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VC.findall(_kinds(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, and the last is none of w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, pairs, least: int) -> str:
    ending = max((p for p in pairs if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    if ending and _measure(stem := word[: len(word) - len(ending[0])]) >= least:
        return stem + ending[1]
    return word


def stem(word: str) -> str:
    """The stem of a word of ASCII letters; words of up to two letters, or with other characters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and progressive
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _kinds(word[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
                word = cut + "e"
            else:
                word = cut[:-1] if _doubled(cut) and cut[-1] not in "lsz" else cut
    # 1c: y behind a vowel further left
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, _STEP_2, 1)
    word = _replaced(word, _STEP_3, 1)
    # 4: what is left of double suffixes goes
    ending = max((e for e in _STEP_4 if word.endswith(e)), key=len, default="")
    cut = word[: len(word) - len(ending)]
    if ending and _measure(cut) > 1 and (ending != "ion" or cut.endswith(("s", "t"))):
        word = cut
    # 5: a final e, and one of two ls
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
