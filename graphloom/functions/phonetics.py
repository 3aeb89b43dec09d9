"""Stems and sound codes of single words. They run once for each distinct term of a vocabulary, never per occurrence."""

from __future__ import annotations

import re



def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    shape = "".join("v" if _vowel_at(stem, k) else "c" for k in range(len(stem)))
    return len(re.findall("v+c+", shape))


def _vowel_at(word: str, k: int) -> bool:
    return word[k] in "aeiou" or (word[k] == "y" and k > 0 and not _vowel_at(word, k - 1))


def _has_vowel(stem: str) -> bool:
    return any(_vowel_at(stem, k) for k in range(len(stem)))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    n = len(word)
    return n >= 3 and not _vowel_at(word, n - 1) and _vowel_at(word, n - 2) and not _vowel_at(word, n - 3) and word[-1] not in "wxy"


_LONG = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_MIDDLE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _suffixed(word: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of an English word by Porter's algorithm (1980); words of one or two letters stay."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowel_at(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _suffixed(_suffixed(w, _LONG), _MIDDLE)
    for end in sorted(_LAST, key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def metaphone(word: str) -> str:
    """The sound of an English word by the Metaphone rules (Philips, 1990): consonants, and a vowel only in front."""
    w = re.sub(r"[^A-Z]", "", _ascii_upper(word))
    w = re.sub(r"([ABD-Z])\1+", r"\1", w)
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = []
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    k = 0
    while k < len(w):
        c, after, before = w[k], at(k + 1), at(k - 1)
        front = after in ("E", "I", "Y")
        if c in "AEIOU":
            if k == 0:
                out.append(c)
        elif c == "B":
            if not (k == len(w) - 1 and before == "M"):
                out.append("B")
        elif c == "C":
            if before == "S" and front:
                pass
            elif w[k : k + 3] == "CIA":
                out.append("X")
            elif front:
                out.append("S")
            elif after == "H":
                out.append("K" if before == "S" or (k == 0 and at(k + 2) not in tuple("AEIOU")) else "X")
                k += 1
            else:
                out.append("K")
        elif c == "D":
            if after == "G" and at(k + 2) in ("E", "I", "Y"):
                out.append("J")
                k += 1
            else:
                out.append("T")
        elif c == "G":
            if after == "H" and not (k + 2 < len(w) and at(k + 2) in tuple("AEIOU")):
                pass
            elif after == "N" and (k + 2 == len(w) or w[k + 1 :] == "NED"):
                pass
            elif before == "D" and front:
                pass
            elif front:
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if before not in tuple("CSPTG") and after in tuple("AEIOU") and after:
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            if after == "H":
                out.append("F")
                k += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H":
                out.append("X")
                k += 1
            elif w[k : k + 3] in ("SIO", "SIA"):
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if w[k : k + 3] in ("TIA", "TIO"):
                out.append("X")
            elif after == "H":
                out.append("0")
                k += 1
            elif w[k : k + 3] != "TCH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after in tuple("AEIOU") and after:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        k += 1
    return "".join(out)


def _ascii_upper(word: str) -> str:
    """Letters beyond ASCII stay as they are: they may become two."""
    return "".join(c.upper() if c.isascii() else c for c in word)


_SOUND = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230127022455012623017202", strict=True))


def soundex(word: str) -> str:
    """As the engine's own ``soundex``: H and W are passed over, vowels part equal codes; no letter in front, no code."""
    w = _ascii_upper(word)
    if not w or w[0] not in _SOUND:
        return ""
    out, last = w[0], _SOUND[w[0]]
    for c in w[1:]:
        code = _SOUND.get(c, "0")
        if code == "7" and c in _SOUND:
            continue
        if code not in ("0", last):
            out += code
        last = code
    return (out + "000")[:4]
