"""English stems by the published Porter2 (Snowball) rules, for distinct words in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

#: Fixed values of the published rules.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_STARTS = ("gener", "commun", "arsen")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first non-vowel after a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and _has_vowel(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not _has_vowel(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _short_end(w) else w


def _second(w: str, r1: int) -> str:
    end = _longest(w, SECOND)
    if end is None or len(w) - len(end) < r1:
        return w
    before = w[: -len(end)]
    if (end == "li" and before[-1:] not in tuple(BEFORE_LI)) or (end == "ogi" and before[-1:] != "l"):
        return w
    return before + SECOND[end]


def _third(w: str, r1: int, r2: int) -> str:
    end = _longest(w, THIRD)
    at = len(w) - len(end or "")
    return w[:at] + THIRD[end] if end and at >= (r2 if end == "ative" else r1) else w


def _fourth(w: str, r2: int) -> str:
    end = _longest(w, FOURTH)
    at = len(w) - len(end or "")
    return w[:at] if end and at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")) else w


def _fifth(w: str, r1: int, r2: int) -> str:
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _short_end(w[:-1])):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and at >= r2 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; of other letters than a to z those of the word's end stay."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    letters = list(word.removeprefix("'"))
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    w = "".join(letters)
    r1 = next((len(s) for s in LONG_STARTS if w.startswith(s)), None) or _after(w, 0)
    r2 = _after(w, r1)
    w = w.removesuffix(_longest(w, ("'", "'s", "'s'")) or "")
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _fifth(_fourth(_third(_second(w, r1), r1, r2), r2), r1, r2)
    return w.replace("Y", "y")
