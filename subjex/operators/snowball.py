"""The published German and English (Porter2) Snowball stemming rules, for one word.

Meant for a term dictionary (``terms.stem_dictionary``), where it runs once per distinct term.
R1 is the region after the first non-vowel that follows a vowel, R2 the same within R1.
Words are lower-case; a word of one or two letters stays as it is in English.
"""

from __future__ import annotations

import re

# Letters, endings and exceptions of the published algorithms.
_EN_VOWELS = "aeiouy"
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_LI = "cdeghkmnrt"
_EN_PREFIXES = ("gener", "commun", "arsen")
_EN_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
             "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
             "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
             "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
             "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
             "fulli": "ful", "lessli": "less", "li": ""}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_DE_VOWELS = "aeiouyäöü"
_DE_S = "bdfghklmnrt"
_DE_ST = "bdfghklmnt"


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel behind a vowel begins, looking from ``start``."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short_syllable(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _EN_VOWELS and word[1] not in _EN_VOWELS
    return len(word) > 2 and word[-1] not in _EN_VOWELS + "wxY" and word[-2] in _EN_VOWELS and word[-3] not in _EN_VOWELS


def english(word: str) -> str:
    """Porter2."""
    word = word.replace("’", "'").replace("‘", "'")
    if len(word) <= 2:
        return word
    if word in _EN_WORDS:
        return _EN_WORDS[word]
    word = word[1:] if word.startswith("'") else word
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    prefix = next((p for p in _EN_PREFIXES if word.startswith(p)), "")
    r1 = len(prefix) if prefix else _region(word, _EN_VOWELS)
    r2 = _region(word, _EN_VOWELS, r1)
    # 0, 1a
    word = word[:len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _EN_VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _EN_AFTER_1A:
        return word
    # 1b
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[:len(word) - len(ending)] + "ee"
    elif ending and any(c in _EN_VOWELS for c in word[:len(word) - len(ending)]):
        word = word[:len(word) - len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_EN_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_VOWELS:
        word = word[:-1] + "i"
    # 2
    ending = _longest(word, _EN_STEP2)
    stem = word[:len(word) - len(ending)]
    if ending and len(stem) >= r1 and not (ending == "ogi" and not stem.endswith("l")) \
            and not (ending == "li" and (not stem or stem[-1] not in _EN_LI)):
        word = stem + _EN_STEP2[ending]
    # 3
    ending = _longest(word, _EN_STEP3)
    stem = word[:len(word) - len(ending)]
    if ending and len(stem) >= (r2 if ending == "ative" else r1):
        word = stem + _EN_STEP3[ending]
    # 4
    ending = _longest(word, _EN_STEP4)
    stem = word[:len(word) - len(ending)]
    if ending and len(stem) >= r2 and not (ending == "ion" and not stem.endswith(("s", "t"))):
        word = stem
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def german(word: str) -> str:
    word = word.replace("ß", "ss")
    word = re.sub(rf"(?<=[{_DE_VOWELS}])([uy])(?=[{_DE_VOWELS}])", lambda m: m[1].upper(), word)
    first = _region(word, _DE_VOWELS)
    r2 = _region(word, _DE_VOWELS, first)
    r1 = max(first, 3)
    # 1
    ending = _longest(word, ("em", "ern", "er", "e", "en", "es", "s"))
    stem = word[:len(word) - len(ending)]
    if ending and len(stem) >= r1 and (ending != "s" or stem[-1:] and stem[-1] in _DE_S):
        word = stem[:-1] if ending in ("e", "en", "es") and stem.endswith("niss") else stem
    # 2
    ending = _longest(word, ("en", "er", "est", "st"))
    stem = word[:len(word) - len(ending)]
    if ending and len(stem) >= r1 and (ending != "st" or len(stem) > 3 and stem[-1] in _DE_ST):
        word = stem
    # 3
    ending = _longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    stem = word[:len(word) - len(ending)]
    if ending and len(stem) >= r2:
        if ending in ("end", "ung"):
            word = stem
            if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem[:-2].endswith("e"):
                word = stem[:-2]
        elif ending in ("ig", "ik", "isch"):
            word = word if stem.endswith("e") else stem
        elif ending in ("lich", "heit"):
            word = stem[:-2] if stem.endswith(("er", "en")) and len(stem) - 2 >= r1 else stem
        else:
            more = _longest(stem, ("lich", "ig"))
            word = stem[:len(stem) - len(more)] if more and len(stem) - len(more) >= r2 else stem
    return word.lower().translate(str.maketrans("äöü", "aou"))


def snowball_stem(lang: str, token: str) -> str:
    """The stem of ``token``: German rules for ``de``, English ones else (the routing of T5)."""
    return german(token) if lang == "de" else english(token)
