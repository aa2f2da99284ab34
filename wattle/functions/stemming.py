"""The English stemmer (Porter2, as published at snowballstem.org) and stop words of the 'english' text search configuration."""

from __future__ import annotations

import re

# The English stop words of the text search configuration.
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now""".split())

# Words with stems of their own, words that stay, and words that stay after the plural step.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
            "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of the later steps and what they become.
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
          "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
          "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWELS = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    """Where the part after the first vowel with a non-vowel behind it begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _is_short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(_SHORT_END.search(word))


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").replace("‘", "'")
    word = word[1:] if word.startswith("'") else word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _INVARIANT or len(word) <= 2:
        return word
    # y is a consonant at the start and after a vowel
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _after(word, 0) if r1 is None else r1
    r2 = _after(word, r1)

    ending = _longest(word, ("'s'", "'s", "'"))
    word = word[:-len(ending)] if ending else word

    # plurals
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_PLURAL:
        return word

    # past and participle
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        word = word[:-len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    elif ending and any(c in _VOWELS for c in word[:-len(ending)]):
        word = word[:-len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif _is_short(word, r1):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    ending = _longest(word, (*_STEP2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        if ending == "ogi":
            word = word[:-1] if word[-4:-3] == "l" else word
        elif ending == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[:-len(ending)] + _STEP2[ending]

    ending = _longest(word, (*_STEP3, "ative"))
    if ending and len(word) - len(ending) >= r1:
        if ending == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[:-len(ending)] + _STEP3[ending]

    ending = _longest(word, (*_STEP4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[:-len(ending)]

    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
