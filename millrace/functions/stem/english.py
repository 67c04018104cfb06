"""English: the original algorithm and its successor."""

from __future__ import annotations

from millrace.functions.stem.core import Suffixes, begins, cut, past_syllable

_VOWELS = "aeiouy"
# fixed values
_DOUBLE = frozenset("bb dd ff gg mm nn pp rr tt".split())
_PLURAL = Suffixes(ss="sses", ie="ied ies", s="s", none="us ss")
_PLURAL_ONE = Suffixes(ss="sses", i="ies", s="s", none="ss")
_PAST = Suffixes(ee="eed eedly", off="ed edly ing ingly")
_PAST_ONE = Suffixes(ee="eed", off="ed ing")
_SECOND = Suffixes(
    tion="tional", ence="enci", ance="anci", able="abli", ent="entli", ize="izer ization", ate="ational ation ator", al="alism aliti alli", ful="fulness fulli", ous="ousli ousness",
    ive="iveness iviti", ble="biliti bli", og="ogi", less="lessli", li="li",
)
_SECOND_ONE = Suffixes(
    tion="tional", ence="enci", ance="anci", able="abli", ent="entli", e="eli", ize="izer ization", ate="ational ation ator", al="alli alism aliti", ful="fulness", ous="ousli ousness",
    ive="iveness iviti", ble="biliti",
)
_THIRD = Suffixes(tion="tional", ate="ational", al="alize", ic="icate iciti ical", off="ful ness", second="ative")
_THIRD_ONE = Suffixes(al="alize", ic="icate iciti ical", off="ative ful ness")
_FOURTH = Suffixes(off="al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", ion="ion")
_FOURTH_ONE = Suffixes(off="al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize", ion="ion")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STARTS = ("gener", "commun", "arsen")
_LI = "cdeghkmnrt"


def _marked(word: str) -> str:
    """y at the start or after a vowel as the consonant Y."""
    out = list(word)
    for i, c in enumerate(out):
        if c == "y" and (i == 0 or out[i - 1] in _VOWELS):
            out[i] = "Y"
    return "".join(out)


def _has_vowel(word: str) -> bool:
    return any(c in _VOWELS for c in word)


def _short_end(word: str, two: bool) -> bool:
    """Non-vowel, vowel, non-vowel but w, x, Y at the end; with ``two``, also a word of vowel and non-vowel."""
    if len(word) >= 3 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY":
        return True
    return two and len(word) == 2 and word[0] in _VOWELS and word[1] not in _VOWELS


def _past(word: str, table: Suffixes, one: int, two: bool) -> str:
    suffix, action = table.of(word)
    if action == "ee":
        return cut(word, suffix, "ee") if begins(word, suffix) >= one else word
    if action != "off" or not _has_vowel(cut(word, suffix)):
        return word
    word = cut(word, suffix)
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word[-2:] in _DOUBLE:
        return word[:-1]
    return word + "e" if len(word) == one and _short_end(word, two) else word


def _last(word: str, one: int, two_: int, two: bool) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= two_ or (at >= one and not _short_end(word[:-1], two))):
        return word[:-1]
    return word


def _fourth(word: str, table: Suffixes, two: int) -> str:
    suffix, action = table.of(word)
    if action and begins(word, suffix) >= two and (action == "off" or cut(word, suffix).endswith(("s", "t"))):
        return cut(word, suffix)
    return word


def porter(word: str) -> str:
    word = _marked(word)
    one = past_syllable(word, _VOWELS)
    two = past_syllable(word, _VOWELS, one)
    suffix, action = _PLURAL_ONE.of(word)
    if action and action != "none":
        word = cut(word, suffix, {"s": ""}.get(action, action))
    word = _past(word, _PAST_ONE, one, False)
    if word[-1:] in ("y", "Y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_SECOND_ONE, _THIRD_ONE):
        suffix, action = table.of(word)
        if action and begins(word, suffix) >= one:
            word = cut(word, suffix, "" if action == "off" else action)
    word = _fourth(word, _FOURTH_ONE, two)
    word = _last(word, one, two, False)
    if word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.replace("Y", "y")


def english(word: str) -> str:
    if word in _WHOLE:
        return _WHOLE[word]
    if len(word) < 3:
        return word
    word = _marked(word[1:] if word[0] == "'" else word)
    one = next((len(s) for s in _STARTS if word.startswith(s)), None) or past_syllable(word, _VOWELS)
    two = past_syllable(word, _VOWELS, one)
    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = cut(word, s)
            break
    suffix, action = _PLURAL.of(word)
    if action == "ss":
        word = cut(word, suffix, "ss")
    elif action == "ie":
        word = cut(word, suffix, "i" if len(word) > 4 else "ie")
    elif action == "s" and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word.replace("Y", "y")
    word = _past(word, _PAST, one, True)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    suffix, action = _SECOND.of(word)
    if action and begins(word, suffix) >= one:
        before = cut(word, suffix)[-1:]
        if action == "li":
            word = cut(word, suffix) if before and before in _LI else word
        elif action != "og" or before == "l":
            word = cut(word, suffix, action)
    suffix, action = _THIRD.of(word)
    if action and begins(word, suffix) >= one:
        if action == "second":
            word = cut(word, suffix) if begins(word, suffix) >= two else word
        else:
            word = cut(word, suffix, "" if action == "off" else action)
    word = _fourth(word, _FOURTH, two)
    if word.endswith("e"):
        word = _last(word, one, two, True)
    elif word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.replace("Y", "y")
