"""German, Dutch, Danish, Norwegian and Swedish."""

from __future__ import annotations

from millrace.functions.stem.core import Suffixes, begins, between, cut, past_syllable, regions, swapped

# fixed values
_DE_VOWELS = "aeiouyäöü"
_DE_FIRST = Suffixes(off="em ern er", e="e en es", s="s")
_DE_SECOND = Suffixes(off="en er est", st="st")
_DE_THIRD = Suffixes(end="end ung", ig="ig ik isch", lich="lich heit", keit="keit")
_DE_S, _DE_ST = "bdfghklmnrt", "bdfghklmnt"
_NL_VOWELS = "aeiouyè"
_NL_FIRST = Suffixes(heid="heden", en="en ene", s="s se")
_NL_THIRD = Suffixes(end="end ing", ig="ig", lijk="lijk", baar="baar", bar="bar")
_DA_VOWELS, _NO_VOWELS, _SV_VOWELS = "aeiouyæåø", "aeiouyæåø", "aeiouyäåö"
_DA_MAIN = Suffixes(
    off="hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", s="s"
)
_DA_OTHER = Suffixes(off="ig lig elig els", løs="løst")
_DA_S = "abcdfghjklmnoprtvyzå"
_NO_MAIN = Suffixes(off="a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", er="erte ert", s="s")
_NO_OTHER = Suffixes(off="leg eleg ig eig lig elig els lov elov slov hetslov")
_NO_S = "bcdfghjlmnoprtvyz"
_SV_MAIN = Suffixes(
    off="a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", s="s"
)
_SV_OTHER = Suffixes(off="ig lig els", lös="löst", full="fullt")
_SV_S = "bcdfghjklmnoprtvy"


def german(word: str) -> str:
    word = between(word.replace("ß", "ss"), _DE_VOWELS, {"u": "U", "y": "Y"})
    one = two = len(word)
    if len(word) >= 3:
        one, two = regions(word, _DE_VOWELS)
        one = max(one, 3)
    suffix, action = _DE_FIRST.of(word)
    at = begins(word, suffix)
    if action and at >= one:
        if action == "s":
            word = word[:at] if at and word[at - 1] in _DE_S else word
        else:
            word = word[:at]
            if action == "e" and word.endswith("niss"):
                word = word[:-1]
    suffix, action = _DE_SECOND.of(word)
    at = begins(word, suffix)
    if action and at >= one and (action == "off" or (at >= 4 and word[at - 1] in _DE_ST)):
        word = word[:at]
    suffix, action = _DE_THIRD.of(word)
    at = begins(word, suffix)
    if action and at >= two:
        left = word[:at]
        if action == "end":
            word = left
            if left.endswith("ig") and not left.endswith("eig") and len(left) - 2 >= two:
                word = left[:-2]
        elif action == "ig":
            word = word if left.endswith("e") else left
        elif action == "lich":
            word = left[:-2] if left.endswith(("er", "en")) and len(left) - 2 >= one else left
        else:
            word = left
            for s in ("lich", "ig"):
                if left.endswith(s):
                    word = cut(left, s) if begins(left, s) >= two else left
                    break
    return swapped(word, str.maketrans("YUäöü", "yuaou"))


def _nl_undouble(word: str) -> str:
    return word[:-1] if word.endswith(("kk", "dd", "tt")) else word


def _nl_e(word: str, one: int) -> tuple[str, bool]:
    if word.endswith("e") and len(word) - 1 >= one and len(word) > 1 and word[-2] not in _NL_VOWELS:
        return _nl_undouble(word[:-1]), True
    return word, False


def _nl_en(word: str, suffix: str, one: int) -> str:
    left = cut(word, suffix)
    if len(left) >= one and left and left[-1] not in _NL_VOWELS and not left.endswith("gem"):
        return _nl_undouble(left)
    return word


def dutch(word: str) -> str:
    word = swapped(word, str.maketrans("äáëéïíöóüú", "aaeeiioouu"))
    if word.startswith("y"):
        word = "Y" + word[1:]
    out, i = list(word), 0
    while i + 1 < len(out):  # i between vowels, y after one
        if out[i] in _NL_VOWELS and out[i + 1] == "i" and i + 2 < len(out) and out[i + 2] in _NL_VOWELS:
            out[i + 1] = "I"
            i += 3
        elif out[i] in _NL_VOWELS and out[i + 1] == "y":
            out[i + 1] = "Y"
            i += 2
        else:
            i += 1
    word = "".join(out)
    one, two = regions(word, _NL_VOWELS)
    one = max(one, 3)
    suffix, action = _NL_FIRST.of(word)
    if action == "heid" and begins(word, suffix) >= one:
        word = cut(word, suffix, "heid")
    elif action == "en":
        word = _nl_en(word, suffix, one)
    elif action == "s" and (at := begins(word, suffix)) >= one and at and word[at - 1] not in _NL_VOWELS + "j":
        word = word[:at]
    word, had_e = _nl_e(word, one)
    if word.endswith("heid") and len(word) - 4 >= two and not word.endswith("cheid"):
        word = word[:-4]
        if word.endswith("en"):
            word = _nl_en(word, "en", one)
    suffix, action = _NL_THIRD.of(word)
    at = begins(word, suffix)
    if action and at >= two:
        left = word[:at]
        if action == "end":
            word = left
            if left.endswith("ig") and len(left) - 2 >= two and not left.endswith("eig"):
                word = left[:-2]
            else:
                word = _nl_undouble(left)
        elif action == "ig":
            word = word if left.endswith("e") else left
        elif action == "lijk":
            word, _ = _nl_e(left, one)
        elif action == "baar" or had_e:
            word = left
    if len(word) >= 4 and word[-1] not in _NL_VOWELS + "I" and word[-3:-1] in ("aa", "ee", "oo", "uu") and word[-4] not in _NL_VOWELS:
        word = word[:-2] + word[-1]
    return word.replace("I", "i").replace("Y", "y")


def _one(word: str, vowels: str) -> int:
    """The suffix region of the northern languages; none in words of fewer than three letters."""
    return max(3, past_syllable(word, vowels)) if len(word) >= 3 else len(word)


def _pair(word: str, one: int, pairs: tuple[str, ...]) -> str:
    return word[:-1] if len(word) - 2 >= one and word.endswith(pairs) else word


def danish(word: str) -> str:
    one = _one(word, _DA_VOWELS)
    pairs = ("gd", "dt", "gt", "kt")
    suffix, action = _DA_MAIN.of(word, one)
    left = cut(word, suffix)
    if action == "off" or (action == "s" and left[-1:] and left[-1] in _DA_S):
        word = left
    word = _pair(word, one, pairs)
    if word.endswith("igst"):
        word = word[:-2]
    suffix, action = _DA_OTHER.of(word, one)
    if action == "off":
        word = _pair(cut(word, suffix), one, pairs)
    elif action:
        word = cut(word, suffix, action)
    if len(word) - 1 >= one and len(word) > 1 and word[-1] not in _DA_VOWELS and word[-1] == word[-2]:
        word = word[:-1]
    return word


def norwegian(word: str) -> str:
    one = _one(word, _NO_VOWELS)
    suffix, action = _NO_MAIN.of(word, one)
    left = cut(word, suffix)
    if action == "off":
        word = left
    elif action == "er":
        word = left + "er"
    elif action == "s" and left and (left[-1] in _NO_S or (left[-1] == "k" and len(left) > 1 and left[-2] not in _NO_VOWELS)):
        word = left
    word = _pair(word, one, ("dt", "vt"))
    suffix, action = _NO_OTHER.of(word, one)
    return cut(word, suffix)


def swedish(word: str) -> str:
    one = _one(word, _SV_VOWELS)
    suffix, action = _SV_MAIN.of(word, one)
    left = cut(word, suffix)
    if action == "off" or (action == "s" and left and left[-1] in _SV_S):
        word = left
    word = _pair(word, one, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"))
    suffix, action = _SV_OTHER.of(word, one)
    return cut(word, suffix, "" if action == "off" else action)
