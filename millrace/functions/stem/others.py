"""Russian, Finnish and Hungarian."""

from __future__ import annotations

from millrace.functions.stem.core import Suffixes, begins, cut, past_syllable

# fixed values
_RU_VOWELS = "аеиоуыэюя"
_RU_GERUND = Suffixes(after="в вши вшись", off="ив ивши ившись ыв ывши ывшись")
_RU_ADJECTIVE = Suffixes(off="ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE = Suffixes(after="ем нн вш ющ щ", off="ивш ывш ующ")
_RU_REFLEXIVE = Suffixes(off="ся сь")
_RU_VERB = Suffixes(
    after="ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    off="ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
)
_RU_NOUN = Suffixes(off="а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
_RU_DERIVED = Suffixes(off="ост ость")
_RU_TIDY = Suffixes(best="ейш ейше", n="н", soft="ь")
_FI_VOWELS, _FI_VOWELS_2, _FI_PARTICLE = "aeiouyäö", "aeiouäö", "aeinotuyäö"
_FI_PARTICLES = Suffixes(end="kin kaan kään ko kö han hän pa pä", second="sti")
_FI_POSSESSIVE = Suffixes(si="si", ni="ni", off="nsa nsä mme nne", an="an", än="än", en="en")
_FI_CASE = {
    "han": "a", "hen": "e", "hin": "i", "hon": "o", "hän": "ä", "hön": "ö", "siin": "VI", "den": "VI", "tten": "VI", "seen": "LONG", "n": "n", "a": "VC", "ä": "VC", "tta": "e", "ttä": "e",
    **dict.fromkeys("ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine".split(), ""),
}
_FI_OTHER = Suffixes(po="mpi mpa mpä mmi mma mmä", off="impi impa impä immi imma immä eja ejä")
_FI_T = Suffixes(po="mma", off="imma")
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_HU_VOWELS = "aeiouáéíóõöúûü"
_HU_DIGRAPHS = ("dzs", "cs", "gy", "ly", "ny", "sz", "ty", "zs")
_HU_DOUBLE = ("bb", "cc", "ccs", "dd", "ff", "gg", "ggy", "jj", "kk", "ll", "lly", "mm", "nn", "nny", "pp", "rr", "ss", "ssz", "tt", "tty", "vv", "zz", "zzs")
_HU_CASE = Suffixes(
    off="ban ben ba be ra re nak nek val vel tól tõl ról rõl ból bõl hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé anként enként onként ként en on an ön n t"
)
_HU_SPECIAL = Suffixes(e="én", a="án ánként")
_HU_OTHER = Suffixes(off="astul estül stul stül", a="ástul", e="éstül")
_HU_PLURAL = Suffixes(a="ák", e="ék", off="ök ok ek ak k")
_HU_OWNED = Suffixes(off="oké öké aké eké ké éi é", e="éké ééi éé", a="áké áéi")
_HU_SINGULAR = Suffixes(off="ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o", a="ánk ájuk ám ád á", e="énk éjük ém éd é")
_HU_SEVERAL = Suffixes(
    off="jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik",
    a="áim áid ái áink áitok áik", e="éim éid éi éink éitek éik",
)


def russian(word: str) -> str:
    start = next((i + 1 for i, c in enumerate(word) if c in _RU_VOWELS), len(word))

    def past(at: int, vowel: bool) -> int:
        return next((i + 1 for i in range(at, len(word)) if (word[i] in _RU_VOWELS) == vowel), -1)

    two = len(word)
    at = past(start, False)
    at = past(at, True) if at >= 0 else at
    at = past(at, False) if at >= 0 else at
    if at >= 0:
        two = at

    def off(w: str, table: Suffixes) -> str | None:
        suffix, action = table.of(w, start)
        left = cut(w, suffix)
        return left if action == "off" or (action and len(left) - 1 >= start and left[-1] in "ая") else None

    done = off(word, _RU_GERUND)
    if done is None:
        word = off(word, _RU_REFLEXIVE) or word
        done = off(word, _RU_ADJECTIVE)
        if done is not None:
            done = off(done, _RU_PARTICIPLE) or done
        else:
            done = off(word, _RU_VERB)
            if done is None:
                done = off(word, _RU_NOUN)
    word = word if done is None else done
    if word.endswith("и") and len(word) - 1 >= start:
        word = word[:-1]
    suffix, action = _RU_DERIVED.of(word, start)
    if action and begins(word, suffix) >= two:
        word = cut(word, suffix)
    suffix, action = _RU_TIDY.of(word, start)
    left = cut(word, suffix)
    if action == "soft":
        word = left
    elif action == "best":
        word = left[:-1] if left.endswith("нн") and len(left) - 2 >= start else left
    elif action == "n" and left.endswith("н") and len(left) - 1 >= start:
        word = left
    return word


def _fi_case(word: str, one: int) -> str:
    """``word`` without its case ending; the longest whose condition on what stands before it holds, if that is a form of vowels."""
    for n in (4, 3, 2, 1):
        if len(word) - n < one or word[-n:] not in _FI_CASE:
            continue
        need, left = _FI_CASE[word[-n:]], word[:-n]
        room = len(left)
        if need == "VI":
            if room - 2 >= one and left[-1] == "i" and left[-2] in _FI_VOWELS_2:
                return left
            continue  # such a form is no match, so a shorter one is looked for
        if need == "LONG":
            if room - 2 >= one and left.endswith(_FI_LONG):
                return left
            continue
        if need == "n":
            return left[:-1] if left.endswith((*_FI_LONG, "ie")) and room else left
        if need == "VC":
            return left if room >= 2 and left[-1] in _FI_VOWELS and left[-2] not in _FI_VOWELS else word
        return left if not need or left.endswith(need) else word
    return word


def finnish(word: str) -> str:
    one = past_syllable(word, _FI_VOWELS)
    two = past_syllable(word, _FI_VOWELS, one)
    suffix, action = _FI_PARTICLES.of(word, one)
    left = cut(word, suffix)
    if (action == "end" and left and left[-1] in _FI_PARTICLE) or (action == "second" and len(left) >= two):
        word = left
    suffix, action = _FI_POSSESSIVE.of(word, one)
    left = cut(word, suffix)
    if action == "si":
        word = word if left.endswith("k") else left
    elif action == "ni":
        word = left[:-1] + "i" if left.endswith("kse") else left
    elif action == "off":
        word = left
    elif action:
        before = {"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}
        word = left if left.endswith(before[action]) else word
    cased = _fi_case(word, one)
    removed, word = cased != word, cased
    suffix, action = _FI_OTHER.of(word, two)
    left = cut(word, suffix)
    if action == "off" or (action == "po" and not left.endswith("po")):
        word = left
    if removed:
        if len(word) - 1 >= one and word.endswith(("i", "j")):
            word = word[:-1]
    elif word.endswith("t") and len(word) - 2 >= one and word[-2] in _FI_VOWELS:
        word = word[:-1]
        suffix, action = _FI_T.of(word, two)
        left = cut(word, suffix)
        if action == "off" or (action == "po" and not left.endswith("po")):
            word = left
    if len(word) - 2 >= one and word.endswith(_FI_LONG):
        word = word[:-1]
    if len(word) - 2 >= one and word[-1] in "aäei" and word[-2] not in _FI_VOWELS:
        word = word[:-1]
    if len(word) - 2 >= one and word.endswith(("oj", "uj")):
        word = word[:-1]
    if len(word) - 2 >= one and word.endswith("jo"):
        word = word[:-1]
    end = len(word)
    while end and word[end - 1] in _FI_VOWELS:
        end -= 1
    if end > 1 and word[end - 1] == word[end - 2]:
        word = word[: end - 1] + word[end:]
    return word


def _hu_one(word: str) -> int:
    n = len(word)
    if not n:
        return 0
    if word[0] in _HU_VOWELS:
        at = next((i for i in range(1, n) if word[i] not in _HU_VOWELS), -1)
        if at < 0:
            return n
        return at + next((len(d) for d in _HU_DIGRAPHS if word.startswith(d, at)), 1)
    return next((i + 1 for i in range(1, n) if word[i] in _HU_VOWELS), n)


def _hu_double(word: str, suffixes: tuple[str, ...], one: int) -> str:
    """A suffix after a doubled consonant goes, with one of the two."""
    for s in suffixes:
        if word.endswith(s):
            left = cut(word, s)
            if len(left) >= one and left.endswith(_HU_DOUBLE):
                return left[:-2] + left[-1]
            return word
    return word


def hungarian(word: str) -> str:
    one = _hu_one(word)

    def replaced(w: str, table: Suffixes) -> str:
        suffix, action = table.of(w)
        return cut(w, suffix, "" if action == "off" else action) if action and begins(w, suffix) >= one else w

    word = _hu_double(word, ("al", "el"), one)
    suffix, action = _HU_CASE.of(word)
    if action and begins(word, suffix) >= one:
        word = cut(word, suffix)
        if word[-1:] in ("á", "é") and word and len(word) - 1 >= one:
            word = word[:-1] + ("a" if word[-1] == "á" else "e")
    word = replaced(replaced(word, _HU_SPECIAL), _HU_OTHER)
    word = _hu_double(word, ("á", "é"), one)
    for table in (_HU_OWNED, _HU_SINGULAR, _HU_SEVERAL, _HU_PLURAL):
        word = replaced(word, table)
    return word
