"""Turkish: endings are marked from the end of the word, by vowel harmony and linking letters, and go in chains."""

from __future__ import annotations

from millrace.functions.stem.core import Suffixes

# fixed values
_VOWELS, _HIGH = "aeıioöuü", "ıiuü"
_HARMONY = {"a": "aıou", "e": "eiöü", "ı": "aı", "i": "ei", "o": "ou", "ö": "öü", "u": "ou", "ü": "öü"}
_TABLES = {
    "possessive": "mız miz muz müz nız niz nuz nüz m n", "larI": "leri ları", "nU": "nı ni nu nü", "nUn": "ın in un ün", "yA": "a e", "nA": "na ne", "DA": "da de ta te", "ndA": "nda nde",
    "DAn": "dan den tan ten", "ndAn": "ndan nden", "ylA": "la le", "ki": "ki", "ncA": "ca ce", "yUm": "ım im um üm", "sUn": "sın sin sun sün", "yUz": "ız iz uz üz",
    "sUnUz": "sınız siniz sunuz sünüz", "lAr": "ler lar", "nUz": "nız niz nuz nüz", "DUr": "tır tir tur tür dır dir dur dür", "cAsInA": "casına cesine",
    "yDU": "tım tim tum tüm dım dim dum düm tın tin tun tün dın din dun dün tık tik tuk tük dık dik duk dük tı ti tu tü dı di du dü", "ysA": "sam san sak sem sen sek sa se",
    "ymUs": "mış miş muş müş", "yken": "ken",
}
_NO_HARMONY = frozenset("possessive larI ki sUnUz cAsInA ysA yken".split())
_LINK = {"nUn": "n", "ncA": "n", "yA": "y", "ylA": "y", "yUm": "y", "yUz": "y", "yDU": "y", "ysA": "y", "ymUs": "y", "yken": "y"}
_ENDS = {name: Suffixes(off=text) for name, text in _TABLES.items()}


class _Word:
    """A word with a place in it, moved towards its start, and a marked slice."""

    def __init__(self, word: str):
        self.w, self.at = word, len(word)
        self.left = self.right = len(word)
        self.nouns = True

    # steps; each tells whether it held

    def any(self, *steps) -> bool:
        back = len(self.w) - self.at
        for step in steps:
            self.at = len(self.w) - back
            if step():
                return True
        self.at = len(self.w) - back
        return False

    def maybe(self, step) -> bool:
        self.any(step)
        return True

    def open(self) -> bool:
        self.right = self.at
        return True

    def delete(self) -> bool:
        """From the place to the end of the slice."""
        self.left = self.at
        self.w = self.w[: self.left] + self.w[self.right :]
        self.right = self.at
        return True

    # marks

    def harmony(self) -> bool:
        last = next((i for i in range(self.at - 1, -1, -1) if self.w[i] in _VOWELS), -1)
        return last >= 0 and any(c in _HARMONY[self.w[last]] for c in self.w[:last])

    def linked(self, letter: str, before: str, inverse: bool = False) -> bool:
        """The linking letter after one of ``before`` (or after none of them), or no such letter and one two places back."""

        def good(i: int) -> bool:
            return i >= 0 and (self.w[i] in before) != inverse

        if self.at and self.w[self.at - 1] in letter:
            if good(self.at - 2):
                self.at -= 1
                return True
            return False
        return good(self.at - 2)

    def mark(self, name: str) -> bool:
        if name == "sU":
            if not self.harmony() or not self.at or self.w[self.at - 1] not in _HIGH:
                return False
            self.at -= 1
            return self.linked("s", _VOWELS)
        if name == "yU":
            if not self.harmony() or not self.at or self.w[self.at - 1] not in _HIGH:
                return False
            self.at -= 1
            return self.linked("y", _VOWELS)
        if name not in _NO_HARMONY and not self.harmony():
            return False
        suffix, _ = _ENDS[name].of(self.w[: self.at])
        if not suffix:
            return False
        self.at -= len(suffix)
        if name == "possessive":
            return self.linked(_HIGH, _VOWELS, inverse=True)
        return self.linked(_LINK[name], _VOWELS) if name in _LINK else True

    def one(self, *names: str) -> bool:
        return self.any(*[lambda n=n: self.mark(n) for n in names])

    # chains

    def verb_endings(self) -> bool:
        self.nouns = True
        persons = ("sUnUz", "lAr", "yUm", "sUn", "yUz")

        def plural() -> bool:
            if not self.mark("lAr"):
                return False
            self.delete()
            self.maybe(lambda: self.open() and self.one("DUr", "yDU", "ysA", "ymUs"))
            self.nouns = False
            return True

        self.open()
        found = self.any(
            lambda: self.one("ymUs", "yDU", "ysA", "yken"),
            lambda: self.mark("cAsInA") and self.maybe(lambda: self.one(*persons)) and self.mark("ymUs"),
            plural,
            lambda: self.mark("nUz") and self.one("yDU", "ysA"),
            lambda: self.one("sUnUz", "yUz", "sUn", "yUm") and self.delete() and self.maybe(lambda: self.open() and self.mark("ymUs")),
            lambda: self.mark("DUr") and self.delete() and self.maybe(lambda: self.open() and self.maybe(lambda: self.one(*persons)) and self.mark("ymUs")),
        )
        return found and self.delete()

    def plural_chain(self) -> bool:
        return self.open() and self.mark("lAr") and self.delete() and self.before_ki()

    def owner(self, *names: str) -> bool:
        return self.one(*names) and self.delete() and self.maybe(self.plural_chain)

    def before_ki(self) -> bool:
        self.open()
        return self.mark("ki") and self.any(
            lambda: self.mark("DA") and self.delete() and self.maybe(
                lambda: self.open() and self.any(lambda: self.mark("lAr") and self.delete() and self.maybe(self.before_ki), lambda: self.owner("possessive"))
            ),
            lambda: self.mark("nUn") and self.delete() and self.maybe(
                lambda: self.open() and self.any(lambda: self.mark("larI") and self.delete(), lambda: self.open() and self.owner("possessive", "sU"), self.before_ki)
            ),
            lambda: self.mark("ndA") and self.any(lambda: self.mark("larI") and self.delete(), lambda: self.owner("sU"), self.before_ki),
        )

    def noun_endings(self) -> bool:
        owned = lambda: self.open() and self.owner("possessive", "sU")
        last = lambda: self.any(
            lambda: self.one("possessive") and self.delete() and self.maybe(lambda: self.open() and self.mark("lAr")), lambda: self.mark("lAr")
        )
        return self.any(
            lambda: self.open() and self.mark("lAr") and self.delete() and self.maybe(self.before_ki),
            lambda: self.open() and self.mark("ncA") and self.delete() and self.maybe(lambda: self.any(lambda: self.open() and self.mark("larI") and self.delete(), owned, self.plural_chain)),
            lambda: self.open() and self.one("ndA", "nA") and self.any(lambda: self.mark("larI") and self.delete(), lambda: self.owner("sU"), self.before_ki),
            lambda: self.open() and self.one("ndAn", "nU") and self.any(lambda: self.owner("sU"), lambda: self.mark("larI")),
            lambda: self.open() and self.mark("DAn") and self.delete() and self.maybe(
                lambda: self.open() and self.any(lambda: self.owner("possessive"), lambda: self.mark("lAr") and self.delete() and self.maybe(self.before_ki), self.before_ki)
            ),
            lambda: self.open() and self.one("nUn", "ylA") and self.delete() and self.maybe(lambda: self.any(self.plural_chain, owned, self.before_ki)),
            lambda: self.open() and self.mark("larI") and self.delete(),
            self.before_ki,
            lambda: self.open() and self.one("DA", "yU", "yA") and self.delete() and self.maybe(lambda: self.open() and last() and self.delete() and self.open() and self.before_ki()),
            owned,
        )


def turkish(word: str) -> str:
    if sum(c in _VOWELS for c in word) < 2:
        return word
    t = _Word(word)
    t.any(t.verb_endings)
    if not t.nouns:
        return t.w
    t.at = len(t.w)
    t.any(t.noun_endings)
    word = t.w
    if word in ("ad", "soyad"):
        return word
    if word.endswith(("d", "g")) and (last := next((c for c in reversed(word) if c in _VOWELS), "")):
        word += {"a": "ı", "ı": "ı", "e": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}[last]
    return word[:-1] + {"b": "p", "c": "ç", "d": "t", "ğ": "k"}.get(word[-1:], word[-1:])
