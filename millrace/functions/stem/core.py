"""What the stemmers share: suffix tables and regions of a word."""

from __future__ import annotations


class Suffixes:
    """Suffixes by action; of those that a word has, the longest counts."""

    def __init__(self, **actions: str):
        self.action = {s: name for name, text in actions.items() for s in text.split()}
        self.sizes = sorted({len(s) for s in self.action}, reverse=True)

    def of(self, word: str, start: int = 0) -> tuple[str, str]:
        """(suffix, action) of the longest that stands in word[start:], or two empty strings."""
        room = len(word) - start
        for n in self.sizes:
            if n <= room and (name := self.action.get(word[-n:])):
                return word[-n:], name
        return "", ""


def past_syllable(word: str, vowels: str, start: int = 0) -> int:
    """The place after the first non-vowel that follows a vowel, from ``start`` on; else the word's length."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def regions(word: str, vowels: str) -> tuple[int, int]:
    """Where the two regions of suffixes begin."""
    one = past_syllable(word, vowels)
    return one, past_syllable(word, vowels, one)


def romance_region(word: str, vowels: str) -> int:
    """The region of verb endings, by the first two letters."""
    n = len(word)

    def past(start: int, vowel: bool) -> int:
        return next((i + 1 for i in range(start, n) if (word[i] in vowels) == vowel), -1)

    if n < 2:
        return n
    first, second = word[0] in vowels, word[1] in vowels
    if first and second:
        found = past(2, False)
    elif not first and second:
        found = 3 if n >= 3 else -1
    else:
        found = past(2, True)
    return found if found >= 0 else n


def between(word: str, vowels: str, letters: dict[str, str]) -> str:
    """``letters`` that stand between vowels, replaced; a pair of vowels serves one letter."""
    out, i = list(word), 0
    while i + 2 < len(out):
        if out[i] in vowels and out[i + 1] in letters and out[i + 2] in vowels:
            out[i + 1] = letters[out[i + 1]]
            i += 3
        else:
            i += 1
    return "".join(out)


def cut(word: str, suffix: str, instead: str = "") -> str:
    return word[: len(word) - len(suffix)] + instead


def begins(word: str, suffix: str) -> int:
    """Where the suffix begins."""
    return len(word) - len(suffix)


def swapped(word: str, pairs: dict[int, str]) -> str:
    return word.translate(pairs)
