"""Encoding with public byte-level BPE vocabularies.

The ids are those of the ``tokenizers`` JSON file, as ``encode(text, add_special_tokens=False)``
of a fresh ``Tokenizer`` gives them: the string of an added token in a text is that token's id.
With ``special_as_text`` it is ordinary text.  Where every character is below U+0250 and no
such string stands in the text, the rank file of the same vocabulary gives the same ids
several times as fast by ``tiktoken`` (in that range the two libraries agree on what letters,
numbers and white space are; a property test compares them with a fresh ``Tokenizer``).  All
other texts go through ``tokenizers``.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

_WIDE = re.compile(r"[^\x00-ɏ]")


class ByteBpe:
    """ids and character offsets of whole texts."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None, special_as_text: bool = False):
        self._path, self._as_text, self._made = json_path, special_as_text, None
        with open(json_path, encoding="utf-8") as f:
            added = [] if special_as_text else [t["content"] for t in json.load(f).get("added_tokens", [])]
        # an added token may take in white space around it, so its presence alone decides
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._quick = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
            self._width = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self._width[i] = len(token)

    @property
    def _tok(self):
        """The whole tokenizer, made when a text first needs it (26 MB)."""
        if self._made is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._made = Tokenizer.from_file(self._path)
            self._made.encode_special_tokens = self._as_text
        return self._made

    def _rapid(self, text: str) -> np.ndarray | None:
        if self._quick is None or _WIDE.search(text) or (self._added and self._added.search(text)):
            return None
        try:
            return np.array(self._quick.encode_ordinary(text), np.uint32)
        except BaseException as e:  # the library panics on some very long runs
            if type(e).__name__ not in ("PanicException", "ValueError"):
                raise
            return None

    def ids(self, text: str) -> np.ndarray:
        got = self._rapid(text)
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, np.uint32) if got is None else got

    def starts(self, text: str) -> np.ndarray:
        """The first character of each token, in order; one character may have several tokens."""
        got = self._rapid(text)
        if got is None:
            return np.array([s for s, _ in self._tok.encode(text, add_special_tokens=False).offsets], np.int64)
        width = self._width[got]
        at = np.cumsum(width) - width
        if text.isascii():
            return at
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead) - 1)[at]


_made: dict[tuple, ByteBpe] = {}


def worker_encoder(*args) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    if args not in _made:
        _made[args] = ByteBpe(*args)
    return _made[args]
