"""Pre-tokens of the public byte-level tokenizers, and their rank files."""

from __future__ import annotations

import base64
import re

import regex

_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r\x0b\x0c\x85\xa0"
#: public_tokenizers.PATTERN with the classes that \p{L}, \p{N} and \s have below U+0250.
_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


class Splitter:
    """``find(text)``: the matches of a pattern; for the public pattern, texts without code points from
    U+0250 go through an equal expression of the standard library, which is faster."""

    def __init__(self, pattern: str, public: str | None = None):
        self._all = regex.compile(pattern).findall
        self._latin = pattern == public

    def find(self, text: str) -> list[str]:
        return _LATIN.findall(text) if self._latin and not _BEYOND.search(text) else self._all(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a tiktoken rank file: lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
