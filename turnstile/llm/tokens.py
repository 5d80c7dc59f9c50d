"""Splitting texts into the pieces that a byte-level BPE encodes separately, fast.

The pattern of such a vocabulary lets a space only begin a piece, and a space before another character always does. So a text may be cut
before every such space, and each chunk be split by itself, with a dictionary of the chunks already seen. That holds for the patterns
checked by `cuts_at_spaces`, and only texts where every single space leads a chunk take this way; others go through the full pattern.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import regex

NO_SPACES = r" ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SHORT = 48  # characters of a chunk that is worth remembering


class _Irregular(Exception):
    """A chunk is empty or starts with white space: its leading space isn't the beginning of a piece."""


def pattern_text(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, as the tokenizer libraries read it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Pieces(dict):
    """Bytes of a text's pieces, joined: `joined(text)`. `one` gives the bytes of a chunk split by the full pattern.

    The dictionary holds chunks without their leading space, at most `limit`, and is emptied when full.
    """

    def __init__(self, one: Callable[[str], bytes], limit: int):
        self.one, self.limit, self.bare, self.line = one, limit, {}, one("\n")

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Irregular
        if "\n" in chunk:
            lines = chunk.split("\n")
            if lines == chunk.split():
                return self.line.join([self[lines[0]], *map(self._bare, lines[1:])])
            return self.one(" " + chunk)
        made = self._made(" ", chunk)
        if len(chunk) <= _SHORT:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = made
        return made

    def _made(self, lead: str, chunk: str) -> bytes:
        stem = chunk.rstrip(_TAIL)
        if stem and len(stem) < len(chunk) and stem[-1].isalpha():  # punctuation after a letter is a piece of its own
            return (self[stem] if lead else self._bare(stem)) + self._bare(chunk[len(stem):])
        return self.one(lead + chunk)

    def _bare(self, chunk: str) -> bytes:
        found = self.bare.get(chunk)
        if found is None:
            found = self._made("", chunk)
            if len(chunk) <= _SHORT:
                if len(self.bare) >= self.limit // 4:
                    self.bare.clear()
                self.bare[chunk] = found
        return found

    def _first(self, chunk: str) -> bytes:
        lines = chunk.split("\n")
        if lines == (chunk.split() or [""]):
            return self.line.join([self._bare(x) if x else b"" for x in lines])
        return self.one(chunk)

    def joined(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self._first(first) + b"".join(map(self.__getitem__, rest))
        except _Irregular:
            return b"".join(map(self._whole, _CHUNK.findall(text)))

    def _whole(self, chunk: str) -> bytes:
        """A chunk of an irregular text: with its leading space, or white space alone."""
        if chunk[0] != " " or len(chunk) == 1:
            return self._bare(chunk)
        found = self.get(chunk[1:])
        return self.one(chunk) if found is None else found


_CHUNK = regex.compile(r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}")


def cuts_at_spaces(pattern: str) -> bool:
    """Whether a space can only begin a piece: the pattern ends in the usual alternatives, and the others take no white space."""
    head = pattern.removesuffix(NO_SPACES)
    return head != pattern and not regex.search(r"\\s|\\S|\.|\[\^|\\P", head) and " " not in head.replace(" ?", "")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def added_tokens(path: str) -> dict[str, int]:
    """The ids of the tokens that a tokenizer's JSON file adds: texts are cut at them, and they are no part of the vocabulary's pieces."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on their surroundings are not read")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def splitter(pattern: str) -> Callable[[str], Iterable[str]]:
    return regex.compile(pattern_text(pattern)).findall
