"""Pre-token splitting and byte-pair encoding for the public tokenizer files.

``Splitter`` cuts a text into the pieces the library's pre-tokenizer would give.
Texts made only of characters whose classes are the same in every Unicode
version are split by a compiled pattern; any other text goes through the
library's own normalizer and pre-tokenizer, so odd characters can't differ.
"""

from __future__ import annotations

import json
from functools import lru_cache

#: Any character outside this range sends a text through the library itself.
UNUSUAL = r"[^\x09-\x0d\x20-\x7e\xa0-ɏ]"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level BPE defines it."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


@lru_cache(maxsize=1)
def alphabet_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def to_alphabet(piece: str) -> str:
    table = byte_alphabet()
    return "".join([table[b] for b in piece.encode("utf-8", "surrogatepass")])


def from_alphabet(piece: str) -> bytes:
    table = alphabet_bytes()
    return bytes([table[c] for c in piece])


class Splitter:
    """Pre-tokens of a text; a special token found in the text comes as its id."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = spec["normalizer"] is not None
        pattern = regex.compile(WORD_END if self.lower else BYTE_LEVEL)
        self.find, self.find_spans = pattern.findall, pattern.finditer
        self.stretches = regex.compile(r"\S+" if self.lower else r"\s*\S+|\s+").finditer
        self.unusual = regex.compile(UNUSUAL).search
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.marks = regex.compile("|".join(map(regex.escape, self.special))).findall if self.special else None
        self.hint = "<|"

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if self.unusual(text) is None:
            return self.find(text.lower() if self.lower else text)
        if self.lower:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [from_alphabet(p).decode("utf-8", "replace") for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def spans(self, text: str) -> list[tuple[int, int, str]] | None:
        """Pre-tokens with their places; None if the text has special tokens, unusual characters or changes its length."""
        lowered = text.lower() if self.lower else text
        if self.unusual(text) is not None or len(lowered) != len(text) or (self.marks is not None and self.hint in text):
            return None
        return [(m.start(), m.end(), m[0]) for m in self.find_spans(lowered)]

    def pieces(self, text: str) -> list:
        """Pre-tokens as strings, special tokens as their integer ids."""
        if self.cut is None or self.hint not in text:
            return self.plain(text)
        parts, marks, out = self.cut(text), self.marks(text), []
        for i, part in enumerate(parts):
            out += self.plain(part)
            if i < len(marks):
                out.append(self.special[marks[i]])
        return out


class PrefixTable:
    """Token counts of every prefix of a word, by dynamic programming.

    A token sequence is what byte-pair encoding gives exactly if each adjacent
    pair of its tokens is what encoding that pair's text gives.  So the encoding
    of a prefix ends in the one token that is compatible with the last token of
    the prefix before it, and ``count[i] = count[i - len(token)] + 1``.  One pass
    stores count and last token at every position; no prefix is encoded twice.

    Vocabularies with a word-end suffix need two counts a position: ``inner`` (the
    word goes on) and ``ended`` (the prefix is the whole word).
    """

    PAIRS = 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.longest = max(len(t.removesuffix(self.suffix) if self.suffix else t) for t in self.vocab)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.live = {t for t in self.vocab if self.merged(self.symbols(t)) == [t]}

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get((symbols[i], symbols[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def _last(self, word: str, i: int, tail: str, last: list[str]) -> tuple[str, int]:
        """The token that ends the encoding of word[:i] + tail, and where it starts."""
        live, pairs = self.live, self.pairs
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + tail
            if token in live:
                if not j:
                    return token, 0
                fits = pairs.get((last[j], token))
                if self.compatible(last[j], token) if fits is None else fits:
                    return token, j
        raise ValueError(f"no token of the vocabulary ends {word[:i]!r}")

    def prefixes(self, word: str) -> tuple[list[int], list[str]]:
        """Count and last token at each position of a word, given in the byte alphabet, that goes on."""
        last, count = [""], [0]
        for i in range(1, len(word) + 1):
            token, j = self._last(word, i, "", last)
            last.append(token)
            count.append(count[j] + 1)
        return count, last

    def ended(self, piece: str) -> list[int]:
        """Tokens of piece[:i] taken as whole words, for each byte i from 0 on."""
        word = to_alphabet(piece)
        count, last = self.prefixes(word)
        if not self.suffix:
            return count
        return [0, *(count[j] + 1 for _, j in (self._last(word, i, self.suffix, last) for i in range(1, len(word) + 1)))]

    def total(self, piece: str) -> int:
        """Tokens of the whole piece."""
        word = to_alphabet(piece)
        if not word:
            return 0
        if word + self.suffix in self.live:
            return 1
        if not self.suffix:
            return self.prefixes(word)[0][-1]
        count, last = self.prefixes(word[:-1])
        return count[self._last(word, len(word), self.suffix, last)[1]] + 1
