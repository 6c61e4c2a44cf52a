"""Ids of whole texts by the tokenizers library, with a bounded memo of the pieces that a text falls into.

A text is cut where no pre-token crosses; the pieces that the memo lacks go through the library: plain
words through its merge model alone, everything else through its whole pipeline.
"""

import os
import re
from array import array
from collections.abc import Callable, Iterable
from operator import attrgetter

import numpy as np

from .common import WordCache, windows

MARKS = ".,;:!?"
ID = attrgetter("id")
LETTER = "[0-9A-Za-zÀ-ÖØ-öø-ɏ]"  # letters and digits in every Unicode version
LATIN_END = "ɐ"  # letters below are composed, of one case rule, and letters in every Unicode version

if array("I").itemsize != 4:
    raise ImportError("needs 4-byte unsigned integers")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: printable Latin-1 as it is, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def plain_word(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) < LATIN_END)


class PieceMemo:
    """Packed ids (4 bytes each, little-endian) of texts by way of their pieces. A subclass says how a
    text is cut (``pieces``) and what the ids of pieces are (``learn``)."""

    def __init__(self, path: str, special_as_text: bool, entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the workers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.cache = WordCache(entries)

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def merged(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's merge model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        elif word[0] == " ":
            word = "Ġ" + word[1:]
        return array("I", map(ID, self.merge(word))).tobytes()

    def piped(self, pieces: list[str]) -> Iterable[tuple[str, bytes]]:
        """Ids of pieces, by the library's whole pipeline."""
        for i in range(0, len(pieces), 4000):
            part = pieces[i : i + 4000]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                yield piece, array("I", e.ids).tobytes()

    def known(self, pieces: Iterable[str]) -> Callable[[str], bytes]:
        """A lookup that has every one of ``pieces``; short ones stay in the memo."""
        cache = self.cache
        cache.trim()
        found = self.learn({p for p in pieces if p not in cache})
        long = {p: ids for p, ids in found.items() if len(p) > cache.longest}
        if not long:
            cache.update(found)
            return cache.__getitem__
        cache.update((p, ids) for p, ids in found.items() if p not in long)
        return lambda p: long[p] if p in long else cache[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        out, held, size = [[] for _ in texts], [], 0

        def settle() -> None:
            lookup = self.known(set().union(*(pieces for _, pieces in held)))
            for i, pieces in held:
                out[i].append(b"".join(map(lookup, pieces)))

        for i, text in enumerate(texts):
            for window in windows(text):
                held.append((i, self.pieces(window)))
                size += len(window)
                if size > 1 << 22:
                    settle()
                    held, size = [], 0
        settle()
        return [b"".join(x) for x in out]


class ByteLevelIds(PieceMemo):
    """Vocabularies whose pre-tokens may start with one space: cut before single spaces and line feeds
    between other characters, and before a single mark after a word."""

    def __init__(self, path: str, special_as_text: bool = False, entries: int = 1_000_000):
        super().__init__(path, special_as_text, entries)
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or not plain:
            raise ValueError("only byte-level tokenizers without normaliser and prefix space")
        self.cut = re.compile(r"(?<=\S) (?=\S)").sub
        self.mark = re.compile(rf"[{MARKS}](?=\0|\Z)(?<={LETTER}.)").sub

    def pieces(self, text: str) -> list[str]:
        return [text] if "\0" in text else self.marked(text).split("\0") if text else []

    def marked(self, text: str) -> str:
        """``text``, which holds no NUL, with one at every cut."""
        if " ".join(text.split()) == text.replace("\n", " "):  # white space is single spaces and line feeds
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n")
        else:
            cut = self.cut("\0 ", text)
        return self.mark("\0\\g<0>", cut)

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        merged, found, rest = self.merged, {}, []
        for p in pieces:
            if plain_word(p[1:] if p[0] == " " else p):
                found[p] = merged(p)
            else:
                rest.append(p)
        found.update(self.piped(rest))
        return found


class WordIds(PieceMemo):
    """Vocabularies that drop white space and end words: cut at white space."""

    def __init__(self, path: str, special_as_text: bool = False, entries: int = 1_000_000):
        super().__init__(path, special_as_text, entries)
        if any(t["lstrip"] or t["rstrip"] or len(t["content"].split()) != 1 for t in self._spec()["added_tokens"]):
            raise ValueError("a special token holds white space or takes that beside it")
        # pre-tokens of lower-case ASCII text
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        self.odd_space = re.compile("[\x1c-\x1f]").search

    def _spec(self) -> dict:
        import json

        spec = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or not pre[0].get("invert") or pre[0].get("behavior") != "Removed":
            raise ValueError("only lower-case tokenizers that drop white space")
        return spec

    def pieces(self, text: str) -> list[str]:
        if self.odd_space(text):  # str.split() cuts there, the vocabulary does not
            return re.split("[ \n]+", text)
        return text.split()

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        merged, found, rest, words = self.merged, {}, [], {}
        for p in pieces:
            if p.isascii() and "<|" not in p:
                if p.isalpha():
                    found[p] = merged(p.lower())
                    continue
                ids = []
                for part in self.parts(p.lower()) if p.isprintable() else ():
                    if part not in words:
                        words[part] = merged(part)
                    ids.append(words[part])
                if ids:
                    found[p] = b"".join(ids)
                    continue
            elif p.isalpha() and max(p) < LATIN_END and "İ" not in p:
                found[p] = merged(p.lower())
                continue
            rest.append(p)
        found.update(self.piped(rest))
        return found
