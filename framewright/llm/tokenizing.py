"""Token ids by public tokenizer files, built once per Python worker. Tokenizers are read, never trained."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np

END = 2  # id put behind every document
#: The pre-token pattern of the byte-level file, a fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def library(path: str):
    """The tokenizers object of a file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


#: Planes whose letters may come with a newer Unicode version; the others hold no letters, or private ones.
PLANES = (0, 1, 2, 3, 14)


@cache
def unlike(path: str) -> str:
    """The characters that the pattern engine and the tokenizers library class differently (letter, number, space or other), as they
    follow different Unicode versions. Those assigned in Python's own version are in both; the others are tried, a few bulk calls."""
    import unicodedata

    import regex

    cut, library_cut, out = regex.compile(PRE_TOKEN), library(path).pre_tokenizer.pre_tokenize_str, []
    new = [chr(i) for p in PLANES for i in range(p << 16, (p + 1) << 16) if unicodedata.category(chr(i)) == "Cn"]
    for lo in range(0, len(new), 20_000):
        part = new[lo:lo + 20_000]
        text = "".join(f"a{x}1{x}!{x}\n" for x in part)  # seven characters each
        ends = {m.end() for m in cut.finditer(text)} ^ {end for _, (_, end) in library_cut(text)}
        out += sorted({part[min((e - 1) // 7, len(part) - 1)] for e in ends})
    return "".join(out)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte: printable ones are themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_level(path: str):
    """A fast encoder with the file's own vocabulary; in such a file the ids are the merge ranks."""
    import tiktoken

    byte_of = _byte_of()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def byte_level_ids(path: str, text: str) -> np.ndarray:
    """Ids as the tokenizers library gives them without added special tokens. Texts with a special string inside, and any the
    fast encoder refuses, go to the library itself."""
    if not any(s in text for s in special_strings(path)):
        try:
            return np.asarray(byte_level(path).encode_to_numpy(text, disallowed_special=()), np.uint32)
        except BaseException as e:  # noqa: BLE001  a panic of the pattern engine on an odd text is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)


#: Separators that Python takes for white space and the tokenizers do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def _chunks(text: str) -> list[str]:
    """The chunks between Unicode white space."""
    if any(c in text for c in SEPARATORS):
        return [c for c in re.split(rf"[^\S{SEPARATORS}]+", text) if c]
    return text.split()


class WordIds(dict):
    """Ids of white-space separated chunks as little-endian bytes, kept per worker for at most ``limit`` chunks. The first half
    stays for good, as frequent chunks are met early; the rest makes room when the store is full.

    Only for tokenizers that drop white space and never merge across it. Unknown ASCII words are encoded by the library's
    merge model, other unknown chunks of a batch by the whole library in one call.
    """

    def __init__(self, path: str, limit: int = 900_000):
        super().__init__()
        self.tokenizer, self.limit = library(path), limit
        self.recent: list[str] = []
        self.merges = self.tokenizer.model

    def learn(self, chunks: set[str]) -> None:
        if len(self) + len(chunks) > self.limit:
            for c in self.recent:
                del self[c]
            self.recent = []
        room = max(0, self.limit // 2 - len(self))
        self.recent += list(chunks)[room:]
        rest = []
        for c in chunks:
            low = c.lower()
            if not c.isascii():
                rest.append(c)  # the file's normalizer is not Python's lower()
            elif low.isalpha():
                self[c] = self._word(low)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                self[c] = (self.get(low[:-1]) or self._word(low[:-1])) + self._word(low[-1])
            else:
                rest.append(c)
        for c, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self[c] = array("I", found.ids).tobytes()

    def _word(self, low: str) -> bytes:
        """The ids of one pre-token, ASCII lower-case letters or one mark, straight from the library's merge model."""
        return array("I", [t.id for t in self.merges.tokenize(low)]).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for lo in range(0, len(texts), 32):
            cut = [_chunks(t) for t in texts[lo:lo + 32]]
            found = [list(map(self.get, chunks)) for chunks in cut]
            gaps = [[i for i, v in enumerate(ids) if v is None] if None in ids else [] for ids in found]
            new = {chunks[i] for chunks, missing in zip(cut, gaps) for i in missing}
            if new:
                self.learn(new)
            for chunks, ids, missing in zip(cut, found, gaps):
                for i in missing:
                    ids[i] = self[chunks[i]]
                out.append(b"".join(ids))
        return out


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
