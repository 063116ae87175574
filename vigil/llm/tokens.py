"""Exact token ids from the ``tokenizers`` library, with a cache of pieces.

A byte-level or word BPE never merges over the start of a run of white
space, so a text's ids are its pieces' ids one after the other, and a
frequent piece is encoded once per worker. Texts that may hold a special token's
string are given to the library whole. ``tests/llm/test_tokens.py``
holds this against whole-text encoding. Ids are kept as little-endian
unsigned 32-bit bytes, the form that files and checksums use.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

CACHE_PIECES = 1_000_000   # pieces that a worker keeps
CACHE_CHARS = 64           # longer pieces are not kept
RENEW_MISSES = 8 * CACHE_PIECES   # pieces encoded beside a full cache before it is started anew
BATCH_CHARS = 4_000_000    # characters of texts looked up together
# white space of the tokenizers' patterns, without space and line feed
_ODD_ASCII = "\t\x0b\x0c\r"
_ODD_WIDE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WS = re.escape(" \n" + _ODD_ASCII + _ODD_WIDE)
_PIECES = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f\0"   # the first four: white space for str.split, not for the patterns


def one_to_one_case(text: str) -> bool:
    """Whether lower-casing the text is lower-casing each of its characters."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder of a tokenizer file; its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        # what a special token's string begins with, in the text as it is or in lower case
        self.marks = sorted({t.content[:2] for t in self.tok.get_added_tokens_decoder().values()})
        self.keeps_space = bool(self._encode([" "])[0])
        self.newline = self._encode(["\n"])[0]
        ends = [i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]
        self.closes = np.zeros(1 << 17, bool)   # by id: the last of a word, or a line feed
        self.closes[ends if not self.keeps_space else np.frombuffer(self.newline, "<u4")] = True
        self.known: dict[str, bytes] = {}
        self.missed = 0   # pieces encoded since the cache was full

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, many in one text: a line feed, or the
        mark of a word's end, tells them apart."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at:at + 2000]
            text = "".join([f" {w}\n" for w in some] if self.keeps_space else [f"{w} " for w in some])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) != len(some):
                out += self._encode([f" {w}" if self.keeps_space else w for w in some])
                continue
            raw, a = ids.tobytes(), 0
            for b in (ends * 4).tolist():
                out.append(raw[a:b if self.keeps_space else b + 4])
                a = b + 4
        return out

    def _split(self, text: str) -> tuple[list[str], int]:
        """The text's pieces and how many leading bytes of ids to drop. A
        piece is kept without its leading space, or starts with a line feed."""
        if any(c in text for c in _SEPARATORS) or any(m in text for m in self.marks):
            return [f"\0{text}"], 0
        if not self.keeps_space:
            return (text.lower() if one_to_one_case(text) else text).split(), 0
        odd = any(c in text for c in _ODD_ASCII) or (
            not text.isascii() and any(c in text for c in _ODD_WIDE))
        if not text or odd or text[0] in " \n" or text[-1] in " \n" or any(
                s in text for s in ("  ", "\n ", " \n", "\n\n")):
            return [f"\0{p}" for p in _PIECES.findall(text)], 0
        return ("\n" + text.replace("\n", " \n")).split(" "), len(self.newline)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of unseen pieces. A Latin letter followed by a full stop or comma is
        always a boundary, so such a piece is its stem and that mark."""
        stems = {w: w[:-1] for w in new
                 if len(w) > 1 and w[-1] in ".," and w[-2] < "\xff" and w[-2].isalpha()
                 and w[0] != "\0"}
        plain = list({*(w for w in new if w not in stems),
                      *(s for s in stems.values() if s not in self.known)})
        rest = [w for w in plain if not w.isalpha()]
        plain = [w for w in plain if w.isalpha()]
        words = [w for w in plain if not w.isascii()]
        space = " " if self.keeps_space else ""
        got = dict(zip(words, self._encode_words(words)))
        # letters of ASCII stand for themselves in the model's alphabet, and a word of them is one piece of its pattern
        ids_of = self.model.tokenize
        got.update((w, array("I", [t.id for t in ids_of("\u0120" + w if self.keeps_space else w.lower())]).tobytes())
                   for w in plain if w.isascii())
        got.update(zip(rest, self._encode(
            [w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else space + w for w in rest])))
        if stems:
            marks = dict(zip(".,", self._encode([".", ","])))
            for w, s in stems.items():
                got[w] = (got[s] if s in got else self.known[s]) + marks[w[-1]]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._encode_group(texts[at:end])
            at = end
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        known = self.known
        missing = set().union(*[pieces for pieces, _ in split]).difference(known)
        got = self._learn(list(missing)) if missing else {}
        known.update(got)
        of = known.__getitem__
        out = [b"".join(map(of, pieces))[drop:] for pieces, drop in split]
        full = len(known) > CACHE_PIECES
        for p in got:
            if full or len(p) > CACHE_CHARS:
                del known[p]
        if full:   # what was met first need not be what is frequent by now
            self.missed += len(got)
            if self.missed > RENEW_MISSES:
                self.known, self.missed = {}, 0
        return out


def ids_with_end(path: str, texts: list[str | None], end_id: int) -> list[bytes]:
    """Each text's ids and the end id, as little-endian u32 bytes."""
    end = np.array([end_id], "<u4").tobytes()
    return [ids + end for ids in encoder(path).encode([t or "" for t in texts])]
