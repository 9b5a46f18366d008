"""Exact token ids of the tokenizers library, with the ids of frequent words remembered inside each Python worker.

The library decides every id. A text is cut only where its pre-tokenizer always cuts, so that the pieces can be looked up one
by one: before a space that a non-space follows (byte-level vocabularies), or at spaces and line feeds that the vocabulary
drops (vocabularies with word ends). Other tokenizer files go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_ENTRIES = 600_000
MEMO_CHARS = 48
#: Characters of text that are tokenized together.
BATCH_CHARS = 8 << 20

_ODD_SPACE = re.compile(r"\s\s|[^\S \n]")
#: Characters up to U+024F are composed already, and their lower case is one such character; but for U+0130.
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]|\u0130")
_BEFORE_WORD = re.compile(r"(?= \S)")


def _letters() -> list[str]:
    """Byte-level vocabularies write printable bytes of Latin-1 as themselves and the others, in order, from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_LETTERS = _letters()


def _byte_letters(s: str) -> str:
    return s if s.isascii() and s.isalpha() else "".join(_LETTERS[b] for b in s.encode())


class _Memo(dict):
    """word -> bytes of its ids (little-endian unsigned 32-bit); the newest MEMO_ENTRIES words and those used among as many before."""

    def __init__(self, encode, restore, merge):
        super().__init__()
        self.encode, self.restore, self.merge, self.before = encode, restore, merge, {}
        self.mark = lru_cache(lambda c: np.asarray(encode(c), dtype="<u4").tobytes())

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in (",", ".") and word[-2:-1].isalpha() and word[-2] < "\u0250" and word[-2] != "\u0130":
            return self[word[:-1]] + self.mark(word[-1])  # a mark after a letter is a pre-token of its own
        ids = self.before.get(word)
        if ids is None:
            # letters alone are one pre-token, for the merges as they are
            ids = self.merge(word) if word.isalpha() and max(word) < "\u0250" else None
            if ids is None:
                ids = array("I", self.encode(self.restore(word))).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class TokenIds:
    """ids(text): the ids as bytes, as encode(text, add_special_tokens=False).ids gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        self.largest = max(lib.get_vocab(with_added_tokens=True).values(), default=0)
        self.encode = lambda s: lib.encode(s, add_special_tokens=False).ids
        self.kind = self._kind(spec)
        merges, lead = lib.model, _byte_letters(" ") if self.kind == "spaced" else ""

        def merge(word: str) -> bytes | None:
            if self.kind == "dropped" and not word.islower():
                return None
            return array("I", [t.id for t in merges.tokenize(lead + (word if word.isascii() else _byte_letters(word)))]).tobytes()

        if self.kind == "spaced":
            self.memo = _Memo(self.encode, lambda w: w if w[:1] == "\n" else " " + w, merge)
        elif self.kind == "dropped":
            self.memo = _Memo(self.encode, lambda w: w, merge)

    @staticmethod
    def _kind(spec: dict) -> str:
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", [])):
            return "whole"
        if spec["model"].get("dropout"):
            return "whole"
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "spaced"
        steps = pre.get("pretokenizers", [])
        if (
            norm
            and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
        ):
            return "dropped"
        return "whole"

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "dropped":
            if not _BEYOND_LATIN.search(text):
                text = text.lower()  # as the normalizer does: here every character stands for itself
            return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))
        if self.kind == "spaced":
            if _ODD_SPACE.search(text):
                first, *rest = _BEFORE_WORD.split(text)
                words = [w[1:] for w in rest]
            else:
                first, *words = text.replace("\n", " \n").split(" ")
            return np.asarray(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.memo.__getitem__, words))
        return np.asarray(self.encode(text), dtype="<u4").tobytes()

    def forget(self) -> None:
        """Let go of the words remembered, so that an idle worker holds no more than the tokenizer."""
        if self.kind != "whole":
            self.memo.clear()
            self.memo.before = {}

    def batches(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of some texts after others: text i has ids[offsets[i]:offsets[i + 1]]. Where white space is dropped,
        words are split and told apart by Arrow, so that each distinct word of a few megabytes is looked up once."""
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield self._batch(part)
                part, size = [], 0
        if part:
            yield self._batch(part)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind != "dropped":
            ids = [self.ids(t) for t in texts]
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0] + [len(x) // 4 for x in ids])
        plain = [(t if _BEYOND_LATIN.search(t) else t.lower()).replace("\n", " ") for t in texts]
        words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        known = list(map(self.memo.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        index = coded.indices.to_numpy()
        size = sizes[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts[index] - upto[:-1], size) + np.arange(upto[-1])
        return flat[at], upto[ends - ends[0]]


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One per file and Python worker."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def version_digest(path: str) -> str:
    """Of everything that decides the ids: the file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]
