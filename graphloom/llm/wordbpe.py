"""Tokenisation through pieces that are cut off by white space.

A tokenizer file whose normaliser folds white space and whose pre-tokenizer
drops it gives the ids of a text as those of its white-space chunks, one after
another. Chunks repeat far more often than texts, so a bounded cache of chunks
and of their pre-tokens replaces most calls of the library. Chunks with signs
other than ASCII and the common Latin letters go to the library whole.
"""

from __future__ import annotations

import array
import gc
import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters, digits one by one, and runs of other signs, as the file's own
#: pre-tokenizer pattern has them for this range of signs (fixed values).
_LATIN = "à-öø-ÿß"
_PRE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{_LATIN}]+|[0-9]|[!-/:-@\[-`{{-~]+").findall
_PLAIN = re.compile(rf"[\x21-\x7e{_LATIN}]*").fullmatch

#: Entries of a cache's younger half, and the longest entry: some 100 MB in all. A full younger half becomes the older one.
CACHE_CHUNKS, CACHE_PRE, CACHE_LENGTH = 120_000, 150_000, 48


def _byte_signs() -> dict[int, str]:
    """The visible sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {k: v for k, v in spec.items() if k != "model"} | {"model": {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}}


def splits_on_space(path: str) -> bool:
    """Whether chunks between white space can be tokenised on their own."""
    if not path.endswith(".json"):
        return False
    c = config(path)
    kinds = [x["type"] for x in (c.get("normalizer") or {}).get("normalizers", [])]
    pre = (c.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0].get("invert") is True and not pre[1].get("add_prefix_space") and c["model"]["type"] == "BPE" and c.get("post_processor") is None


class ChunkTokenizer:
    """Ids, and counts of ids, of a text's white-space chunks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        if not splits_on_space(path):
            raise ValueError(f"{path} doesn't cut texts at white space")
        self._full = Tokenizer.from_file(path)
        self._full.no_truncation()
        self._full.no_padding()
        self._model = self._full.model
        self._special = {x["content"].encode(): x["id"] for x in config(path)["added_tokens"]}
        parts = sorted((re.escape(x) for x in self._special), key=len, reverse=True)
        self._marks = re.compile(b"(" + b"|".join(parts) + b")") if parts else None
        self._hint = os.path.commonprefix(list(self._special)) if parts else b""
        self._signs = _byte_signs()
        self._wide = {i: s for i, s in self._signs.items() if chr(i) != s}
        self._hint_text = self._hint.decode().lower()
        self.forget()

    def forget(self) -> None:
        """Empty the caches."""
        self._pre: dict[str, bytes] = {}
        self._pre_old: dict[str, bytes] = {}
        self._chunk: dict[bytes, bytes] = {}
        self._chunk_old: dict[bytes, bytes] = {}

    def _marked(self, text: str) -> bool:
        """Whether a special mark, or what looks like the beginning of one, may stand in the text."""
        return bool(self._special) and self._hint_text in text.lower()

    def chunks(self, text: str) -> list[bytes]:
        """The text's chunks, ASCII letters in lower case, marks on their own."""
        raw = text.encode("utf-8", "replace")
        if not self._special or self._hint not in raw:
            return raw.lower().split()
        out: list[bytes] = []
        for i, part in enumerate(self._marks.split(raw)):
            if i % 2:
                out.append(part)
            else:  # a mark in capitals stays text: in lower case it would be taken for one
                out += [x if self._hint in x.lower() else x.lower() for x in part.split()]
        return out

    def pre_tokens(self, chunk: bytes) -> list[str]:
        """The chunk's pre-tokens; a chunk with other signs is one of its own."""
        if chunk.isalpha():
            return [chunk.decode()]
        text = chunk.decode("utf-8", "replace")
        if self._marked(text):
            return [text]
        low = text if text.isascii() else text.lower()
        found = _PRE(low)
        return found if sum(map(len, found)) == len(low) else [text]

    def encode_pre(self, pre: str) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        if not pre.isalnum() and self._marked(pre) or not _PLAIN(pre):
            return array.array("I", self._full.encode(pre, add_special_tokens=False).ids).tobytes()
        if not pre.isascii():
            pre = pre.encode().decode("latin-1").translate(self._wide)
        return array.array("I", [t.id for t in self._model.tokenize(pre)]).tobytes()

    def ids_of_pre(self, pre: str) -> bytes:
        got = self._pre.get(pre)
        if got is None:
            got = self._pre_old.get(pre) or self.encode_pre(pre)
            if len(pre) <= CACHE_LENGTH:
                if len(self._pre) >= CACHE_PRE:
                    self._pre, self._pre_old = {}, self._pre
                self._pre[pre] = got
        return got

    def _fill(self, chunk: bytes) -> bytes:
        got = self._chunk_old.get(chunk)
        if got is None:
            got = b"".join(map(self.ids_of_pre, self.pre_tokens(chunk)))
        if len(chunk) <= CACHE_LENGTH:
            if len(self._chunk) >= CACHE_CHUNKS:
                self._chunk, self._chunk_old = {}, self._chunk
            self._chunk[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """The whole text's ids as little-endian 32-bit numbers."""
        fill = self._fill
        return b"".join([self._chunk.get(c) or fill(c) for c in self.chunks(text)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process; its caches hold nothing that a search for cycles could free."""
    gc.set_threshold(200_000, 20, 100)
    return ChunkTokenizer(path)
