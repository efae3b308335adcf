"""Token ids of whole texts through caches of short pieces.

A tokenizer file of the `tokenizers` library is read once per worker. Texts are
cut only at places where the library would cut too, so the ids of the pieces,
joined, are the ids of the text:

* a file that drops white space and lower-cases (word BPE): at blanks and line
  ends; then at the pattern of its splitter;
* a byte-level file (byte BPE): before a blank that follows or precedes something
  other than white space; then at the pattern of its splitter.

A piece that holds anything but printable ASCII and Latin-1 letters, or the start
of a special token, goes to the library whole; so does every text under a
tokenizer of another kind. Pieces met before come from a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from lexalign.llm.common import worker_cache

#: Entries of a worker's cache of pieces, and of its cache of pre-tokens.
CACHE_PIECES = 400_000
CACHE_PRETOKENS = 800_000
#: Pieces longer than this are not kept.
CACHE_CHARS = 64

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PRINTABLE = re.compile(rf"[!-~{_LETTERS}]*")
_PRINTABLE_LINES = re.compile(rf"[!-~{_LETTERS}\n]*")
_WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_BYTE_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: A blank between white space, or between white space and the end, is no place to cut.
_UNSAFE_BLANK = re.compile(r"\s \s|\s \Z")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")


class Cache(dict):
    """Values made on demand; when full, all go but the pinned ones."""

    def __init__(self, make: Callable, limit: int, pinned: Mapping | None = None):
        super().__init__(pinned or {})
        self.make, self.limit, self.pinned = make, limit, pinned or {}

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.pinned)
            self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES, pretokens: int = CACHE_PRETOKENS):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = json.dumps(spec.get("normalizer")), spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        self.kind = "other"
        if spec["model"]["type"] == "BPE" and not spec["model"].get("byte_fallback"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
                    and spec.get("normalizer") is None:
                self.kind = "byte"
            elif all(x in normal for x in ("NFC", "Lowercase", r"\\s+")) and len(steps) == 2 \
                    and steps[0].get("pattern", {}).get("Regex") \
                    == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" \
                    and steps[0].get("invert") and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]:
                self.kind = "word"
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        if any(not t.startswith("<|") or re.search(r"\s", t) for t in specials):
            self.kind = "other"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(i) for i in range(256)]
        self.table = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in chars})
        self.pretokens = Cache(self._bpe, pretokens)
        self.pieces = Cache(self.piece_ids, pieces)
        self.counts, self.counts_name = Cache(lambda piece: len(self.piece_ids(piece)) // 4, pieces), None

    def counter(self, name: str, pinned: Mapping) -> Cache:
        """Numbers of tokens of pieces, with the table ``pinned`` of this name."""
        if self.counts_name != name:
            self.counts, self.counts_name = Cache(self.counts.make, self.counts.limit, pinned), name
        return self.counts

    def _bpe(self, pretoken: str) -> bytes:
        tokens = self.library.model.tokenize(pretoken.translate(self.table))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece; a piece of byte BPE comes without the blank before it."""
        if self.kind == "word":
            if "<|" not in piece and _PRINTABLE.fullmatch(piece):
                return b"".join(map(self.pretokens.__getitem__, _WORD_SPLIT.findall(piece.lower())))
            return self._whole(piece)
        return self._spaced(" " + piece)

    def _spaced(self, piece: str) -> bytes:
        if "<|" not in piece and _PRINTABLE_LINES.fullmatch(piece.lstrip(" ")):
            return b"".join(map(self.pretokens.__getitem__, _BYTE_SPLIT.findall(piece)))
        return self._whole(piece)

    def cut(self, text: str) -> list[str]:
        """Pieces of a text of word BPE."""
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def ids(self, text: str) -> bytes:
        if self.kind == "word":
            return b"".join(map(self.pieces.__getitem__, self.cut(text)))
        if self.kind == "byte":
            if _UNSAFE_BLANK.search(text):
                return b"".join(map(self._spaced, _SAFE_CUT.split(text)))
            first, *rest = text.split(" ")
            return self._spaced(first) + b"".join(map(self.pieces.__getitem__, rest))
        return self._whole(text)


def encoder(path: str, pieces: int = CACHE_PIECES, pretokens: int = CACHE_PRETOKENS) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    return worker_cache(("encoder", path, pieces, pretokens), lambda: Encoder(path, pieces, pretokens))


def default_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
