"""Token ids of many texts at once: numpy finds the pre-tokens, Arrow tells them apart, a cache knows their ids.

The bytes of a batch are classed by a table (letter, digit, white space, other). Where the class changes a
pre-token begins, but for the rules of the tokenizer's pattern, which are applied to whole arrays: a blank goes with what
follows it, white space before that is a pre-token of its own, ``'s 't 're 've 'm 'll 'd`` are cut off, and under word
BPE digits stand alone, letters are lower-cased and white space is dropped. Arrow numbers the distinct
pre-tokens of the batch, so a Python step is taken for each of them only, and its ids come from a
cache of bounded bytes, or from the library's BPE. The ids of the texts are one gather.

Texts with other characters than ASCII and Latin-1 letters, with ``<|`` (which may begin a special token), or
under other tokenizers go to :class:`tokens.Encoder`. Long texts are cut before a blank between words, where
every pattern cuts too.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from lexalign.llm.common import worker_cache
from lexalign.llm.tokens import Encoder

#: Bytes that the cache of pre-tokens may hold, half of them in each generation.
CACHE_BYTES = 48 << 20
#: Rows of an Arrow batch: the more, the fewer times a pre-token is looked up, and the more a worker holds.
ROWS = 512
#: Bytes of text that are handled at once.
STRETCH = 1 << 20

_LETTER, _DIGIT, _OTHER, _SPACE, _END, _ALIEN = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _ALIEN, dtype=np.uint8)
    out[0x21:0x7F] = _OTHER
    for first, last in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF)):       # a byte after C3 is part of a letter
        out[first:last + 1] = _LETTER
    out[0x30:0x3A] = _DIGIT
    out[0xC3] = _LETTER
    out[9:14] = out[0x20] = _SPACE
    out[0] = _END
    return out


_CLASS = _classes()
_ONE = np.zeros(256, dtype=bool)
_ONE[list(b"stmd")] = True


class IdCache:
    """Ids of pre-tokens; when the young generation is full it becomes the old one, whose used entries come back."""

    def __init__(self, make, limit: int = CACHE_BYTES):
        self.make, self.limit, self.held = make, limit // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def lookup(self, keys: list[bytes]) -> list[bytes]:
        values = list(map(self.young.get, keys))
        at = [i for i, v in enumerate(values) if v is None]
        if at:
            for i in at:
                values[i] = self.old.get(keys[i])
            new = [i for i in at if values[i] is None]
            for i, value in zip(new, self.make([keys[i] for i in new])):
                values[i] = value
            for i in at:
                self._keep(keys[i], values[i])
        return values

    def _keep(self, key: bytes, value: bytes) -> None:
        size = len(key) + len(value) + 200              # two objects and their place in the table
        if size < self.limit // 16:
            if self.held + size > self.limit:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[key] = value
            self.held += size


class BatchEncoder:
    """Ids of texts as bytes of unsigned integers."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.one = Encoder(path, 1 << 12, 1 << 12)
        self.words = self.one.kind == "word"
        self.cache = IdCache(self._ids, cache_bytes)

    def _ids(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens by the library's BPE; none of the end mark and of white space that is dropped."""
        mark = "\0".translate(self.one.table)
        bpe = self.one.library.model.tokenize
        spelled = b"\0".join(tokens).decode().translate(self.one.table).split(mark) if b"\0" not in tokens else \
            [t.decode().translate(self.one.table) for t in tokens]
        return [b"" if t == b"\0" or self.words and t.isspace() else array("I", [x.id for x in bpe(word)]).tobytes()
                for t, word in zip(tokens, spelled)]

    def forget(self) -> None:
        """Empty the cache, at the end of a task: an idle worker then holds the tokenizer alone."""
        self.cache.young, self.cache.old, self.cache.held = {}, {}, 0

    def encode(self, texts: list[bytes], dtype: str = "<u4") -> list[bytes]:
        """The ids of every text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            if self.one.kind == "other" or not _plain(text):
                out[i].append(np.frombuffer(self.one.ids(text.decode()), "<u4").astype(dtype).tobytes())
                continue
            for part in _parts(text):
                held.append(part)
                owners.append(i)
                size += len(part)
                if size >= STRETCH:
                    self._flush(held, owners, dtype, out)
                    held, owners, size = [], [], 0
        if held:
            self._flush(held, owners, dtype, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _flush(self, held: list[bytes], owners: list[int], dtype: str, out: list[list[bytes]]) -> None:
        raw = np.frombuffer(b"\0".join(held) + b"\0", dtype=np.uint8)
        if self.words:
            raw = _lower(raw)
        starts = np.flatnonzero(_begins(raw, self.words)).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, np.int32(len(raw))).tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        index = tokens.indices.to_numpy()
        values = self.cache.lookup(tokens.dictionary.to_pylist())
        lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        known = np.frombuffer(b"".join(values), dtype="<u4").astype(dtype)
        first = np.cumsum(lengths) - lengths
        n = lengths[index]
        ends = np.cumsum(n)
        flat = known[np.repeat(first[index] - ends + n, n) + np.arange(int(ends[-1]))].tobytes()
        wide = np.dtype(dtype).itemsize
        stops = (ends[np.flatnonzero(raw[starts] == 0)] * wide).tolist()
        at = 0
        for i, stop in zip(owners, stops):
            out[i].append(flat[at:stop])
            at = stop


def _plain(text: bytes) -> bool:
    """Only characters whose class the table knows, and no start of a special token."""
    if b"<|" in text:
        return False
    if text.isascii():
        raw = np.frombuffer(text, dtype=np.uint8)
        return not (_CLASS[raw] >= _END).any()
    if b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return False
    return not (_CLASS[np.frombuffer(text, dtype=np.uint8)] >= _END).any()


def _parts(text: bytes) -> list[bytes]:
    """The text, cut before blanks between words where it is long."""
    out = []
    while len(text) > STRETCH:
        cut = STRETCH
        while True:
            cut = text.rfind(b" ", 1, cut)
            if cut <= 0 or not (text[cut - 1:cut].isspace() or text[cut + 1:cut + 2].isspace()):
                break
        if cut <= 0:
            break
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def _lower(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capital = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E)]
    out[capital] += 0x20
    return out


def _begins(raw: np.ndarray, words: bool) -> np.ndarray:
    """Where pre-tokens begin, as booleans; every end mark is one by itself."""
    kind = _CLASS[raw]
    begin = np.empty(len(raw), dtype=bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    ends = np.flatnonzero(kind == _END)
    begin[ends] = True
    begin[ends[:-1] + 1] = True
    if words:
        digits = np.flatnonzero(kind == _DIGIT)
        begin[digits] = True
    else:       # of white space, the last character before something else
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE))
        begin[last] = True
        begin[last[raw[last] == 0x20] + 1] = False
    mark = np.flatnonzero(raw[:-2] == 0x27)
    mark = mark[begin[mark] & (kind[mark + 1] == _LETTER)]
    a, b = raw[mark + 1], raw[mark + 2]
    one = mark[_ONE[a]]
    two = mark[((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)]
    for at, n in ((one, 1), (two, 2)):
        begin[at + 1] = False
        begin[at + 1 + n] = True
    return begin


def batch_encoder(path: str, cache_bytes: int = CACHE_BYTES) -> BatchEncoder:
    """The worker's encoder of a tokenizer file."""
    return worker_cache(("batch encoder", path, cache_bytes), lambda: BatchEncoder(path, cache_bytes))
