"""Token ids of whole texts with the tokenizers library.

Where the tokenizer is byte-level BPE without a normaliser, its merges never cross the pieces that its
split pattern makes, so each distinct piece is encoded once by the library's model and kept; the ids of a
text are those of its pieces. Texts are cut together, by the kinds of neighbouring characters, and only the distinct
pieces of a chunk become Python strings. Any other tokenizer encodes whole texts. The queries give the library's default ids
(``add_special_tokens=False``): an added token that stands in a text is one id, and such a text is encoded whole.
With ``added=False`` special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from lintlake.llm.text_arrays import chunks, give_back, ranges, texts_of

#: The split pattern of byte-level pre-tokenizers, which :func:`cut` follows. No two alternatives but the second and
#: fourth begin alike, so their order only matters between those.
PIECES = r""" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
END_ID = 0
#: Pieces that a worker keeps; then it starts anew.
KEPT_PIECES = 500_000


def byte_signs() -> dict[int, int]:
    """Sign of each byte in byte-level vocabularies: itself if it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


@cache
def _kinds() -> np.ndarray:
    """Kind of each code point, as the split pattern tells them apart."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            kinds[found.start() : found.end()] = kind
    return kinds


def cut(text: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin in ``data``, their UTF-8 bytes; ``text`` is the same as a string."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    byte = np.flatnonzero(data & 0xC0 != 0x80)
    begin = np.zeros(n + 1, bool)  # of a text
    begin[np.searchsorted(byte, offsets)] = True
    kind = _kinds()[code]
    new = np.ones(n + 1, bool)
    new[1:n] = (kind[1:] != kind[:-1]) | begin[1:n]
    first = np.flatnonzero(new)
    first, end = first[:-1], first[1:]
    kind, goes_on = kind[first], ~begin[end]
    # the last one of several spaces is a piece of its own, or a blank goes to what follows
    last = end[(kind == SPACE) & goes_on] - 1
    new[last] = True
    new[last[code[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll, unless a blank or another sign stands before
    at = np.flatnonzero((kind[:-1] == OTHER) & (end[:-1] - first[:-1] == 1) & (code[first[:-1]] == 0x27) & new[first[:-1]] & goes_on[:-1] & (kind[1:] == LETTER))
    start, stop = first[at + 1], end[at + 1]
    one, two = code[start], np.where(start + 1 < stop, code[np.minimum(start + 1, n - 1)], 0)
    size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    start, size = start[size > 0], size[size > 0]
    new[start] = False
    new[start + size] = True
    return byte[np.flatnonzero(new[:n])]


class _Pieces(dict):
    """Number of each piece; a new one is encoded."""

    def __init__(self, model):
        super().__init__()
        self.model, self.signs = model, byte_signs()
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.signs))
        self.ids.extend([t.id for t in found])
        self.ends.append(len(self.ids))
        n = self[piece] = len(self.ends) - 2
        return n


class Encoder:
    def __init__(self, path: str, added: bool = False, kept: int = KEPT_PIECES):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        self.by_piece = (
            kind["normalizer"] is None and kind["model"]["type"] == "BPE" and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and split.get("use_regex", True)
        )
        tokens = [t["content"] for t in kind["added_tokens"] if added or not t["special"]]
        self.whole = regex.compile("|".join(map(regex.escape, tokens))).search if tokens else None
        self.pieces, self.kept = _Pieces(self.tokenizer.model), kept

    def __call__(self, texts: list[str | None] | pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (each followed by ``end``), and where each text's ids begin (one more than texts)."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.by_piece:
            ids, sizes = self._by_piece(column)
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            sizes = np.array([len(x) for x in found], np.int64)
            ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(x, np.uint32) for x in found]])
        if end is None:
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(first[-1], end, np.uint32)
        out[ranges(first[:-1], sizes)] = ids
        return out, first

    def _by_piece(self, column):
        if len(self.pieces) > self.kept:
            self.pieces = _Pieces(self.tokenizer.model)
        data, offsets = texts_of(column)
        joined, whole = data.tobytes().decode(), {}
        if self.whole and self.whole(joined):
            texts = [t or "" for t in column.to_pylist()]
            whole = {k: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for k, t in enumerate(texts) if self.whole(t)}
            data, offsets = texts_of(pa.array(["" if k in whole else t for k, t in enumerate(texts)], pa.string()))
            joined = data.tobytes().decode()
        begin = cut(joined, data, offsets)
        ends = pa.py_buffer(np.append(begin, len(data)).astype(np.int32))
        found = pa.StringArray.from_buffers(len(begin), ends, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False)  # strings, without a scalar each
        which = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
        ends = np.array(self.pieces.ends)
        size = (ends[1:] - ends[:-1])[which]
        ids = np.array(self.pieces.ids, np.uint32)[ranges(ends[which], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        cuts = np.searchsorted(begin, offsets)
        sizes = np.diff(total[cuts])
        if whole:
            at = total[cuts]
            parts, last = [], 0
            for k, own in whole.items():
                parts += [ids[last : at[k]], own]
                last, sizes[k] = at[k], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder per worker and vocabulary: what it has learnt, up to ``kept`` pieces, serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    _encoders[path].kept = kept
    return _encoders[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, limit: int, kept: int = KEPT_PIECES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with the ids of their texts."""
    give_back()  # a worker that has served other operators brings their memory along
    encode = encoder(path, kept)
    for batch in chunks(batches, limit=limit):
        yield batch, *encode(batch.column("text"))
