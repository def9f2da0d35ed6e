"""Byte-level BPE over Arrow text: the pieces of a text are cut in numpy, and each distinct piece is encoded once.

The cut follows the pre-tokenizer's pattern (contractions, then letters, digits and other signs with one
leading space each, then white space); which characters are letters, numbers or space comes from that
pattern's own classes. Encoding a piece is left to ``tiktoken``; nothing is trained here.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, points):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind if b - a + 1 == len(m[0]) else out[a : b + 1]
            if b - a + 1 != len(m[0]):
                out[[ord(c) for c in m[0]]] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte: that of the character it belongs to."""
    table = classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int64)
        own, width = table[code_points(data, lead)], np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))
        for i in range(4):
            at = width > i
            kind[lead[at] + i] = own[at]
    return kind


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at the given bytes."""
    b = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) for i in range(4)]
    two, three = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    return np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces begin; every document begins one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    doc_start = np.zeros(n + 1, bool)
    doc_start[offs[:-1]] = True
    doc_start[n] = True
    run = np.empty(n + 1, bool)  # a run of one class begins
    run[n] = True
    run[1:n] = kind[1:] != kind[:-1]
    run |= doc_start
    start = run.copy()
    char = (data & 0xC0) != 0x80  # first bytes of characters
    # the last of several white-space characters before other text stands apart
    space_run = np.flatnonzero(run[:n] & (kind == SPACE))
    if len(space_run):
        runs = np.flatnonzero(run)
        end = runs[np.searchsorted(runs, space_run, "right")]
        inner = ~doc_start[end]  # text of the same document follows
        a, e = space_run[inner], end[inner]
        last = e - 1
        while (back := ~char[last]).any():
            last = np.where(back, last - 1, last)
        start[last] = True
        # one blank before a letter, digit or sign belongs to it
        blank = data[last] == 0x20
        start[e[blank]] = False
    # 's and its like, where the sign stands alone and no blank leads it
    sign = np.flatnonzero((data == 0x27) & run[:n] & run[1:])
    sign = sign[start[sign] & ~doc_start[sign + 1]]
    for tail in CONTRACTIONS:
        if not len(sign):
            break
        w = len(tail)
        fits = sign + w < n
        for i, c in enumerate(tail):
            fits &= data[np.minimum(sign + 1 + i, n - 1)] == ord(c)
            if i:
                fits &= ~doc_start[np.minimum(sign + 1 + i, n)]
        hit = sign[fits]
        start[hit + 1] = False
        start[hit + 1 + w] = True
        sign = sign[~fits]
    return np.flatnonzero(start[:n])


def special_pattern(added: list[str]) -> re.Pattern[bytes] | None:
    """What finds the strings of added tokens: the longest that begins first."""
    return re.compile(b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True))) if added else None


def pieces_with(data: np.ndarray, offs: np.ndarray, special: re.Pattern[bytes] | None) -> np.ndarray:
    """``piece_starts``, where every added token inside a document is a piece of its own and cuts the text around it."""
    if not special or not special.search(data):
        return piece_starts(data, offs)
    raw = data.tobytes()
    spans = np.array([m.span() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in special.finditer(raw, a, b)], np.int64).reshape(-1, 2)
    starts = piece_starts(data, np.unique(np.concatenate([offs, spans.ravel()])))
    at = np.searchsorted(spans[:, 0], starts, "left") - 1  # the last token that begins before
    inside = (at >= 0) & (starts < spans[np.maximum(at, 0), 1]) if len(spans) else np.zeros(len(starts), bool)
    return starts[~inside]


class Bpe:
    """Ids of texts under a ``.tiktoken`` rank file; distinct pieces seen before are kept up to ``most``.

    ``special`` gives the ids of added tokens: their strings inside a text are one id each. Without it they are ordinary text.
    """

    def __init__(self, path: str, special: dict[str, int] | None = None, most: int = 200_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special, self.added = special_pattern(list(special or {})), {t.encode(): [i] for t, i in (special or {}).items()}
        self.known: dict[bytes, np.ndarray] = {}
        self.most = most

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and the n + 1 offsets of the documents in them."""
        n_docs = len(offs) - 1
        starts = pieces_with(data, offs, self.special)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        if len(self.known) > self.most:
            self.known = {}
        known, encode, distinct = self.known, self.core.encode_single_piece, coded.dictionary.to_pylist()
        lists = list(map(known.get, distinct))
        for i, ids in enumerate(lists):
            if ids is None:
                lists[i] = known[distinct[i]] = self.added.get(distinct[i]) or encode(distinct[i])
        ends = np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1]))
        taken = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(flat)).take(coded.indices)
        before = taken.offsets.to_numpy().astype(np.int64)
        return taken.flatten().to_numpy(), before[np.searchsorted(starts, offs, "left")]
