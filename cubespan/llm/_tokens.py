"""A byte-level BPE of the tokenizers library, run once for each distinct piece of text that a worker meets.

Text is cut where the library's own pattern always cuts: before a space that stands between two characters
other than white space, and between letters, digits and other characters. A piece's tokens then don't depend
on what stands around it, so they can be kept. A run that holds an apostrophe or a character beyond Latin-1
letters isn't cut inside; a document with white space beyond ASCII goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cubespan.llm import _text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[0xC3] = _CLASS[0x80:0xC0] = _LETTER
#: Bytes after which the class of a character can't be told from the byte alone.
_UNSURE = np.zeros(256, bool)
_UNSURE[0xC0:] = True
_UNSURE[0xC3] = False
_UNSURE[[39]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[:9] = _CONTROL[14:32] = _CONTROL[127] = True
_WIDE_SPACE = ("\u0085", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: Any white space or control character.
_INNER = re.compile(b"[\x00-\x20\x7f]|" + b"|".join(re.escape(c.encode()) for c in _WIDE_SPACE))
_loaded: dict[str, Encoder] = {}


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def encoder(path: str) -> Encoder:
    """The one encoder of this process for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    """Token ids of many texts. most: distinct pieces kept; beyond it the store starts anew, which costs time only."""

    def __init__(self, path: str, most: int = 1_500_000, part_bytes: int = 2 << 20) -> None:
        self.library = tokenizer(path)
        self.special = [a.content for a in self.library.get_added_tokens_decoder().values()]
        self.most, self.part_bytes, self.joined = most, part_bytes, 200
        line = self.library.encode("a\na", add_special_tokens=False).ids
        self.newline = line[1] if len(line) == 3 and line[0] == line[2] else None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) one after the other, and the offsets of the documents in them. Null is empty."""
        data, off = _text.utf8(column)
        ids, sizes = [], []
        for i, j in _text.parts(off, self.part_bytes):
            a, b = self._part(data[off[i] : off[j]], off[i : j + 1] - off[i])
            ids.append(a)
            sizes.append(b)
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def boundaries(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the places in bytes where tokens begin whatever stands before and after (last: the end), and the tokens before each.

        A text that goes to the library as a whole has its two ends only.
        """
        data, off = _text.utf8(column)
        for i, j in _text.parts(off, self.part_bytes):
            part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, owner, size = self._sizes(part, edges)[:3] if len(part) else np.zeros((3, 0), np.int64)
            cuts = np.searchsorted(owner, np.arange(j - i + 1))
            for x, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                yield np.append(starts[a:z], edges[x + 1]) - edges[x], np.concatenate([[0], np.cumsum(size[a:z])])

    def _odd(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Documents that go to the library as a whole."""
        odd = np.zeros(len(off) - 1, bool)
        found = [np.flatnonzero(_CONTROL[data])]
        special = [c.encode() for c in self.special]
        present = np.zeros(256, bool)
        present[data] = True
        wide = [c for c in map(str.encode, _WIDE_SPACE) if present[c[0]]]
        if wide or special:
            raw = data.tobytes()
            for c in wide + special:
                at = raw.find(c)
                while at >= 0:
                    found.append(np.array([at]))
                    at = raw.find(c, at + 1)
        at = np.concatenate(found)
        if len(at):
            odd[np.searchsorted(off, at, "right") - 1] = True
        return odd

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the pieces."""
        n = len(data)
        kind = _CLASS[data]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = _SPACE, kind[:-1]
        first = np.zeros(n + 1, bool)
        first[off] = True
        cut = (kind != before) & (before != _SPACE)
        # U+00D7 and U+00F7 are no letters; their whole run is left to the library.
        unsure = _UNSURE[data]
        c3 = np.flatnonzero(data[:-1] == 0xC3)
        c3 = c3[np.isin(data[c3 + 1], (0x97, 0xB7))]
        unsure[c3] = True
        space = kind == _SPACE
        if unsure.any():
            run = np.cumsum((space & (before != _SPACE)) | first[:-1] | ((before == _SPACE) & ~space))
            bad = np.zeros(int(run[-1]) + 1, bool)
            bad[run[unsure]] = True
            cut &= ~bad[run] | space
        # White space: a run before another character gives up its last one; that one joins what follows if it is a space.
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, space[1:]
        after |= first[1:]
        lead = np.empty(n, bool)
        lead[0], lead[1:] = False, space[:-1] & ~after[:-1]
        cut |= space & ~after
        joins = np.zeros(n, bool)
        joins[1:] = data[:-1] == 32
        cut[lead & ~joins] = True
        cut[lead & joins] = False
        cut |= first[:-1]
        return np.flatnonzero(cut)

    def _part(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        _, owner, size, at = self._sizes(data, off)
        done = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[at] - (done - size), size) + np.arange(int(done[-1]))]
        return ids, np.bincount(owner, size, len(off) - 1).astype(np.int64)

    def _sizes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces, their documents, their tokens and their places in the store."""
        odd = self._odd(data, off) if self.newline is not None else np.ones(len(off) - 1, bool)
        starts = self._cuts(data, off)
        owner = np.searchsorted(off, starts, "right") - 1
        if odd.any():
            keep = ~odd[owner]
            whole = off[:-1][odd & (np.diff(off) > 0)]
            starts = np.sort(np.concatenate([starts[keep], whole]))
            owner = np.searchsorted(off, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        distinct, where, back = np.unique(_text.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        at = self._places(distinct, data, starts[where], ends[where])[back]
        return starts, owner, self.n[at].astype(np.int64), at

    def _places(self, distinct: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Indices of pieces in the store, after those that weren't there were encoded."""
        if len(self.keys) + len(distinct) > self.most:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if not len(new):
            return at
        raw = data.tobytes()
        ids, n = self._encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        begin = np.cumsum(n, dtype=np.int64) - n + len(self.ids)
        self.keys, self.at, self.n = (np.insert(old, at[new], more) for old, more in ((self.keys, distinct[new]), (self.at, begin), (self.n, n)))
        self.ids = np.concatenate([self.ids, ids])
        return at + np.cumsum(~known) - ~known

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library: many at a time, a newline between two of them; those with white space inside alone."""
        inner = _INNER.search
        simple = [self.newline is not None and not inner(p, p[:1] == b" ") and p != b" " for p in pieces]
        alone = [i for i, x in enumerate(simple) if not x]
        plain = [i for i, x in enumerate(simple) if x]
        ids, n, order = [], [], []
        for k in range(0, len(plain), self.joined):
            g = plain[k : k + self.joined]
            one = np.array(self.library.encode_batch_fast([b"\n".join([pieces[i] for i in g]).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            line = one == self.newline
            cut = np.flatnonzero(line)
            if len(cut) != len(g) - 1:
                alone += g
                continue
            ids.append(one[~line])
            n.append(np.diff(cut, prepend=-1, append=len(one)) - 1)
            order += g
        for k in range(0, len(alone), 64):
            few = alone[k : k + 64]
            for e in self.library.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in few], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                n.append([len(ids[-1])])
            order += few
        size = np.concatenate(n).astype(np.int64)
        back = np.argsort(order)
        begin = (np.cumsum(size) - size)[back]
        size = size[back]
        done = np.cumsum(size)
        flat = np.concatenate(ids)
        return flat[np.repeat(begin - (done - size), size) + np.arange(int(done[-1]))], size.astype(np.int32)
