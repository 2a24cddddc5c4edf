"""Encoding whole texts with a public tokenizer, each distinct piece of text once per Python worker.

Neither tokenizer merges across the start of a run of ASCII blanks, so a text's ids are those of its pieces
(blanks, then what is no blank) one after another. Texts with other Unicode blanks, whose runs could join such a run,
are encoded whole. Distinct pieces go to the library. A worker remembers their ids under a 64-bit hash and their bytes; ids are only taken
for a piece whose bytes are those remembered.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from millrace.llm import kernels as K

_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def odd_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a row has a Unicode blank beside the ASCII ones, or what may begin a special token."""
    out = np.zeros(len(at) - 1, bool)
    where = np.flatnonzero(_LEAD[data])
    if len(where):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = padded[where], padded[where + 1], padded[where + 2]
        blank = (a < 0x20) | (a == 0x3C) & (b == 0x7C) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE2) & (b == 0x80) & ((c < 0x90) | (c > 0xA7)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB)
        out[np.searchsorted(at, where[blank], "right") - 1] = True
    return out


_CUT = "<|endoftext|>"
_MOST = 1_000_000  # pieces that a worker remembers
_open: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, blanks: bool) -> "Encoder":
    """One encoder per worker process and file. blanks: whether blanks are part of the ids."""
    if (path, blanks) not in _open:
        _open[path, blanks] = Encoder(path, blanks)
    return _open[path, blanks]


class Encoder:
    def __init__(self, path: str, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.blanks = blanks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cutter = Tokenizer.from_file(path)
        self.cut = self.cutter.token_to_id(_CUT)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.text_at, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _known(self, keys: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The slot of each piece that is remembered, else -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        pos = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = np.where(self.keys[pos] == keys, self.slot[pos], -1)
        size = np.diff(at)
        same = np.flatnonzero(out >= 0)
        other = self.text_at[out[same] + 1] - self.text_at[out[same]] != size[same]
        out[same[other]] = -1
        same = same[~other]
        if len(same):
            here, edge = K.pick(data, at[:-1][same], size[same])
            there, _ = K.pick(self.text, self.text_at[out[same]], size[same])
            out[same[np.add.reduceat(here != there, edge[:-1]) > 0]] = -1
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """New slots for the pieces that new names. Of pieces with one hash the first is found again."""
        blob = data.tobytes()
        texts = [blob[at[i] : at[i + 1]].decode() for i in new]
        # Between the pieces stands a special token, which cuts a text before anything else looks at it.
        joined = [_CUT.join(texts[i : i + 5000]) + _CUT for i in range(0, len(texts), 5000)]
        got = np.concatenate([np.array(e.ids, np.uint32) for e in self.cutter.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(got == self.cut)
        slots = len(self.at) - 1 + np.arange(len(new))
        self.at = np.concatenate([self.at, self.at[-1] + ends - np.arange(len(ends))])
        self.ids = np.concatenate([self.ids, got[got != self.cut]])
        picked, edge = K.pick(data, at[:-1][new], np.diff(at)[new])
        self.text_at, self.text = np.concatenate([self.text_at, self.text_at[-1] + edge[1:]]), np.concatenate([self.text, picked])
        fresh, first = np.unique(keys[new], return_index=True)
        to = np.searchsorted(self.keys, fresh)
        if len(self.keys):
            free = self.keys[np.minimum(to, len(self.keys) - 1)] != fresh
            fresh, first, to = fresh[free], first[free], to[free]
        self.keys, self.slot = np.insert(self.keys, to, fresh), np.insert(self.slot, to, slots[first])
        return slots

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces lie."""
        data, at = K.utf8(pieces)
        keys = K.hash_runs(data, at[:-1], np.diff(at), lower=False)
        slot = self._known(keys, data, at)
        new = np.flatnonzero(slot < 0)
        if len(self.at) + len(new) > _MOST:
            self.clear()
            new = np.arange(len(slot))
        if len(new):
            slot[new] = self._learn(keys, data, at, new)
        return slot

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each row's followed by end, and their offsets."""
        data, at = K.utf8(column)
        starts, lengths, rows = K.runs(data, at)
        if self.blanks:  # a piece starts where the one before ends, or the row starts; blanks at a row's end are one more
            ends = starts + lengths
            begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            begin = np.maximum(begin, at[rows])
            tail = at[1:].copy()
            last = np.searchsorted(rows, np.arange(len(at) - 1), "right") - 1
            has = (last >= 0) & (rows[last] == np.arange(len(at) - 1)) if len(rows) else np.zeros(len(at) - 1, bool)
            from_ = np.where(has, ends[last] if len(ends) else 0, at[:-1])
            extra = np.flatnonzero(from_ < tail)
            starts, lengths, rows = np.concatenate([begin, from_[extra]]), np.concatenate([ends - begin, (tail - from_)[extra]]), np.concatenate([rows, extra])
            order = np.argsort(starts, kind="stable")
            starts, lengths, rows = starts[order].astype(np.int64), lengths[order].astype(np.int64), rows[order]
        odd = odd_rows(data, at)
        plain = ~odd[rows]
        starts, lengths, rows = starts[plain], lengths[plain], rows[plain]
        back, pieces = K.codes(data, starts, lengths)
        slot = self._slots(pieces)[back] if len(pieces) else np.zeros(0, np.int64)
        n = (self.at[slot + 1] - self.at[slot]).astype(np.int64)
        per_row = np.bincount(rows, weights=n, minlength=len(at) - 1).astype(np.int64)
        whole = {int(r): np.array(self.tokenizer.encode(bytes(data[at[r] : at[r + 1]]).decode(), add_special_tokens=False).ids, np.uint32) for r in np.flatnonzero(odd)}
        for r, ids in whole.items():
            per_row[r] = len(ids)
        offsets = np.concatenate([[0], np.cumsum(per_row + 1)])
        out = np.full(int(offsets[-1]), end, np.uint32)
        begins = np.cumsum(n) - n
        row_first = np.zeros(len(at) - 1, np.int64)
        sums = np.bincount(rows, weights=n, minlength=len(at) - 1).astype(np.int64)
        row_first[1:] = np.cumsum(sums)[:-1]
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begins, n)
        out[np.repeat(offsets[rows] + begins - row_first[rows], n) + within] = self.ids[np.repeat(self.at[slot], n) + within]
        for r, ids in whole.items():
            out[offsets[r] : offsets[r] + len(ids)] = ids
        return out, offsets
