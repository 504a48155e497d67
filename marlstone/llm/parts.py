"""Token ids of texts by their distinct parts, in flat arrays of a bounded size.

The byte-level split of GPT-like vocabularies always breaks at certain places, whatever stands around them: where white
space begins, before the last character of a run of white space that a word follows (a blank goes with that word, any
other stands alone), and before a mark ``. , ; : ! ?`` that follows an ASCII letter or digit. Texts are cut there, each
distinct part is encoded once, and a table keyed by 64-bit hashes gives the ids of the others. A part of more than LONG
bytes is never looked up by hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from marlstone.llm.common import hash_runs, text_array

LONG = 64
WINDOW = 1 << 20
_WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_MARK = np.array([chr(b) in ".,;:!?" for b in range(256)])
#: First bytes of white space beyond ASCII, and control characters that not all libraries take for white space.
_ODD = np.array([b in (0xC2, 0xE1, 0xE2, 0xE3) or 28 <= b <= 31 for b in range(256)])
_ODD_SPACE = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def plain_split(spec: dict) -> bool:
    """Whether the vocabulary file splits texts as this module cuts them."""
    split = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


class Parts:
    """``learn`` gives the ids of distinct parts, ``whole`` those of a text that cannot be cut.

    The table holds at most 2**bits / 2 parts and their ids (about 25 bytes a slot); it starts anew when it is full,
    which costs time only.
    """

    def __init__(self, learn: Callable[[list[str]], list[np.ndarray]], whole: Callable[[str], np.ndarray], special: list[str], bits: int = 22):
        self.learn, self.whole, self.bits = learn, whole, bits
        self.odd = re.compile("|".join([_ODD_SPACE, *map(re.escape, special)]))
        self.watch = _ODD.copy()
        self.watch[[s.encode()[0] for s in special]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.size = np.zeros(1 << self.bits, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 where unknown."""
        mask = np.uint64((1 << self.bits) - 1)
        slots = (hashes & mask).astype(np.int64)
        there = self.keys[slots]
        out = np.where(there == hashes, slots, -1)
        left = np.flatnonzero((there != hashes) & (there != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & int(mask)
            there = self.keys[slots[left]]
            hit = there == hashes[left]
            out[left[hit]] = slots[left[hit]]
            left = left[~hit & (there != 0)]
        return out

    def _insert(self, hashes: np.ndarray, made: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.concatenate(made) if made else np.zeros(0, np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        begins = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += len(made)
        slots, left = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = self.keys[slots[left]] == 0
            self.keys[slots[left[free]]] = hashes[left[free]]
            won = self.keys[slots[left]] == hashes[left]  # of two that want one slot the last has it
            mine = left[won]
            self.at[slots[mine]], self.size[slots[mine]] = begins[mine], sizes[mine]
            left = left[~won]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of a string array; nulls count as empty."""
        texts = text_array(texts, lower=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
        return self.encode(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids of each). ``data``: UTF-8; text k is bounds[k]:bounds[k + 1]."""
        n = len(bounds) - 1
        odd = self._odd_texts(data, bounds)
        if not len(odd):
            return self._plain(data, bounds)
        found, counts, first = [], np.zeros(n, np.int64), 0
        for k in [*odd.tolist(), n]:
            if k > first:
                ids, counts[first:k] = self._plain(data[bounds[first] : bounds[k]], bounds[first : k + 1] - bounds[first])
                found.append(ids)
            if k < n:
                found.append(self.whole(data[bounds[k] : bounds[k + 1]].tobytes().decode()))
                counts[k] = len(found[-1])
            first = k + 1
        return np.concatenate(found), counts

    def _odd_texts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        spots = np.flatnonzero(self.watch[data])
        texts = np.unique(np.searchsorted(bounds, spots, "right") - 1)
        return np.array([k for k in texts.tolist() if self.odd.search(data[bounds[k] : bounds[k + 1]].tobytes().decode())], np.int64)

    @staticmethod
    def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places at which parts begin, and the end."""
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        white = _WHITE[data]
        before, follows = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], follows[:-1] = white[:-1], white[1:]
        before &= ~edge[:size]
        last = white & ~follows & ~edge[1:]  # the end of a run of white space that a word follows
        after = np.zeros(size, bool)
        after[1:] = (last & (data != 32))[:-1]
        mark = _MARK[data]
        mark[1:] &= _ALNUM[data[:-1]]
        edge[:size] |= (white & ~before) | last | after | mark
        return np.flatnonzero(edge)

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Works off windows of about WINDOW bytes, which end where a part does."""
        out, counts, begin = [], np.zeros(len(bounds) - 1, np.int64), 0
        while begin < len(data):
            reach = WINDOW
            while True:  # a part that is longer than the window widens it
                end = min(len(data), begin + reach)
                inner = bounds[np.searchsorted(bounds, begin, "right") : np.searchsorted(bounds, end, "right")] - begin
                cuts = self._cuts(data[begin:end], np.concatenate(([0], inner)))
                if end == len(data):
                    cuts = np.union1d(cuts, end - begin)
                    break
                cuts = cuts[cuts < end - begin - 1]  # whether the last byte begins a part depends on what follows
                if len(cuts) > 1:
                    break
                reach *= 4
            ids, sizes = self._window(data[begin:end], cuts)
            owner = np.searchsorted(bounds, cuts[:-1] + begin, "right") - 1
            counts += np.bincount(owner, sizes, len(counts)).astype(np.int64)
            out.append(ids)
            begin += int(cuts[-1])
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts

    def _window(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = cuts[:-1], cuts[1:]
        hashes = hash_runs(data, starts, ends)
        hashes[hashes == 0] = 1  # 0 marks a free slot
        long = np.flatnonzero(ends - starts > LONG)
        short = np.flatnonzero(ends - starts <= LONG)
        slots = np.full(len(starts), -1, np.int64)
        slots[short] = self._find(hashes[short])
        missing = short[slots[short] < 0]
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            if self.count + len(new) > 1 << (self.bits - 1):
                self.clear()
                return self._window(data, cuts) if len(missing) < len(short) or len(new) <= 1 << (self.bits - 1) else self._halves(data, cuts)
            first = missing[where]
            raw = data.tobytes()
            self._insert(new, self.learn([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            slots[missing] = self._find(hashes[missing])
        at, sizes = self.at[slots], self.size[slots].astype(np.int64)
        pool = self.pool
        if len(long):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            known = dict.fromkeys(texts)
            made = dict(zip(known, self.learn([t.decode() for t in known]), strict=True))
            rows = [made[t] for t in texts]
            sizes[long] = [len(r) for r in rows]
            at = at.astype(np.int64)
            at[long] = self.used + np.cumsum(sizes[long]) - sizes[long]
            pool = np.concatenate((self.pool[: self.used], *rows))
        total = int(sizes.sum())
        spread = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return pool[spread], sizes

    def _halves(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A window with more distinct parts than the table holds, in two."""
        middle = len(cuts) // 2
        a = self._window(data[: cuts[middle]], cuts[: middle + 1])
        b = self._window(data[cuts[middle] :], cuts[middle:] - cuts[middle])
        return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
