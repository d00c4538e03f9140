"""Elias-Fano sequences over memory-mapped arrays, and a trie level built of them."""

from __future__ import annotations

import os
import tempfile

import numpy as np

ONE, SIX, LAST = np.uint64(1), np.uint64(6), np.uint64(63)


#: The lowest and the highest bit of each byte, and by byte and rank the place of that set bit.
_LOWS, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_IN_BYTE = np.zeros((256, 8), np.uint64)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    _IN_BYTE[_byte, : len(_set)] = _set
_IN_BYTE = _IN_BYTE.ravel()


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th set bit of each word: its byte by the running counts of all eight at once, then by table."""
    two, four, eight = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
    rank = rank.astype(np.uint64)
    s = word - ((word >> ONE) & two)
    s = (s & four) + ((s >> np.uint64(2)) & four)
    s = ((s + (s >> np.uint64(4))) & eight) * _LOWS  # in each byte the set bits up to its end
    place = np.bitwise_count((((rank * _LOWS) | _HIGHS) - s) & _HIGHS).astype(np.uint64) << np.uint64(3)
    place = np.minimum(place, np.uint64(56))
    rank -= ((s << np.uint64(8)) >> place) & np.uint64(255)
    within = (((word >> place) & np.uint64(255)) << np.uint64(3)) | (rank & np.uint64(7))
    return (place + _IN_BYTE[within.astype(np.int64)]).astype(np.int64)


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, moved to one file that is mapped into memory and has no name any more, so nothing of it outlasts the process."""
    starts, at = [], 0
    for a in arrays:
        starts.append(at)
        at += -(-a.nbytes // 8) * 8
    fd, path = tempfile.mkstemp(prefix="lodestone-trie-")
    try:
        os.ftruncate(fd, max(8, at))
        whole = np.asarray(np.memmap(path, np.uint8, "r+", shape=(max(8, at),)))
    finally:
        os.close(fd)
        os.unlink(path)
    out = []
    for a, start in zip(arrays, starts):
        place = whole[start : start + a.nbytes].view(a.dtype)
        place[:] = a
        out.append(place)
    return out


class EliasFano:
    """A non-decreasing sequence below 2**bits: low bits in whole bytes, high bits in unary, and running counts a word of those."""

    def __init__(self, values: np.ndarray, bits: int):
        values = values.astype(np.uint64)
        self.n = len(values)
        self.l = max(0, bits - max(1, int(self.n).bit_length()))
        high = (values >> np.uint64(self.l)).astype(np.int64) if self.l < 64 else np.zeros(self.n, np.int64)
        self.buckets = 1 << (bits - self.l)
        raw = np.zeros(-(-(self.n + self.buckets + 1) // 64) * 64, np.uint8)
        raw[high + np.arange(self.n)] = 1
        words = np.packbits(raw, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32)
        width = max(1, -(-self.l // 8))
        low = np.zeros((self.n + 8, width), np.uint8)  # some more, as a number is read as eight bytes
        low[: self.n] = (values & np.uint64((1 << self.l) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        self.width = width
        self.parts = [words, ones, low.ravel()]

    def place(self, parts: list[np.ndarray]) -> None:
        self.words, self.ones, low = parts
        self.low = np.ndarray((self.n + 1,), "<u8", low, 0, (self.width,))  # the next numbers' bytes are cut off

    def lows(self, i: np.ndarray) -> np.ndarray:
        return self.low[i] & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        bit = _select_in_word(self.words[word], (i - self.ones[word]).astype(np.int64))
        high = 64 * word + bit - i
        return (high.astype(np.uint64) << np.uint64(self.l)) | self.lows(i)

    def _zeros(self, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words and bits of those zeros."""
        zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones
        word = np.searchsorted(zeros, zero, side="right") - 1
        return word, _select_in_word(~self.words[word], zero - zeros[word])

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have high bits below each, and how many at most these: places of the zeros that end the bucket before and
        this one, less the zeros. The second zero mostly lies in the first one's word."""
        zero = np.maximum(high - 1, 0)
        word, bit = self._zeros(zero)
        first = np.where(high == 0, 0, 64 * word + bit - zero)
        rest = ~self.words[word] & ((~np.uint64(0) << bit.astype(np.uint64)) << ONE)
        last = 64 * word + np.bitwise_count((rest & (~rest + ONE)) - ONE) - high
        beyond = np.flatnonzero((rest == 0) | (high == 0))
        word, bit = self._zeros(high[beyond])
        last[beyond] = 64 * word + bit - high[beyond]
        return first, last

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value of at least x among [begin, end), and whether it is x. With a guess of
        the place these are distinct and all have x's high bits."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        low = x & np.uint64((1 << self.l) - 1)
        if guess is not None:
            first, last = begin, end
        else:
            first, last = self.bucket((x >> np.uint64(self.l)).astype(np.int64))
            first, last = np.maximum(first, begin), np.minimum(last, self.n if end is None else end)
        place, hit = np.array(first), np.zeros(len(x), bool)
        open_ = np.flatnonzero(first < last)
        a, b, wanted = first[open_], last[open_], low[open_]
        middle = (a + b) >> 1 if guess is None else np.minimum(guess[open_], b - 1)
        while len(open_):  # those still sought stand side by side
            found = self.lows(middle)
            less, same = found < wanted, found == wanted
            hit[open_[same]] = True
            if guess is not None:
                a = np.where(same, middle, a)
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)  # of equal ones the first is sought
            going = a < b
            done = ~going
            place[open_[done]] = a[done]
            open_, a, b, wanted = open_[going], a[going], b[going], wanted[going]
            middle = (a + b) >> 1
        return place, hit


class Trie:
    """n-grams word by word from the root: the nodes of a level are their parent's place and a word, in that order.

    A level's words are one monotone sequence, made so by counting each from its parent's place on; a monotone sequence of pointers
    says where each node's children begin in the next level; every node has a payload (a quantised probability). All levels lie in one
    file mapped into memory. A word is sought among its parent's children alone, by the successor of what it would be there.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], word_bits: int):
        """Of each level the parents' places (0 in the first), words below 2**word_bits and payloads, distinct and sorted by parent and word."""
        self.bits, n, parts = word_bits, 1, []
        self.words, self.pointers, self.most = [], [], []
        for parent, word, _ in levels:
            self.most.append(int(word.max(initial=0)))
            self.pointers.append(EliasFano(np.searchsorted(parent, np.arange(n + 1)), max(1, len(word).bit_length())))
            self.words.append(EliasFano((parent.astype(np.uint64) << np.uint64(word_bits)) | word.astype(np.uint64), word_bits + max(1, n.bit_length())))
            n = len(word)
            parts += self.pointers[-1].parts + self.words[-1].parts
        placed = mapped(parts + [x[2] for x in levels])
        for k, s in enumerate(x for pair in zip(self.pointers, self.words) for x in pair):
            s.place(placed[3 * k : 3 * k + 3])
        self.payload = placed[6 * len(levels) :]

    def children(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in that level of the children of those parents that have these words, -1 where there is none or the parent is -1."""
        out = np.full(len(word), -1, np.int64)
        q = np.flatnonzero(parent >= 0)
        if len(q):
            new = np.append(True, np.diff(parent[q]) != 0)  # neighbours mostly share a parent
            of, run = parent[q][new], np.cumsum(new) - 1
            near = np.append(of[1:] == of[:-1] + 1, False)  # where the next one's children begin, this one's end
            begin = self.pointers[level].access(of).astype(np.int64)
            end = np.append(begin[1:], 0)
            end[~near] = self.pointers[level].access(of[~near] + 1).astype(np.int64)
            words = self.words[level]
            alike = max(self.most[level], int(word.max())) >> min(words.l, self.bits) == 0  # then siblings differ in their low bits alone
            begin, end = begin[run], end[run]
            nth = np.arange(len(q)) - np.flatnonzero(new)[run]  # mostly all children of a parent are sought, in order
            at, hit = words.successor((parent[q].astype(np.uint64) << np.uint64(self.bits)) | word[q].astype(np.uint64), begin, end, begin + nth if alike else None)
            out[q[hit]] = at[hit]
        return out
