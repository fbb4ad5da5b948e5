"""Substring dedup by level-wise doubling of word windows.

Windows of ``levels[0]`` words that occur twice anywhere are extended to windows of twice
that length (the last level ends at the wanted length); a window of the next level is
sent out only if its first and its last window of the level before are both repeated,
so each level carries the survivors alone. At the last level the holder of a window
knows the smallest id that has it, and a word goes if a window over it also starts in a
document with a smaller id.

On the lower levels a word is a sum over its bytes and 32 bits beyond those that choose the
part stand for a window: equal windows always survive, and a false survivor only costs a
further look. At the last level every word of a window stands for 128 bits of a hash of the
whole word, the window for sums over two halves of these, 64 bits of the one and 32 of the other.

NULL and empty texts have no words. Texts of fewer words than the window keep them all.
Equal rows (same id) never remove from each other; a NULL id counts as the smallest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from whence.llm.kernels import Prefix, Words, buffers, covered, distinct, window_starts
from whence.llm.rounds import Group, Rounds, repeated, split

WINDOW = 13
FIRST = 4


def levels(first: int, window: int) -> list[int]:
    """Lengths of the levels: doubled from ``first`` until ``window`` is reached."""
    found = [min(first, window)]
    while found[-1] < window:
        found.append(min(2 * found[-1], window))
    return found


@dataclass
class Doubling:
    """Candidates of a group, level by level, from its texts and the answers."""

    lengths: list[int]
    parts: int
    id_type: str

    def read(self, group: Group) -> None:
        self.data, self.offsets = buffers(group.own())
        self.words = Words(self.data, self.offsets)
        self.prefix = Prefix(self.words.values(self.data))

    def candidates(self, group: Group, level: int) -> np.ndarray:
        """Starts (word numbers) of the windows of a level that may be repeated."""
        fit = window_starts(self.words.firsts, self.lengths[level])
        if level:
            known = np.zeros(len(fit), bool)
            at, hashes = self.hashed(group, level - 1)
            unique, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            bits = group.bits(level, [b - a for _, a, b in split(unique, self.parts)])
            known[at] = (bits | (count > 1))[back]
            step = self.lengths[level] - self.lengths[level - 1]
            # Where a group has fewer words than a step, no window of this level fits.
            n = max(len(fit) - step, 0)
            fit[:n] &= known[:n] & known[step:]
        return np.flatnonzero(fit)

    def hashed(self, group: Group, level: int) -> tuple[np.ndarray, np.ndarray]:
        if (level,) not in self.cache:
            at = self.candidates(group, level)
            if level == len(self.lengths) - 1:
                # What is left is told apart by hashes of whole words.
                own = np.flatnonzero(covered(at, self.lengths[level], len(self.words.starts)))
                values = np.zeros((len(self.words.starts), 2), np.uint64)
                values[own] = self.words.digests(self.data, which=own)
                self.prefix, self.second = Prefix(values[:, 0]), Prefix(values[:, 1])
            self.cache[(level,)] = at, self.prefix.hashes(at, at + self.lengths[level])
        return self.cache[(level,)]

    def ask(self, group: Group, level: int) -> list[tuple[int, bytes]]:
        self.read(group)
        self.cache: dict = {}
        at, hashes = self.hashed(group, level)
        if level < len(self.lengths) - 1:
            unique = distinct(hashes)
            return [(p, unique[a:b].astype("<u4").tobytes()) for p, a, b in split(unique, self.parts)]
        # Texts stand in the order of their ids, so the first start is that of the smallest id.
        unique, more, first, _ = self.windows(at, hashes)
        ids = group.ids[np.searchsorted(self.words.firsts, at[first], side="right") - 1].astype(self.id_type)
        return [(p, unique[a:b].tobytes() + more[a:b].tobytes() + ids[a:b].tobytes()) for p, a, b in split(unique, self.parts)]

    def windows(self, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the last level: both sums of each different window (ascending), the first place of it, and the window of each place."""
        more = self.second.hashes(at, at + self.lengths[-1]).astype("<u4")
        order = np.lexsort((np.arange(len(at)), more, hashes))
        opens = np.ones(len(order), bool)
        opens[1:] = (np.diff(hashes[order]) != 0) | (np.diff(more[order]) != 0)
        first = order[opens]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(opens) - 1
        return hashes[first], more[first], first, of

    def answer(self, sent: list[bytes]) -> list[bytes]:
        """A bit per window: does a group hold it under a smaller id than this one does?"""
        width = np.dtype(self.id_type).itemsize
        sizes = [len(b) // (12 + width) for b in sent]
        key = np.empty(sum(sizes), [("hash", "<u8"), ("more", "<u4")])
        ids, at = np.empty(len(key), np.uint64), 0
        for b, n in zip(sent, sizes):
            key["hash"][at : at + n] = np.frombuffer(b, "<u8", n)
            key["more"][at : at + n] = np.frombuffer(b, "<u4", n, 8 * n)
            ids[at : at + n] = np.frombuffer(b, self.id_type, n, 12 * n)
            at += n
        order = np.lexsort((ids, key["more"], key["hash"]))
        key, ids = key[order], ids[order]
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        least = ids[np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))]
        later = np.empty(len(key), bool)
        later[order] = ids > least
        out, at = [], 0
        for n in sizes:
            out.append(np.packbits(later[at : at + n]).tobytes())
            at += n
        return out

    def removed(self, group: Group) -> np.ndarray:
        """True at each word to remove; copies of at least a window go whole."""
        self.read(group)
        self.cache = {}
        last = len(self.lengths) - 1
        at, hashes = self.hashed(group, last)
        unique, _, first, back = self.windows(at, hashes)
        known = group.bits(last + 1, [b - a for _, a, b in split(unique, self.parts)])
        ids = group.ids[np.searchsorted(self.words.firsts, at, side="right") - 1]
        gone = at[known[back] | (ids > ids[first][back])]
        return covered(gone, self.lengths[last], len(self.words.starts))


def kept_words(docs: DataFrame, window: int = WINDOW, first: int = FIRST, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``texts`` also kept, the words left joined by spaces.

    Rows with the same id and text have the same result. The order of rows is free.
    """
    rounds = Rounds(docs)
    lengths, parts, id_type = levels(first, window), rounds.parts, rounds.id_type

    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        rounds.round(
            lambda group, level=level: Doubling(lengths, parts, id_type).ask(group, level),
            Doubling(lengths, parts, id_type).answer if last else lambda sent: repeated(sent, "<u4"),
        )

    def work(group: Group) -> dict:
        gone = Doubling(lengths, parts, id_type).removed(group)
        data, offsets = buffers(group.texts)
        words = Words(data, offsets)
        own = np.zeros(len(words.starts), bool)
        copies = np.repeat(group.copy, words.counts)
        own[~copies] = gone
        own[copies] = np.repeat(words.counts[group.copy] >= window, words.counts[group.copy])
        raw, kept = data.tobytes(), []
        starts, ends = words.starts.tolist(), words.ends.tolist()
        removed = np.diff(np.r_[0, np.cumsum(own)][words.firsts])
        keep = ~own
        for i in range(len(words.counts)):
            a, b = words.firsts[i], words.firsts[i + 1]
            kept.append(b" ".join([raw[starts[j] : ends[j]] for j in (a + np.flatnonzero(keep[a:b])).tolist()]))
        found = {
            "doc_id": group.doc_ids,
            "n_words": words.counts,
            "n_removed": removed,
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }
        return found | ({"kept": [k.decode() for k in kept]} if texts else {})

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return rounds.each(work, schema + (", kept string" if texts else ""))
