"""Suffix-array dedup of byte strings with a content-defined difference cover.

Two suffixes are compared through a sample of positions that they are sure to reach at
the same offset. Here the sample is chosen by content: of every ``window`` bytes the
``GRAM``-byte string with the least hash is taken (the leftmost of equals), so any two
equal windows hold a sampled position at the same offset. About one byte in 35 is
sampled. The steps are those of the difference-cover algorithm, each a round in which
suffixes meet in the part that owns the range of their leading hash and are sorted there:

1. Sort the sampled positions by their gram. Those that stand alone end here; the rest
   are few, and the work below is in proportion to them.
2. Sort the sampled triples (bytes of the windows before the gram, the gram, bytes of the
   windows after it). Equal neighbours are named alike: all windows of the later ones
   are repeats of those of the first.
3. Take what the names leave open: grams under which several names stand. Only the first
   of each name takes part. There is no recursion on the names and no suffix has a rank:
   windows have a fixed length, so one more round over them settles all that is open.
4. Merge the remaining suffixes, which start at any byte before such a gram, by their
   window and compare adjacent prefixes: of equal ones all but the first by (id, start)
   are repeats. Where a gram has more than ``HOT_NAMES`` names (a common phrase in ever
   new surroundings), its windows do not meet in the part of the gram: each goes to the
   part of its own hash, from a group once however often it has it.

Suffixes are ordered by hashes of their stretches rather than by their bytes; any total
order serves in which equal prefixes are neighbours. Grams are first compared by 32 bits
beyond the choice of the part, where an error costs only a further look, then by 128 bits
with their name, and windows under one gram by 64.

NULL and empty texts have no bytes; texts shorter than the window keep all. Equal rows
(same id) never remove from each other; a NULL id counts as the smallest.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from whence.llm.kernels import BYTE_VALUES, Prefix, buffers, covered, distinct, mix, ranges, sliding_minimum, window_starts
from whence.llm.rounds import Group, Rounds, packed, repeated, split

WINDOW = 100
GRAM = 32
#: Names up to which the windows under a gram meet in one part.
HOT_NAMES = 1024
#: Bytes hashed, and windows compared, at a time.
SLICE = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def before(ids: np.ndarray, starts: np.ndarray, other_ids: np.ndarray, other_starts: np.ndarray) -> np.ndarray:
    """Is the first (id, start) the smaller one?"""
    return (ids < other_ids) | ((ids == other_ids) & (starts < other_starts))


def heads(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    opens = np.ones(len(keys[0]), bool)
    opens[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return opens


class Suffixes:
    """Sampled positions of a group and what the rounds have told about them."""

    def __init__(self, group: Group, window: int, gram: int, parts: int, id_type: str):
        self.group, self.window, self.gram, self.parts, self.id_type = group, window, gram, parts, id_type
        self.data, self.offsets = buffers(group.own())
        self.prefix = Prefix(BYTE_VALUES[self.data])
        grams = self.prefix.sliding(gram)
        at = np.arange(len(grams), dtype=np.uint64)
        least = sliding_minimum((grams & ~_LOW) | at, window - gram + 1)
        starts = np.flatnonzero(window_starts(self.offsets, window))
        anchor = (least[starts] & _LOW).astype(np.int64)
        opens = np.flatnonzero(heads(anchor)) if len(anchor) else np.zeros(0, np.int64)
        #: Sampled positions, the windows (first and last start) each stands for, and its gram.
        self.at, self.low = anchor[opens], starts[opens]
        self.high = starts[np.r_[opens[1:], len(starts)] - 1] if len(opens) else starts
        self.grams = grams[self.at]
        doc = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.ids, self.place = group.ids[doc], self.at - self.offsets[doc]

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("at", "low", "high", "grams", "ids", "place"):
            setattr(self, name, getattr(self, name)[chosen])

    # Round 1: grams that occur once end.

    def ask_grams(self) -> list[tuple[int, bytes]]:
        grams = distinct(self.grams)
        return [(p, grams[a:b].astype("<u4").tobytes()) for p, a, b in split(grams, self.parts)]

    def after_grams(self) -> None:
        grams, back, count = np.unique(self.grams, return_inverse=True, return_counts=True)
        known = self.group.bits(1, [b - a for _, a, b in split(grams, self.parts)])
        self.keep((known | (count > 1))[back])

    # Round 2: sorted triples and their names.

    def triples(self) -> None:
        """Puts the positions in order of (gram, name, id, start) and marks the first of each name."""
        left = self.prefix.raw(self.low, self.at)
        right = self.prefix.raw(self.at + self.gram, self.high + self.window)
        self.names = mix(mix(left) * np.uint64(0xD6E8FEB86659FD93) + right)
        order = np.lexsort((self.names, self.grams))
        self.keep(order)
        self.names = self.names[order]
        first = heads(self.grams, self.names)
        group = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)
        #: Windows of a later place under one name are repeats; equal rows are not later.
        self.first = first
        self.repeat = before(self.ids[group], self.place[group], self.ids, self.place)
        self.of = np.cumsum(first) - 1

    def sizes(self) -> list[tuple[int, int, int]]:
        return split(self.grams[self.first], self.parts)

    def ask_triples(self) -> list[tuple[int, bytes]]:
        self.after_grams()
        self.triples()
        columns = [x[self.first] for x in (self.grams, self.names, self.ids.astype(self.id_type), self.place.astype("<u4"))]
        return [(p, b"".join(c[a:b].tobytes() for c in columns)) for p, a, b in self.sizes()]

    def after_triples(self) -> None:
        self.after_grams()
        self.triples()
        bits = self.group.bits(2, [3 * (b - a) for _, a, b in self.sizes()]).reshape(-1, 3)
        self.repeat |= bits[self.of, 0]
        #: The first of a name whose gram has other names too: few (open) or many (hot).
        self.open = ~self.repeat & bits[self.of, 1] & ~bits[self.of, 2]
        self.hot = ~self.repeat & bits[self.of, 2]

    # Round 3: windows under the grams that are still open.

    def hot_windows(self) -> None:
        """Puts the windows under hot grams in order of (hash, id, start) and marks the first of each hash."""
        low, count = self.low[self.hot], self.high[self.hot] - self.low[self.hot] + 1
        starts = ranges(low, count)
        hashes = self.prefix.hashes(starts, starts + self.window)
        ids = np.repeat(self.ids[self.hot], count)
        place = starts + np.repeat(self.place[self.hot] - self.at[self.hot], count)
        order = np.lexsort((place, ids, hashes))
        self.hot_starts, self.hot_hashes, self.hot_ids, self.hot_place = starts[order], hashes[order], ids[order], place[order]
        self.hot_first = heads(self.hot_hashes)

    def shares(self) -> list[tuple[int, slice, slice]]:
        """Per part that is asked, its stretches of the open positions and of the distinct hot windows."""
        cold = {p: slice(a, b) for p, a, b in split(self.grams[self.open], self.parts)}
        hot = {p: slice(a, b) for p, a, b in split(self.hot_hashes[self.hot_first], self.parts)}
        none = slice(0, 0)
        return [(p, cold.get(p, none), hot.get(p, none)) for p in sorted(cold.keys() | hot.keys())]

    def ask_windows(self) -> list[tuple[int, bytes]]:
        self.after_triples()
        self.hot_windows()
        low, high = self.low[self.open], self.high[self.open]
        ids, place = self.ids[self.open].astype(self.id_type), (self.place[self.open] - self.at[self.open] + low).astype("<u4")
        counts = (high - low + 1).astype("<u2")
        first = self.hot_first
        columns = self.hot_hashes[first], self.hot_ids[first].astype(self.id_type), self.hot_place[first].astype("<u4")
        out = []
        for p, c, h in self.shares():
            text = self.data[ranges(low[c], high[c] - low[c] + self.window)]
            sizes = np.array([c.stop - c.start, h.stop - h.start], "<u4")
            sent = (sizes, *[x[h] for x in columns], ids[c], place[c], counts[c], text)
            out.append((p, b"".join(x.tobytes() for x in sent)))
        return out

    def repeated_windows(self) -> np.ndarray:
        """Starts of all windows that also start earlier."""
        self.after_triples()
        self.hot_windows()
        whole = ranges(self.low[self.repeat], self.high[self.repeat] - self.low[self.repeat] + 1)
        low, count = self.low[self.open], self.high[self.open] - self.low[self.open] + 1
        sizes = np.array([(count[c].sum(), h.stop - h.start) for _, c, h in self.shares()], np.int64).reshape(-1, 2)
        bits = self.group.bits(3, sizes.sum(axis=1).tolist())
        is_hot = np.repeat(np.tile([False, True], len(sizes)), sizes.reshape(-1))
        some = ranges(low, count)[bits[~is_hot]]
        at = np.flatnonzero(self.hot_first)
        of = np.cumsum(self.hot_first) - 1
        head = at[of]
        later = before(self.hot_ids[head], self.hot_place[head], self.hot_ids, self.hot_place)
        return np.concatenate([whole, some, self.hot_starts[bits[is_hot][of] | later]])


def answer_triples(sent: list[bytes], id_type: str, hot_names: int) -> list[bytes]:
    """Three bits a triple: is there an equal one before it; has its gram other names; more than ``hot_names``?"""
    wide = np.dtype(id_type).itemsize
    sizes = [len(b) // (20 + wide) for b in sent]
    grams = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(sent, sizes)])
    names = np.concatenate([np.frombuffer(b, "<u8", n, 8 * n) for b, n in zip(sent, sizes)])
    ids = np.concatenate([np.frombuffer(b, id_type, n, 16 * n) for b, n in zip(sent, sizes)])
    place = np.concatenate([np.frombuffer(b, "<u4", n, (16 + wide) * n) for b, n in zip(sent, sizes)])
    order = np.lexsort((place, ids, names, grams))
    grams, names, ids, place = grams[order], names[order], ids[order], place[order]
    first = heads(grams, names)
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    under = np.cumsum(heads(grams)) - 1
    names_of = np.bincount(under, first)[under]
    bits = np.empty((len(order), 3), bool)
    bits[order, 0] = before(ids[head], place[head], ids, place)
    bits[order, 1] = names_of > 1
    bits[order, 2] = names_of > max(hot_names, 1)
    return packed(bits.reshape(-1), [3 * n for n in sizes])


def earlier(hashes: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Does an equal hash start earlier?"""
    order = np.lexsort((place, ids, hashes))
    hashes, ids, place = hashes[order], ids[order], place[order]
    first = heads(hashes)
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    bits = np.empty(len(order), bool)
    bits[order] = before(ids[head], place[head], ids, place)
    return bits


def open_windows(ids: np.ndarray, place: np.ndarray, counts: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """``earlier`` for all windows of the stretches laid end to end in ``text``.

    Texts are hashed in slices and windows compared by ranges of their hash, so that beyond
    a hash and a bit a window the memory needed does not grow with their number.
    """
    lengths = counts + window - 1
    ends, text_ends = np.cumsum(counts), np.cumsum(lengths)
    n = int(counts.sum())
    hashes = np.empty(n, np.uint64)
    cuts = np.unique(np.r_[0, np.searchsorted(text_ends, np.arange(SLICE, len(text), SLICE)), len(counts)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        starts = ranges(text_ends[a:b] - lengths[a:b] - (text_ends[a] - lengths[a]), counts[a:b])
        part = Prefix(BYTE_VALUES[text[text_ends[a] - lengths[a] : text_ends[b - 1]]])
        hashes[ends[a] - counts[a] : ends[b - 1]] = part.hashes(starts, starts + window)
    slices = max(1, -(-n // SLICE))
    edges = [(k << 64) // slices for k in range(slices + 1)]
    bits = np.empty(n, bool)
    for low, high in zip(edges[:-1], edges[1:]):
        chosen = np.flatnonzero((hashes >= np.uint64(low)) & (hashes <= np.uint64(high - 1)))
        at = np.searchsorted(ends, chosen, side="right")
        bits[chosen] = earlier(hashes[chosen], ids[at], place[at] + (chosen - (ends[at] - counts[at])))
    return bits


def answer_windows(sent: list[bytes], id_type: str, window: int) -> list[bytes]:
    """A bit a window, first those under open grams, then the hot ones: does an equal one start earlier?"""
    wide = np.dtype(id_type).itemsize
    ids, place, counts, text, hot, sizes = [], [], [], [], [], []
    for b in sent:
        n, m = np.frombuffer(b, "<u4", 2).tolist()
        at = 8 + (12 + wide) * m
        hot.append((np.frombuffer(b, "<u8", m, 8), np.frombuffer(b, id_type, m, 8 + 8 * m), np.frombuffer(b, "<u4", m, 8 + (8 + wide) * m)))
        ids.append(np.frombuffer(b, id_type, n, at))
        place.append(np.frombuffer(b, "<u4", n, at + wide * n))
        counts.append(np.frombuffer(b, "<u2", n, at + (wide + 4) * n).astype(np.int64))
        text.append(np.frombuffer(b, np.uint8)[at + (wide + 6) * n :])
        sizes.append((int(counts[-1].sum()), m))
    ids, place, counts, text = (np.concatenate(x) for x in (ids, place, counts, text))
    cold_bits = open_windows(ids, place, counts, text, window)
    hot_bits = earlier(*(np.concatenate(x) for x in zip(*hot)))
    is_hot = np.repeat(np.tile([False, True], len(sizes)), np.array(sizes).reshape(-1))
    bits = np.empty(len(is_hot), bool)
    bits[~is_hot], bits[is_hot] = cold_bits, hot_bits
    return packed(bits, [n + m for n, m in sizes])


def kept_bytes(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    texts: bool = True,
    carry: tuple[str, ...] = (),
    hot_names: int = HOT_NAMES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also spans and kept.

    ``spans`` holds the start and end of what goes, in bytes; ``kept`` is the text left,
    without the halves of characters that a span cuts. ``carry`` names further columns of
    ``docs`` to keep. ``hot_names`` decides where windows meet, never the result. Rows with the same id and text have the same result.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and the window")
    rounds = Rounds(docs, carry)
    parts, id_type = rounds.parts, rounds.id_type

    def suffixes(group: Group) -> Suffixes:
        return Suffixes(group, window, gram, parts, id_type)

    rounds.round(lambda group: suffixes(group).ask_grams(), lambda sent: repeated(sent, "<u4"))
    rounds.round(lambda group: suffixes(group).ask_triples(), lambda sent: answer_triples(sent, id_type, hot_names))
    rounds.round(lambda group: suffixes(group).ask_windows(), lambda sent: answer_windows(sent, id_type, window))

    def work(group: Group) -> dict:
        found = suffixes(group)
        gone = covered(found.repeated_windows(), window, len(found.data))
        data, offsets = buffers(group.texts)
        sizes, own = np.diff(offsets), np.diff(found.offsets)
        kept, spans = [], []
        for i, size in enumerate(sizes.tolist()):
            text = data[offsets[i] : offsets[i + 1]]
            if group.copy[i]:
                mask = np.full(size, size >= window)
            else:
                mask = gone[found.offsets[i] : found.offsets[i] + own[i]]
            edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).reshape(-1, 2)
            spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
            kept.append(text[~mask].tobytes())
        found = {
            "doc_id": group.doc_ids,
            "n_bytes": sizes,
            "n_removed": [n - len(k) for n, k in zip(sizes.tolist(), kept)],
            "n_spans": [len(s) for s in spans],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }
        if texts:
            found |= {"spans": spans, "kept": [k.decode("utf-8", "ignore") for k in kept]}
        return found | group.carried

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", spans array<struct<start: bigint, end: bigint>>, kept string" if texts else ""
    return rounds.each(work, schema + "".join(f", `{c}` {kind}" for c, kind in rounds.carry.items()))
