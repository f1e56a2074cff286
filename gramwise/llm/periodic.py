"""Runs in word sequences: Lyndon arrays of both orders by grouping suffixes, their roots extended to maximal runs.

A run is a stretch of words with smallest period q that neither neighbour extends. Every run whose length is at least
twice its period holds a Lyndon root, under the order of words or its reverse, that is the longest Lyndon word from its
first position on. So one Lyndon array per order names all candidates (position, period), and two longest common
extensions each decide them. The Lyndon array falls out of the first phase of a grouping suffix sorter: suffixes are kept
in groups of equal Lyndon prefix, and the length of a finished group's prefix is the array's value.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

LEAST_LENGTH, LEAST_POWER = 6, 4
"""Runs reported have at least this many words, and at least this many periods."""

_CHUNK_BYTES = 4 << 20


def lyndon_lengths(codes: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word from every position on; 0 marks a barrier (code 0), smaller than every word.

    Groups are ranges of one array ordered by their Lyndon prefixes, the highest first to be finished. All members of a
    finished group prolong the nearest smaller suffix to their left by the group's prefix: those hit most often rise
    most, each to a new group right above its old one. Linear time.
    """
    n = len(codes)
    values = np.asarray(codes, np.int64)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if n else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, n))
    start = np.zeros(n, np.int64)
    start[order] = np.repeat(first, counts)
    place = np.zeros(n, np.int64)
    place[order] = np.arange(n)
    # group of a suffix = first slot of its range; size and prefix length belong to that slot
    slots, group, where = order.tolist(), start.tolist(), place.tolist()
    size, length, left = [0] * n, [1] * n, [-1] * n
    for at, count in zip(first.tolist(), counts.tolist(), strict=True):
        size[at] = count
    out = [0] * n
    barriers = int((ranked == 0).sum())
    end = n - 1
    while end >= barriers:
        head = group[slots[end]]
        reach = length[head]
        if head == end:
            i = slots[end]
            out[i] = reach
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = left[j]
            left[i] = j
            if j >= 0:
                old = group[j]
                if old >= barriers:
                    last = old + size[old] - 1
                    if last != old:
                        other, k = slots[last], where[j]
                        slots[last], slots[k] = j, other
                        where[j], where[other] = last, k
                        size[old] -= 1
                        size[last] = 1
                        length[last] = length[old]
                        group[j] = last
                    length[last] += reach
        else:
            hits: dict[int, int] = {}
            for i in sorted(slots[head : end + 1]):
                out[i] = reach
                j = i - 1
                while j >= 0 and group[j] >= head:
                    j = left[j]
                left[i] = j
                if j >= 0 and group[j] >= barriers:
                    hits[j] = hits.get(j, 0) + 1
            levels: dict[int, list[int]] = {}
            for j, times in hits.items():
                levels.setdefault(times, []).append(j)
            for times in sorted(levels, reverse=True):
                raised: dict[int, list[int]] = {}
                for j in levels[times]:
                    raised.setdefault(group[j], []).append(j)
                for old, members in raised.items():
                    keep = size[old] - len(members)
                    fresh = old + keep
                    if keep:
                        for slot, j in zip(range(old + size[old] - 1, fresh - 1, -1), members, strict=True):
                            other, k = slots[slot], where[j]
                            slots[slot], slots[k] = j, other
                            where[j], where[other] = slot, k
                        for j in members:
                            group[j] = fresh
                        size[old], size[fresh] = keep, len(members)
                        length[fresh] = length[old]
                    length[fresh] += times * reach
        end = head - 1
    return out


class Extensions:
    """Longest common extensions by names of all stretches of 1, 2, 4, ... words; equal names mean equal stretches."""

    def __init__(self, codes: np.ndarray):
        self.levels = [np.asarray(codes, np.int64)]
        width = 1
        while 2 * width <= len(codes):
            names = self.levels[-1]
            pairs = names[: len(names) - width] * (names.max() + 1) + names[width:]
            distinct, names = np.unique(pairs, return_inverse=True)
            if len(distinct) == len(pairs):
                break
            self.levels.append(names)
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words equal from i and from j (> i) on."""
        total = np.zeros(len(i), np.int64)
        for k in (*range(len(self.levels) - 1, -1, -1),):
            names, width = self.levels[k], 1 << k
            while True:
                inside = j + total < len(names)
                same = np.zeros(len(i), bool)
                same[inside] = names[i[inside] + total[inside]] == names[j[inside] + total[inside]]
                total[same] += width
                # only the widest stretches can match more than once
                if k < len(self.levels) - 1 or not same.any():
                    break
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words equal up to i and up to j (> i), both included."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[k], 1 << k
            while True:
                a, b = i - total - width + 1, j - total - width + 1
                inside = (a >= 0) & (b < len(names))
                same = np.zeros(len(i), bool)
                same[inside] = names[a[inside]] == names[b[inside]]
                total[same] += width
                if k < len(self.levels) - 1 or not same.any():
                    break
        return total


def runs_between_barriers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs long enough; codes are positive, 0 is a barrier that no run crosses.

    Barriers get codes of their own first, so that no two of them are equal.
    """
    barrier = codes == 0
    top = int(codes.max(initial=0))
    found_i, found_p = [], []
    for ordered in (codes, np.where(barrier, 0, top + 1 - codes)):
        roots = np.array(lyndon_lengths(ordered), np.int64)
        i = np.flatnonzero(roots)
        # a root that can belong to a run of four periods is followed or preceded by its own first and last word
        found_i.append(i)
        found_p.append(roots[i])
    i, p = np.concatenate(found_i), np.concatenate(found_p)
    alone = codes.astype(np.int64)
    alone[barrier] = top + 1 + np.arange(int(barrier.sum()))
    near = i + p < len(codes)
    touch = np.zeros(len(i), bool)
    touch[near] = alone[i[near]] == alone[i[near] + p[near]]
    back = i > 0
    touch[back] |= alone[i[back] - 1] == alone[i[back] + p[back] - 1]
    i, p = i[touch], p[touch]
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    lce = Extensions(np.unique(alone, return_inverse=True)[1])
    after = lce.forward(i, i + p)
    before = lce.backward(i - 1, i + p - 1)
    length = before + p + after
    long = (length >= LEAST_LENGTH) & (length >= LEAST_POWER * p)
    rows = np.unique(np.stack([i[long] - before[long], p[long], length[long]], axis=1), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def dense_stretches(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Positions that can lie in a run at all, by a bound that drops nothing.

    Each word of a run comes at least four times in it. So words that come less often in their document cut it, and then
    words that come less often between two cuts, for as long as that takes out much.
    """
    at, part, word = np.arange(len(codes)), docs.astype(np.int64), codes.astype(np.int64)
    span = int(codes.max(initial=0)) + 1
    while len(at):
        _, inverse, counts = np.unique(part * span + word, return_inverse=True, return_counts=True)
        keep = counts[inverse] >= LEAST_POWER
        kept, old = at[keep], part[keep]
        if not len(kept):
            return kept
        cut = np.concatenate(([True], (np.diff(kept) != 1) | (np.diff(old) != 0)))
        piece = np.cumsum(cut) - 1
        keep = np.bincount(piece)[piece] >= LEAST_LENGTH
        before, at = len(at), kept[keep]
        part, word = piece[keep], codes[at].astype(np.int64)
        if len(at) > 0.8 * before:
            break
    return at


def find_runs(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a row of documents laid end to end; none crosses from one to the next."""
    at = dense_stretches(codes, docs)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(docs[at]) != 0))))
    packed = np.insert(np.unique(codes[at], return_inverse=True)[1] + 1, cut, 0)
    places = np.insert(at, cut, -1)
    start, length, period = runs_between_barriers(packed)
    return places[start], length, period


def repeat_tails(codes: np.ndarray, offsets: np.ndarray, keys: Sequence[int | None]) -> np.ndarray:
    """The words with those of every tenth document (by the key's hash) repeated periodically from some word on."""
    out = codes.copy()
    for k, key in enumerate(keys):
        n = int(offsets[k + 1] - offsets[k])
        if key is None or n == 0:
            continue
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = codes[offsets[k] : offsets[k + 1]]
            i = np.arange(a, n)
            out[offsets[k] + a : offsets[k + 1]] = own[a + (i - a) % p]
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, distinct words) of all texts end to end; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    blank = pc.index(coded.dictionary, pa.scalar("", texts.type)).as_py()
    if blank >= 0:
        real = codes != blank
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        codes = codes[real]
    return codes, ends.astype(np.int64), coded.dictionary


def _greatest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest length / period, compared as exact fractions; ties to the smallest start, then period."""
    best = None
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best


def _report(keys: Sequence[int | None], texts: pa.Array, planted: bool) -> dict[str, list]:
    codes, offsets, words = _words(texts)
    if planted:
        codes = repeat_tails(codes, offsets, keys)
    docs = np.repeat(np.arange(len(keys)), np.diff(offsets))
    start, length, period = find_runs(codes, docs)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.cumsum(marks[:-1]) == 0
    ends = np.concatenate(([0], np.cumsum(kept)))[offsets]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(codes[kept]))), " ")
    owner = docs[start] if len(start) else start
    bounds = np.searchsorted(owner, np.arange(len(keys) + 1))
    empty = hashlib.sha256(b"").hexdigest()
    out: dict[str, list] = {name: [] for name in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_dropped")}
    for k, text in enumerate(collapsed):
        low, high = int(bounds[k]), int(bounds[k + 1])
        out["n_runs"].append(high - low)
        out["collapsed_sha256"].append(hashlib.sha256(text.as_buffer() if text.is_valid else b"").hexdigest())
        out["n_dropped"].append(int(offsets[k + 1] - offsets[k] - ends[k + 1] + ends[k]))
        if low == high:
            for name in ("start", "length", "period", "exponent_milli"):
                out[name].append(None)
            out["runs_sha256"].append(empty)
            continue
        s, n, p = start[low:high] - offsets[k], length[low:high], period[low:high]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), p.tolist(), strict=True))
        out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
        a, b, c = _greatest(s, n, p)
        for name, value in (("start", a), ("length", b), ("period", c), ("exponent_milli", 1000 * b // c)):
            out[name].append(value)
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_dropped) of every row.

    Words are what lies between blanks (space, tab, line and page breaks). A run has at least six words and four periods;
    words of a run after its first period are dropped from the collapsed text. start to exponent_milli describe the run
    of greatest length / period. With ``planted`` the words of every tenth document repeat periodically first.

    A null or empty text has no word: no run, null start to exponent_milli, digests of the empty string. A null key is
    reported as null and never planted; repeated rows are reported as often as they come. Map only: a document is
    handled whole, in time linear in its words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(keys):
                done = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + _CHUNK_BYTES, "right")))
                part = keys.slice(at, stop - at)
                columns = _report(part.to_pylist(), texts.slice(at, stop - at), planted)
                arrays = [part, *[pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in columns.items()]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])
                at = stop

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(each, SCHEMA)
