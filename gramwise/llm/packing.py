"""Packing of token sequences: a configuration linear program over the length histogram, rounded, gaps filled by best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gramwise.llm.wordpieces import word_tokenizer
from gramwise.session import settle

_CHUNK_BYTES = 2 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut only where longer than ``capacity``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + _CHUNK_BYTES, "right")))
                yield _cut(batch.column(0).slice(at, stop - at), *encoder.batch(texts.slice(at, stop - at)), capacity, end_id)
                at = stop

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, _PIECES)


def _cut(names: pa.Array, ids: np.ndarray, starts: np.ndarray, capacity: int, end_id: int) -> pa.RecordBatch:
    """Pieces of some documents whose ids lie end to end."""
    sizes = np.diff(starts) + 1
    pieces = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    length = np.minimum(sizes[doc] - start, capacity)
    raw, end = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.array([end_id], "<u4").tobytes()
    first, last = 4 * (starts[doc] + start), 4 * np.minimum(starts[doc] + start + length, starts[doc + 1])
    closes = start + length == sizes[doc]
    crc = [zlib.crc32(end, zlib.crc32(raw[a:b])) if c else zlib.crc32(raw[a:b]) for a, b, c in zip(first.tolist(), last.tolist(), closes.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def size_classes(counts: dict[int, int], classes: int) -> list[list[int]]:
    """The sizes, longest first, in at most ``classes`` groups of about equally many pieces."""
    total, before, out, last = sum(counts.values()), 0, [], -1
    for size in sorted(counts, reverse=True):
        own = before * classes // total
        if own != last:
            out.append([])
            last = own
        out[-1].append(size)
        before += counts[size]
    return out


def _best_filling(sizes: Sequence[int], value: Sequence[float], most: Sequence[int], room: int) -> dict[int, int]:
    """Knapsack by dynamic programming: copies of each item (by number), together of largest value within ``room``.

    An item is added to all fillings at once, again and again while it fits, ``most`` times at most.
    """
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for k, (size, worth, times) in enumerate(zip(sizes, value, most, strict=True)):
        for _ in range(min(times, room // size)):
            gain = best[:-size] + worth
            better = gain > best[size:]
            if not better.any():
                break
            np.copyto(best[size:], gain, where=better)
            pick[size:][better] = k
    out: dict[int, int] = {}
    c = int(best.argmax())
    while c > 0 and pick[c] >= 0:
        k = int(pick[c])
        out[k] = out.get(k, 0) + 1
        c -= sizes[k]
    return {k: min(n, most[k]) for k, n in out.items()}


def configuration_program(sizes: Sequence[int], counts: Sequence[int], room: int, step: float = 0.1, rate: float = 4.0) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional uses of configurations ((item, copies), ...) that cover ``counts[k]`` items of size ``sizes[k]`` each.

    Multiplicative weights: an item's price starts at its size and falls exponentially with the part of its count covered
    so far. Each round takes the filling of largest price (a knapsack) as often as covers ``step`` of the scarcest item
    in it, and a round covers a ``step`` of one item at least; so all is covered after finitely many rounds, whose number
    depends on the number of items only.
    """
    used: dict[tuple[tuple[int, int], ...], float] = {}
    size, total = np.array(sizes, float), np.array(counts, float)
    covered = np.zeros(len(total))
    while len(total) and covered.min() < 1:
        # what is covered fully is worth nothing, so that each round works for an item that is not
        price = np.where(covered < 1, size * np.exp(-rate * (covered - covered.min())), 0.0)
        filling = _best_filling(sizes, price, counts, room)
        chosen = np.array(sorted(k for k in filling if covered[k] < 1))
        copies = np.array([filling[k] for k in chosen], float)
        times = (np.minimum(step, 1.0 - covered[chosen] + 1e-12) * total[chosen] / copies).min()
        covered[chosen] += times * copies / total[chosen]
        name = tuple(sorted((int(k), filling[k]) for k in chosen))
        used[name] = used.get(name, 0.0) + times
    return used


def _rounded(used: dict[tuple[tuple[int, int], ...], float], left: list[int]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole uses of the configurations: all whole parts, then one more where the fraction is largest, while items last."""
    out: dict[tuple[tuple[int, int], ...], int] = {}

    def take(name: tuple[tuple[int, int], ...], times: int) -> None:
        times = min([times, *(left[k] // n for k, n in name)])
        if times > 0:
            out[name] = out.get(name, 0) + times
            for k, n in name:
                left[k] -= n * times

    for name, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        take(name, int(times + 1e-9))
    for name, _ in sorted(used.items(), key=lambda x: (-(x[1] % 1.0), x[0])):
        take(name, 1)
    return list(out.items())


def _spelt(uses: list[tuple[tuple[tuple[int, int], ...], int]], tops: list[int], left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The configurations with lengths for classes; ``left`` is lowered.

    A place gets the longest length left within its class's top, the last one the longest that still fits, of whatever
    class. Neighbouring sequences of equal lengths stay one entry.
    """
    open_ = sorted(k for k, n in left.items() if n)
    out: list[tuple[list[int], int]] = []
    for name, times in uses:
        places = [tops[k] for k, n in sorted(name) for _ in range(n)]
        while times:
            taken: dict[int, int] = {}
            room = capacity
            for number, top in enumerate(places):
                at = bisect_right(open_, room if number == len(places) - 1 else min(top, room)) - 1
                while at >= 0 and left[open_[at]] == taken.get(open_[at], 0):
                    at -= 1
                if at >= 0:
                    taken[open_[at]] = taken.get(open_[at], 0) + 1
                    room -= open_[at]
            if not taken:
                break
            # as many more like this one as every length in it allows
            run = min([times, *(left[length] // n for length, n in taken.items())])
            for length, n in taken.items():
                left[length] -= n * run
                if not left[length]:
                    open_.remove(length)
            out.append((sorted((v for v, n in taken.items() for _ in range(n)), reverse=True), run))
            times -= run
    return out


def _fill_gaps(bins: list[tuple[list[int], int]], left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit of the remaining lengths, longest first; sequences of equal content stay one entry with a number of copies."""
    by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(lengths: list[int], copies: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append([lengths, copies])

    for lengths, copies in bins:
        put(lengths, copies)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = min(n, capacity // length)
                put([length] * per, n // per)
                n -= per * (n // per)
                continue
            gap = gaps[at]
            lengths, copies = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            take = min(n, copies)
            if take < copies:
                put(lengths, copies - take)
            put([*lengths, length], take)
            n -= take
    return [(lengths, copies) for cells in by_gap.values() for lengths, copies in cells]


def packing_plan(histogram: dict[int, int], capacity: int, small: int = 16, classes: int = 96) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that hold every piece of the histogram exactly once.

    Pieces longer than capacity / ``small`` enter the program in at most ``classes`` classes of about equally many
    pieces, each counted with its longest; its fractions are rounded, and lengths take the places of their classes. Short
    pieces, what rounding leaves over, and sequences with more than a 64th empty, then go to the gaps by best fit. Work and size depend on the capacity and the number of
    classes, not on the number of pieces.
    """
    return _planned(histogram, capacity, small, classes)[0]


def _planned(histogram: dict[int, int], capacity: int, small: int, classes: int) -> tuple[list[tuple[list[int], int]], int]:
    """The plan, and how many pieces the program's configurations placed."""
    left = {int(k): int(n) for k, n in histogram.items() if n}
    full = left.pop(capacity, 0)
    large = {k: n for k, n in left.items() if k * small > capacity}
    groups = size_classes(large, classes) if large else []
    counts = [sum(large[k] for k in group) for group in groups]
    uses = _rounded(configuration_program([group[0] for group in groups], counts, capacity), counts)
    large = dict.fromkeys(large)
    own = {k: left[k] for k in large}
    bins = _spelt(uses, [group[0] for group in groups], own, capacity)
    left |= own
    # sequences that came out too empty are taken apart again: best fit does better with their pieces
    for lengths, copies in bins:
        if sum(lengths) < capacity - capacity // 64:
            for length in lengths:
                left[length] += copies
    bins = [b for b in bins if sum(b[0]) >= capacity - capacity // 64]
    placed = sum(len(lengths) * copies for lengths, copies in bins)
    return [*([([capacity], full)] if full else []), *_fill_gaps(bins, left, capacity)], placed


def _slots(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Rows that turn a piece's rank among those of its length into a sequence and a place."""
    rows, ranks, base = [], {}, 0
    for lengths, copies in plan:
        kinds, place = {}, 0
        for v in lengths:
            kinds[v] = kinds.get(v, 0) + 1
        for v, k in kinds.items():
            first = ranks.get(v, 0)
            rows.append((v, first, first + k * copies, k, base, place))
            ranks[v], place = first + k * copies, place + k * v
        base += copies
    return pd.DataFrame(rows, columns=["length", "first", "beyond", "each", "base", "place"], dtype="int64")


def best_fit_packing(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """All rows of ``pieces`` (``document_pieces``) with sequence_id and offset: each sequence is gapless from 0.

    Only the length histogram (at most ``capacity`` rows) reaches the driver, and a table of places, whose size depends
    on the capacity alone, goes to every task. Pieces are ranked within (length, hash bucket), with more buckets for
    frequent lengths, so that a length of a third of all pieces fills no partition.
    """
    spark = pieces.sparkSession
    pieces = settle(pieces)
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).limit(0)
    slots = F.broadcast(spark.createDataFrame(_slots(packing_plan(sizes, capacity))))
    share = max(1, sum(sizes.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    buckets = F.broadcast(spark.createDataFrame([(k, -(-n // share)) for k, n in sizes.items()], "length long, buckets long"))
    dealt = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = F.broadcast(starts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("first")
    return ranked.join(slots, "length").where("rank >= first and rank < beyond").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(at, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents, packed. A null text is empty (one piece of the end id); rows that share a doc_id, or
    have none, are packed each for itself; an empty table gives no rows."""
    return best_fit_packing(document_pieces(docs, tokenizer, capacity, end_id, key, text), capacity)
