"""Language-model scores by logistic mixing of hashed-context bit predictors, learnt from the corpus itself."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.session import stored

END = b""
"""The token after a text's last word; no word is empty."""
_INPUTS, _GATES, _DEPTHS, _STEPS = 4, 32, 32, 33
_BIAS = 0.3
_LIMIT = 12.0
_CHUNK = 1 << 13
_PIECE = 1 << 22
_SPELT = 1 << 16
_ROW = 1 << 14
_LEVELS, _CELLS, _ROWS = 32, 17, 24
"""Levels of the first prediction; 2^_CELLS cells (a level and two states) in each row: 16 depths of a code, 8 bits of a byte."""


@dataclass
class Words:
    """The tokens of some texts: for each the number of its text and its number among the distinct ones."""

    owner: np.ndarray
    number: np.ndarray
    distinct: list[bytes]
    texts: int

    @staticmethod
    def of(texts: pa.Array) -> Words:
        """A-Z lowered, cut at ASCII white space, and each text's end; null texts are empty."""
        whole = texts.take(pa.array(np.arange(len(texts))))  # Arrow lowers the wrong bytes of an array cast from a slice
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        number, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        if END in distinct:  # found beside white space at either side of a text
            end = distinct.index(END)
            real = number != end
            number, owner = number[real], owner[real]
        else:
            end = len(distinct)
            distinct.append(END)
        n = np.bincount(owner, minlength=len(texts)) + 1
        out = np.full(len(owner) + len(texts), end, np.int32)
        out[np.arange(len(owner)) + owner] = number
        return Words(np.repeat(np.arange(len(texts)), n), out, distinct, len(texts))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into rows of about _PIECE bytes in column ``text``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size + 1) // _PIECE, prepend=0)).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(size)], strict=True):
            if low < high:
                yield batch.slice(low, high - low)


@dataclass
class Code:
    """Prefix-free bit strings of the frequent tokens and of an escape (the last one), as walks down a binary tree.

    ``levels[d]`` holds for each symbol its step at depth d (node and bit packed); ``lengths`` says how many steps count.
    """

    numbers: dict[bytes, int]
    weights: np.ndarray
    counts: np.ndarray
    depths: np.ndarray
    lengths: np.ndarray
    levels: np.ndarray
    hashes: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    @staticmethod
    def of(frequent: list[tuple[bytes, int]], rest: int) -> Code:
        """Huffman's code for the counts; the escape stands for the ``rest`` other tokens."""
        weights = [n for _, n in frequent] + [max(1, rest)]
        leaves = len(weights)
        heap = [(n, k) for k, n in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, sums = np.full(2 * leaves - 1, -1), np.zeros(2 * leaves - 1, np.uint8), [*weights]
        for top in range(leaves, 2 * leaves - 1):
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[a, b]], side[b] = top, 1
            sums.append(n + m)
            heapq.heappush(heap, (n + m, top))
        at, walk = np.arange(leaves), []
        while (parent[at] >= 0).any():  # one level up a round; -1 above the root
            walk.append(np.where(parent[at] >= 0, (parent[at] - leaves) << 1 | side[at], -1))
            at = np.where(parent[at] >= 0, parent[at], at)
        lengths = np.array([step >= 0 for step in walk], np.uint8).reshape(-1, leaves).sum(axis=0, dtype=np.uint8)
        levels, depths = np.zeros((len(walk), leaves), np.int32), np.zeros(max(1, leaves - 1), np.int64)
        for up, step in enumerate(walk):
            real = np.flatnonzero(step >= 0)
            depth = lengths[real].astype(np.int64) - 1 - up
            levels[depth, real], depths[step[real] >> 1] = step[real], depth
        counts = np.zeros((max(1, leaves - 1), 2), np.int64)
        inner = np.flatnonzero(parent >= 0)
        np.add.at(counts, (parent[inner] - leaves, side[inner]), np.array(sums)[inner])
        return Code({w: k for k, (w, _) in enumerate(frequent)}, np.array(weights[:-1], np.int64), counts, depths, lengths, levels)

    @property
    def escape(self) -> int:
        return len(self.lengths) - 1

    def hashed(self, size: int) -> np.ndarray:
        """Hash of ``size`` bits of each step's node, the step's bit below it."""
        if size not in self.hashes:
            step = np.arange(2 * len(self.counts), dtype=np.uint32)
            self.hashes[size] = _place(_hash(step >> np.uint32(1), np.uint32(5)), size) | (step & 1).astype(np.int32)
        return self.hashes[size]

    def symbols(self, words: Words) -> np.ndarray:
        """The symbol of each distinct word."""
        return np.fromiter(map(self.numbers.get, words.distinct, repeat(self.escape)), np.int32, len(words.distinct))

    def stretches(self, words: Words) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, symbol, last symbol, last but one) of _CHUNK tokens at a time; the start of a text looks like an end."""
        symbols = self.symbols(words).take(words.number)
        start = np.int32(self.numbers.get(END, self.escape))
        before = np.concatenate(([start], symbols[:-1]))  # each text ends with an end
        before2 = np.concatenate(([start], before[:-1]))
        before2[np.flatnonzero(np.diff(words.owner, prepend=-1))] = start
        for at in range(0, len(symbols), _CHUNK):
            part = slice(at, at + _CHUNK)
            yield part, symbols[part], before[part], before2[part]


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit hash of two 32-bit arrays."""
    mixed = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA77)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D)


def _place(hashed: np.ndarray, size: int) -> np.ndarray:
    """``size`` bits of a hash, with room for a bit below; a slot is the exclusive or of its context's and its node's."""
    return (hashed >> np.uint32(32 - size) << np.uint32(1)).view(np.int32)


@dataclass
class Events:
    """Bits to predict: whose they are, their slot in each of three tables with the bit below it, and where their row starts."""

    owner: np.ndarray
    slots: list[np.ndarray]
    row: np.ndarray | int
    spelt: bool


def code_events(code: Code, symbols: np.ndarray, before: np.ndarray, before2: np.ndarray, size: int) -> Events:
    """Tables: the node itself, the node after the last symbol, the node after the last two.

    Events come level by level, so that the symbols still walking lie together (longest walks first).
    """
    lengths = code.lengths.take(symbols)
    order = np.argsort(~lengths, kind="stable")
    walking = (len(symbols) - np.cumsum(np.bincount(lengths, minlength=len(code.levels) + 1))[:-1]).tolist()
    symbols, one = symbols.take(order).astype(np.intp), _hash(before.take(order).astype(np.uint32), np.uint32(1))
    two = _place(_hash(before2.take(order).astype(np.uint32), one), size)
    one = _place(one, size)
    total = int(lengths.sum(dtype=np.int64))
    steps, last, last2 = (np.empty(total, np.int32) for _ in range(3))
    owner, at = np.empty(total, np.int64), 0
    for level, n in zip(code.levels, walking, strict=True):
        part = slice(at, at + n)
        steps[part], last[part], last2[part], owner[part] = level.take(symbols[:n]), one[:n], two[:n], order[:n]
        at += n
    nodes = code.hashed(size).take(steps)
    return Events(owner, [steps, last ^ nodes, last2 ^ nodes], 0, False)


_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.int32)
_BYTE_NODES = (1 << np.arange(8) | np.arange(256)[:, None] >> np.arange(8, 0, -1)).astype(np.uint32)


def _bytes_in_words(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte of the words and their final blanks, with the four bytes before it in the word above it; bytes of each word)."""
    text = np.frombuffer(b" ".join(spelt) + b" ", np.uint8)
    sizes = np.array([len(w) + 1 for w in spelt])
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    five = text.astype(np.int64)
    for k in (1, 2, 3, 4):
        five |= np.where(place >= k, np.concatenate((np.full(k, 32, np.uint8), text))[: len(text)], 32).astype(np.int64) << 8 * k
    return five, sizes


def _byte_events(five: np.ndarray, size: int) -> Events:
    text, before = five & 255, (five >> 8).astype(np.uint32)
    contexts = [_hash(before & np.uint32(0xFFFF), np.uint32(11)), _hash(before & np.uint32(0xFFFFFF), np.uint32(12)), _hash(before, np.uint32(13))]
    nodes = (_place(_hash(_BYTE_NODES, np.uint32(5)), size) | _BYTE_BITS)[text]
    slots = [(_place(c, size)[:, None] ^ nodes).ravel() for c in contexts]
    return Events(np.repeat(np.arange(len(five)), 8), slots, np.tile(np.arange(16, _ROWS, dtype=np.int32) << _CELLS + 1, len(five)), True)


def spelling_events(unknown: list[bytes], size: int) -> Events:
    """Eight bits a byte and for a final blank, after the two, three and four bytes before in the word."""
    five, sizes = _bytes_in_words(unknown)
    e = _byte_events(five, size)
    e.owner = np.repeat(np.arange(len(unknown)), 8 * sizes)
    return e


def distinct_spelling(spelt: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[slice, Events]]]:
    """(number of each byte's kind, bytes of each word, kinds and their events by stretches); a kind has the same five bytes."""
    five, sizes = _bytes_in_words(spelt)
    coded = pa.array(five).dictionary_encode()
    kinds = coded.dictionary.to_numpy()
    stretches = ((slice(at, at + _CHUNK), _byte_events(kinds[at : at + _CHUNK], size)) for at in range(0, len(kinds), _CHUNK))
    return coded.indices.to_numpy(), sizes, stretches


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4))


def _grid(most: float, bend: float, levels: int) -> np.ndarray:
    """Levels from -most to most, close to each other in the middle."""
    return most * np.sinh(bend * np.linspace(-1, 1, levels)) / np.sinh(bend)


def _nearest(grid: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted((grid[1:] + grid[:-1]) / 2, values)


_FEW = np.sort([float(_stretch(np.float64(n), np.float64(m))) for n in range(4) for m in range(4 - n) if n + m])
"""Stretched predictions of one to three bits seen; (1, 1) is the only one of value zero."""
_FIRST = _grid(_LIMIT, 5.0, _LEVELS)
_TRUSTED = [np.zeros(1), _FEW, _grid(4.4, 1.5, 22), _grid(_LIMIT, 4.0, 32)]
_STATE = np.concatenate(_TRUSTED)
_TRUST = np.repeat(np.arange(4), [len(g) for g in _TRUSTED])
"""64 states of a slot: how many bits it has seen (none, 1-3, 4-31, more), and a stretched prediction."""


def _levels(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _nearest(_FIRST, _stretch(zeros, ones))


def _states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n, out = zeros + ones, np.zeros(zeros.shape, np.int64)
    trust = np.digitize(n, (1, 4, 32))
    for k, grid in enumerate(_TRUSTED):
        own = np.flatnonzero(trust == k)
        out[own] = (_TRUST < k).sum() + _nearest(grid, _stretch(zeros[own], ones[own]))
    return out


def _by_bit(table: np.ndarray, kind, left_out: bool) -> np.ndarray:
    """``kind`` of the counts of each slot and bit, where asked with that bit left out once."""
    zeros, ones, own = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), int(left_out)
    if not own:
        return np.repeat(kind(zeros, ones), 2)
    return np.column_stack([kind(np.maximum(zeros - own, 0), ones), kind(zeros, np.maximum(ones - own, 0))]).ravel()


def _cell_inputs() -> tuple[np.ndarray, np.ndarray]:
    """(inputs of the mixer, gate of a code's bit) of every cell."""
    cell = np.arange(1 << _CELLS)
    first, second, third = cell >> 12, cell >> 6 & 63, cell & 63
    return np.column_stack([_FIRST[first], _STATE[second], _STATE[third], np.full(len(cell), _BIAS)]), 4 * _TRUST[second] + _TRUST[third]


def _fitted(x: np.ndarray, offset: np.ndarray, seen: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression on counted cells (``seen``: zeros, ones), by Newton steps from ``start`` and held to it by ``ridge``."""

    def loss(w: np.ndarray) -> float:
        z = x @ w + offset
        return seen[:, 0] @ np.logaddexp(0, z) + seen[:, 1] @ np.logaddexp(0, -z) + ridge / 2 * ((w - start) ** 2).sum()

    w, best = start, loss(start)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w + offset)))
        total = seen.sum(axis=1)
        down = x.T @ (total * p - seen[:, 1]) + ridge * (w - start)
        step = np.linalg.solve(x.T @ (x * (total * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), down)
        size = 1.0
        while (now := loss(w - size * step)) > best and size > 1e-6:
            size /= 2
        if now >= best - 1e-12 * abs(best):
            break
        w, best = w - size * step, now
    return w


class Model:
    """Counts of all tables, the gated weights and the refinement; scores documents.

    A bit's cell is the level of its first prediction and the states of its two others, in the row of its depth. What the
    mixer learns from a bit and what it answers depend on the cell only: learning counts cells, scoring looks them up.
    """

    def __init__(self, code: Code, tables: list[np.ndarray], spelling: list[np.ndarray], sizes: tuple[int, int]) -> None:
        self.code, self.sizes = code, sizes
        self.counts = [[code.counts, *tables], spelling]
        self.weights = np.zeros((_GATES, _INPUTS), np.float64)
        self.weights[:, 0] = 0.4
        self.weights[:16, 0] = 1.0
        self.weights[16:, 1:3] = 0.3
        self.refine = np.tile(np.linspace(-_LIMIT, _LIMIT, _STEPS), (_DEPTHS, 1))
        self.states: list[list[np.ndarray]] = []
        self.answers = np.zeros(0, np.float32)

    def _with_states(self, left_out: bool) -> Model:
        """This model with parts of cells by slot and bit in place of counts."""
        out = Model(self.code, [], [], self.sizes)
        out.weights, out.refine, out.counts = self.weights, self.refine, []
        for spelt, (first, second, third) in enumerate(self.counts):
            level = _by_bit(first, _levels, left_out and bool(spelt)) << 13 | np.arange(2 * len(first)) & 1
            if not spelt:
                level |= np.repeat(np.minimum(self.code.depths, 15), 2) << _CELLS + 1
            out.states.append([level.astype(np.int32), (_by_bit(second, _states, left_out) << 7).astype(np.uint16), (_by_bit(third, _states, left_out) << 1).astype(np.uint8)])
        return out

    def left_out(self) -> Model:
        """This model for counting cells of bits that it has counted: each is left out of its slots.

        It stays in the counts of its node alone: Huffman's code evens out the two sides, so that a bit left out there
        would speak for the other side.
        """
        return self._with_states(True)

    def frozen(self) -> Model:
        """This model for scoring only."""
        out = self._with_states(False)
        x, gate = _cell_inputs()
        answers = np.empty((_ROWS, len(x), 2), np.float32)
        for spelt, rows in enumerate((range(16), range(16, _ROWS))):
            mixed = self._mixed(x, gate + 16 * spelt)
            for row in rows:
                final = 0.5 * mixed + 0.5 * np.interp(mixed, np.linspace(-_LIMIT, _LIMIT, _STEPS), self.refine[row])
                answers[row] = np.logaddexp(0, np.column_stack([final, -final])) / -np.log(2)
        out.answers = answers.ravel()
        return out

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -_LIMIT + 1e-4, _LIMIT - 1e-4)

    def fit(self, seen: list[np.ndarray]) -> None:
        """Weights, then refinement, of greatest likelihood for the left-out bits that each row's (cell, bit) has seen."""
        x, gate = _cell_inputs()
        start, knots, fine = self.weights.copy(), np.linspace(-_LIMIT, _LIMIT, _STEPS), 16
        place = np.arange((_STEPS - 1) * fine + 1) / fine
        near = np.maximum(0, 1 - np.abs(place[:, None] - np.arange(_STEPS)))
        for spelt, rows in enumerate((range(16), range(16, _ROWS))):
            total = sum(seen[row].astype(np.float64) for row in rows)
            for g in range(16):
                own = np.flatnonzero((gate == g) & total.any(axis=1))
                if len(own):
                    self.weights[16 * spelt + g] = _fitted(x[own], np.zeros(len(own)), total[own], start[16 * spelt + g], 16.0)
            at = np.rint((self._mixed(x, gate + 16 * spelt) + _LIMIT) * (fine * (_STEPS - 1) / (2 * _LIMIT))).astype(np.int64)
            for row in rows:
                by_place = np.column_stack([np.bincount(at, seen[row][:, bit], len(place)) for bit in (0, 1)])
                if by_place.any():
                    self.refine[row] = _fitted(0.5 * near, 0.5 * near @ knots, by_place, knots, 4.0)

    def cells(self, e: Events) -> np.ndarray:
        """Row, cell and bit of each event, packed."""
        first, second, third = (part.take(slot) for part, slot in zip(self.states[e.spelt], e.slots, strict=True))
        first += second
        first += third
        first += e.row
        return first

    def bits(self, e: Events) -> np.ndarray:
        """log2 of the probability of each bit, by a frozen model."""
        return self.answers.take(self.cells(e))

    def spelt_bits(self, spelt: list[bytes]) -> np.ndarray:
        """log2 of the probability of each word's spelling."""
        number, sizes, stretches = distinct_spelling(spelt, self.sizes[1])
        bits = np.concatenate([self.bits(e).reshape(-1, 8).sum(axis=1, dtype=np.float64) for _, e in stretches])
        return np.add.reduceat(bits.take(number), np.cumsum(sizes) - sizes)

    def score_all(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, sum of log10(count + 1) of the tokens with a code) of each text, and places of escaped tokens."""
        total, base = np.zeros(words.texts), np.zeros(words.texts)
        symbols = self.code.symbols(words)
        for part, *context in self.code.stretches(words):
            e, owner = code_events(self.code, *context, self.sizes[0]), words.owner[part]
            low = owner[0]
            bits = np.bincount(owner - low, np.bincount(e.owner, self.bits(e), len(owner)))
            total[low : low + len(bits)] += bits
        of_word = symbols == self.code.escape
        unknown = np.flatnonzero(of_word)
        extra = np.zeros(len(symbols))
        for at in range(0, len(unknown), _SPELT):
            part = unknown[at : at + _SPELT]
            extra[part] = self.spelt_bits([words.distinct[k] for k in part.tolist()])
        gain = np.append(np.log10(self.code.weights + 1.0), 0.0)
        total += np.bincount(words.owner, extra.take(words.number), words.texts)
        base += np.bincount(words.owner, gain.take(symbols).take(words.number), words.texts)
        return total * np.log10(2), base, np.flatnonzero(of_word.take(words.number))


def _count_words(batches):
    for piece in pieces(batches):
        words = Words.of(piece.column("text"))
        n = np.bincount(words.number, minlength=len(words.distinct))
        yield pa.RecordBatch.from_arrays([pa.array(words.distinct, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])


_CELL_ROWS = pa.schema([("place", pa.int32()), ("cells", pa.binary())])


def _packed(tables: list[np.ndarray]) -> pd.DataFrame:
    """Rows (place, cells) of the used parts of count tables."""
    rows = []
    for k, table in enumerate(tables):
        for at in range(0, len(table), _ROW):
            part = table[at : at + _ROW]
            if part.any():
                rows.append((k * 1_000_000 + at // _ROW, zlib.compress(part.astype("<u8").tobytes(), 1)))
    return pd.DataFrame(rows, columns=["place", "cells"])


def _summed(batches):
    """Adds up the rows of equal place; holds the parts of the tables that this task has."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, cells in zip(batch["place"].tolist(), batch["cells"], strict=True):
            part = np.frombuffer(zlib.decompress(cells), "<u8")
            held[place] = held[place] + part if place in held else part
    yield pd.DataFrame({"place": list(held), "cells": [zlib.compress(part.tobytes(), 1) for part in held.values()]})


def _gathered(rows: DataFrame, counter, tables: int, size: int) -> list[np.ndarray]:
    """Count tables of all rows: added up in tasks by part, then fetched (their size is fixed by ``size``)."""
    parts = rows.mapInArrow(counter, "place int, cells binary").repartition("place").mapInPandas(_summed, "place int, cells binary")
    out = [np.zeros((1 << size, 2), np.int64) for _ in range(tables)]
    for r in parts.collect():
        k, at = divmod(r["place"], 1_000_000)
        part = np.frombuffer(zlib.decompress(bytes(r["cells"])), "<u8").reshape(-1, 2)
        out[k][at * _ROW : at * _ROW + len(part)] += part.astype(np.int64)
    return [t.astype(np.uint32) if t.max() < 1 << 32 else t for t in out]


def _counted_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the texts."""
    return stored(texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def learn(training: DataFrame, frequent: int = 131_071, sizes: tuple[int, int] = (20, 18), sample: int | None = None, share: int = 2_000_000):
    """(model, counts(word, n), tokens, distinct) learnt from the texts of ``training(order, text)``.

    Counts of all words of all texts, of the bits of the ``frequent`` most frequent tokens after their hashed contexts,
    and of the bits that spell each distinct word. Tables have 2^sizes entries whatever the corpus; their bits per entry
    grow with it. The mixing weights and the refinement are those of greatest likelihood over the bits of all texts (of
    the ``sample`` texts of smallest order where one is asked for), each bit left out of the counts that predict it, and
    over the bits of all words without a code or seen less than three times, as often as they occur. Tasks count the
    cells of these bits, which is all that the fit depends on, so that the order and the partitions of the texts play no
    part. Tables are counted by tasks of at least about ``share`` tokens.
    """
    spark = training.sparkSession
    counts = _counted_words(training)
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    tokens, distinct = total["n"] or 0, total["v"]
    head = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    # as many tokens will be new as are seen once (Good and Turing), beside those seen but without a code
    code = Code.of(head, tokens - sum(n for _, n in head) + total["once"])
    known = spark.sparkContext.broadcast(code)
    texts = training.select("text").coalesce(1 + tokens // share)

    def contexts(batches):
        tables = [np.zeros((1 << sizes[0], 2), np.uint32) for _ in range(2)]
        for piece in pieces(batches):
            for _, *context in known.value.stretches(Words.of(piece.column("text"))):
                e = code_events(known.value, *context, sizes[0])
                for table, slot in zip(tables, e.slots[1:], strict=True):
                    np.add.at(table.ravel(), slot, np.uint32(1))
        yield pa.RecordBatch.from_pandas(_packed(tables), _CELL_ROWS, preserve_index=False)

    def spellings(batches):
        tables = [np.zeros((1 << sizes[1], 2), np.uint64) for _ in range(3)]
        for batch in batches:
            seen = [w for w in batch.column("word").to_numpy(zero_copy_only=False) if w]
            for at in range(0, len(seen), _SPELT):
                number, _, stretches = distinct_spelling(seen[at : at + _SPELT], sizes[1])
                times = np.bincount(number).astype(np.uint64)
                for part, e in stretches:
                    for table, slot in zip(tables, e.slots, strict=True):
                        np.add.at(table.ravel(), slot, np.repeat(times[part], 8))
        yield pa.RecordBatch.from_pandas(_packed(tables), _CELL_ROWS, preserve_index=False)

    model = Model(code, _gathered(texts, contexts, 2, sizes[0]), _gathered(counts, spellings, 3, sizes[1]), sizes)
    held = model.left_out()
    held.code = None  # in the other broadcast
    shared = spark.sparkContext.broadcast(held)

    def mixer(batches):
        own, seen = shared.value, np.zeros(16 << _CELLS + 1, np.uint32)
        for piece in pieces(batches):
            for _, *context in known.value.stretches(Words.of(piece.column("text"))):
                np.add.at(seen, own.cells(code_events(known.value, *context, sizes[0])), np.uint32(1))
        yield pa.RecordBatch.from_pandas(_packed(list(seen.reshape(16, -1, 2))), _CELL_ROWS, preserve_index=False)

    def speller(batches):
        own, coded, seen = shared.value, known.value.numbers, np.zeros(_ROWS - 16 << _CELLS + 1, np.uint64)
        for batch in batches:
            columns = (c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)
            rows = [(w, n) for w, n in zip(*columns, strict=True) if w and (n < 3 or w not in coded)]
            for at in range(0, len(rows), _SPELT):
                spelt, n = zip(*rows[at : at + _SPELT], strict=True)
                number, lengths, stretches = distinct_spelling(list(spelt), sizes[1])
                times = np.bincount(number, np.repeat(n, lengths)).astype(np.uint64)
                for part, e in stretches:
                    np.add.at(seen, own.cells(e) - (16 << _CELLS + 1), np.repeat(times[part], 8))
        yield pa.RecordBatch.from_pandas(_packed(list(seen.reshape(_ROWS - 16, -1, 2))), _CELL_ROWS, preserve_index=False)

    if sample is not None:
        texts_seen = next((n for w, n in head if w == END), 0)
        # hashes are even: four times the texts wanted lie below this part of the range, so few texts are sent on
        low = F.pmod("order", F.lit(1 << 30)) < F.lit(4.0 * sample * (1 << 30) / max(1, texts_seen))
        seen = training.where(low).withColumn("place", F.pmod("order", F.lit(1 << 30))).orderBy("place", "text").limit(sample)
        texts, spelt = seen.select("text"), _counted_words(seen)
    else:
        spelt = counts
    model.fit([*_gathered(texts, mixer, 16, _CELLS), *_gathered(spelt, speller, _ROWS - 16, _CELLS)])
    known.destroy()
    shared.destroy()
    return model.frozen(), counts, tokens, distinct


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key's text leaves 2 when divided by 7; a row without key is held out too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(True))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learns from the rows that are not held out. ``score`` is the model's log10 probability of the text's words and end;
    ``base_score`` that of single tokens by their counts plus one. Null texts are empty: one token, the end. A token
    without a code is spelt; its exact count comes from a join with the word counts, so no table of all words is held by
    any task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = rows.where(~held_out()).select(F.xxhash64(F.col("doc_id").cast("string")).alias("order"), "text")
    model, counts, tokens, distinct = learn(training, **settings)
    shared = spark.sparkContext.broadcast(model)
    kinds = pa.schema([(c, pa.int64()) for c in ("uid", "doc_id", "n", "known")] + [("base", pa.float64()), ("score", pa.float64()), ("size", pa.int64()), ("word", pa.binary())])

    def each(batches):
        model = shared.value
        high, serial = TaskContext.get().partitionId() << 40, 0
        for piece in pieces(batches):
            words, rows = Words.of(piece.column("text")), len(piece)
            scores, base, escaped = model.score_all(words)
            ids = np.arange(serial, serial + rows) + high
            serial += rows
            owner, number = words.owner[escaped], words.number[escaped]
            n = np.bincount(words.owner, minlength=rows)
            known = n - np.bincount(owner, minlength=rows)
            size = pc.binary_length(piece.column("text")).cast(pa.int64())
            columns = [ids, piece.column("doc_id"), n, known, base, scores, size, pa.nulls(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)
            pairs, times = np.unique(owner * len(words.distinct) + number, return_counts=True)
            if len(pairs):
                text, word = np.divmod(pairs, len(words.distinct))
                none = np.zeros(len(pairs))
                escaped_words = pa.array([words.distinct[k] for k in word.tolist()], pa.binary())
                columns = [ids[text], pa.nulls(len(pairs)), times, none, none, none, none, escaped_words]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    parts = stored(rows.mapInArrow(each, "uid long, doc_id long, n long, known long, base double, score double, size long, word binary"), "scores")
    tail = parts.where("word is not null").select("uid", "word", F.col("n").alias("times")).join(counts, "word").groupBy("uid").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain")
    )
    per_token = float(np.log10(tokens + 1.0 * (distinct + 1)))
    return parts.where("word is null").join(tail, "uid", "left").select(
        "doc_id", held_out().alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n") * per_token).alias("base_score"), "score",
        F.when(F.col("size") > 0, -F.col("score") / float(np.log10(2)) / F.col("size")).alias("bits_per_byte"),
    )
