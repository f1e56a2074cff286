"""Byte-level BPE from a rank file: a minimal perfect hash for whole pre-tokens, heap merges for the rest; and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

_BLANK = re.compile(r"\s ?\s|\s\Z")
_MASK = (1 << 64) - 1
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and a number in each line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _displaced(own: int, step: int) -> int:
    """Another hash of the same key for every step (odd multipliers of 64 bits mix the product's upper half)."""
    return ((own ^ (step * 0x9E3779B97F4A7C15 & _MASK)) * 0xD6E8FEB86659FD93 & _MASK) >> 20


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys to n slots, by hash and displace.

    Keys fall into buckets; from the largest bucket on, the first displacement that sends all its keys to free slots is
    kept. A lookup is one displacement, one slot and one comparison of the key found there.
    """

    def __init__(self, keys: list[bytes], load: int = 3) -> None:
        n = len(keys)
        self.steps = [0] * max(1, -(-n // load))
        self.keys, self.values = [b""] * n, [0] * n
        hashes = [self._hashes(key) for key in keys]
        buckets: dict[int, list[int]] = {}
        for k, (bucket, _) in enumerate(hashes):
            buckets.setdefault(bucket, []).append(k)
        taken, free = [False] * n, iter(range(n))
        for bucket, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:  # any free slot does; written as a negative number
                slot = next(s for s in free if not taken[s])
                self.steps[bucket], slots = -slot - 1, [slot]
            else:
                step = 1
                while True:
                    slots = [_displaced(hashes[k][1], step) % n for k in members]
                    if not any([taken[s] for s in slots]) and len(set(slots)) == len(slots):
                        break
                    step += 1
                self.steps[bucket] = step
            for k, slot in zip(members, slots, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = True, keys[k], k

    def _hashes(self, key: bytes) -> tuple[int, int]:
        digest = xxhash.xxh3_128_intdigest(key)
        return (digest >> 64) % len(self.steps), digest & _MASK

    def get(self, key: bytes) -> int:
        """The position of the key in the list it was built from, or -1."""
        if not self.keys:
            return -1
        bucket, own = self._hashes(key)
        step = self.steps[bucket]
        slot = -step - 1 if step < 0 else _displaced(own, step) % len(self.keys)
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBPE:
    """Encoder and decoder of one rank file; the caches are emptied at ``most`` units or ``most_pieces`` pieces."""

    def __init__(self, path: str, pattern: str, most: int = 400_000, most_pieces: int = 1_000_000) -> None:
        self.ranks = read_ranks(path)
        self.tokens = list(self.ranks)
        self.numbers = list(self.ranks.values())
        self.whole = PerfectHash(self.tokens)
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        # a backslash s of the pattern is Unicode white space, without the four separators that Python adds
        self.pattern, self.most, self.most_pieces = regex.compile(pattern), most, most_pieces
        self.known: dict[str, tuple[str, bytes]] = {}
        self.seen: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token: the adjacent pair of lowest rank merges first, the leftmost among equals."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it was merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def piece(self, piece: bytes) -> list[int]:
        found = self.whole.get(piece)
        return [self.numbers[found]] if found >= 0 else self.merged(piece)

    def _unit(self, unit: str) -> tuple[str, bytes]:
        seen, ids = self.seen, []
        for match in self.pattern.findall(unit):
            found = seen.get(match)
            if found is None:
                if len(seen) >= self.most_pieces:
                    seen.clear()
                found = seen[match] = self.piece(match.encode("utf-8"))
            ids += found
        return ",".join(map(str, ids)), self.decode(ids)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def _units(self, text: str) -> list[str]:
        """Parts that the pattern never crosses: a blank between two other characters starts a match."""
        if _BLANK.search(text):
            first, *rest = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + u for u in rest]]

    def _all(self, text: str | None) -> list[tuple[str, bytes]]:
        units, known = self._units(text or ""), self.known
        needed = set(units)
        missing = needed.difference(known)
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = needed
            for unit in missing:
                known[unit] = self._unit(unit)
        return [known[u] for u in units]

    def text_ids(self, text: str | None) -> str:
        """Decimal ids of the whole text, joined by commas."""
        return ",".join([a for a, _ in self._all(text) if a])

    def encode(self, text: str | None) -> np.ndarray:
        ids = self.text_ids(text)
        return np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder a Python worker."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text is empty, an empty one has no ids."""

    def each(batches):
        encoder = byte_bpe(ranks, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": [encoder.encode(t).astype(np.int32) for t in batch["text"]]})

    return _narrow(docs, key, text).mapInPandas(each, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of ``ids``; null ids give null, an unknown id is an error."""

    def each(batches):
        encoder = byte_bpe(ranks, pattern)
        for batch in batches:
            data = [None if ids is None else encoder.decode(ids.tolist()) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "data": data})

    return encoded.select("doc_id", "ids").mapInPandas(each, "doc_id long, data binary")


def encoding_digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its ids are decoded again in the same task."""

    def each(batches):
        encoder = byte_bpe(ranks, pattern)
        for batch in batches:
            rows = []
            for value in batch["text"]:
                parts = encoder._all(value)
                ids = ",".join([a for a, _ in parts if a])
                decoded = hashlib.sha256()
                for at in range(0, len(parts), 1 << 16):
                    decoded.update(b"".join([b for _, b in parts[at : at + (1 << 16)]]))
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), decoded.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return _narrow(docs, key, text).mapInPandas(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
