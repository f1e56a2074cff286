"""Token ids of whole texts from a word-level tokenizer file, with bounded caches of words already seen."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_KEPT_CHARACTERS = 64

_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
_PIECES_AND_BLANKS = re.compile(_PIECES.pattern + "| ")
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-įı-ňŊ-ž]*")
"""Texts in which Python's letters, lower case and composed forms are those of the tokenizer."""


class WordTokenizer:
    """Ids as by the tokenizers library, for files whose words never cross a blank.

    A text is cut at blanks; each unit's ids are looked up, and units not seen yet are split into words that the library
    encodes together in one call. ``special`` says whether strings of special tokens in a text become those tokens, as
    the library does by default. The caches are emptied when they reach ``most`` units or ``most_words`` words, and keep
    none longer than ``_KEPT_CHARACTERS``, so that their bytes are bounded whatever the texts are.
    """

    def __init__(self, path: str, special: bool = True, most: int = 700_000, most_words: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most, self.most_words = Tokenizer.from_file(path), most, most_words
        self.library.encode_special_tokens = not special
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.last = np.zeros(self.size, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, unit: str) -> bytes:
        return np.array(self.library.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self.words.update((w, self._whole(w)) for w in part)
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends).tolist(), strict=True):
                self.words[word] = raw[start:end]
                start = end

    def _learn(self, units: set[str]) -> None:
        """Split all units by one pattern over their joined text, where blanks tell them apart."""
        plain, text = list(units), ""
        if not self._all_plain(text := " ".join(plain)):
            for unit in plain:
                if not self._all_plain(unit):
                    self.units[unit] = self._whole(unit)
            plain = [u for u in plain if u not in self.units]
            text = " ".join(plain)
        if not plain:
            return
        parts = _PIECES_AND_BLANKS.findall(text.lower())
        words = set(parts)
        words.discard(" ")
        known = self.words
        missing = words.difference(known)
        if len(known) + len(missing) > self.most_words:
            known.clear()
            missing = words
        self._learn_words(list(missing))
        number = {word: k for k, word in enumerate(words)}
        number[" "] = -1
        codes = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        table = [known[word] for word in words]
        sizes = np.array([*map(len, table), 0], np.int64)
        # end of every unit in the bytes of all words laid end to end
        ends = np.cumsum(sizes[codes])[np.append(np.flatnonzero(codes < 0), len(codes) - 1)] if len(codes) else np.zeros(len(plain), np.int64)
        table.append(b"")
        raw, start = b"".join([table[c] for c in codes.tolist()]), 0
        for unit, end in zip(plain, ends.tolist(), strict=True):
            self.units[unit] = raw[start:end]
            start = end
        for word in missing:
            if len(word) > _KEPT_CHARACTERS:
                del known[word]

    @staticmethod
    def _all_plain(text: str) -> bool:
        return "<|" not in text and _PLAIN.fullmatch(text) is not None

    def _forget_long(self, units) -> None:
        for unit in units:
            if len(unit) > _KEPT_CHARACTERS:
                del self.units[unit]

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the whole text; of null none."""
        units, known = (text or "").split(" "), self.units
        needed = set(units)
        missing = needed.difference(known)
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = needed
            self._learn(missing)
        out = np.frombuffer(b"".join([known[u] for u in units]), "<u4")
        self._forget_long(missing)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids start and the last end); null texts have none.

        Units are split off and numbered for the whole batch at once.
        """
        lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        units, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.units
        missing = {u for u in units if u not in known}
        if len(known) + len(missing) > self.most:
            known.clear()
            missing = set(units)
        self._learn(missing)
        rows = [known[u] for u in units]
        self._forget_long(missing)
        codes = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(map(rows.__getitem__, codes.tolist())), "<u4")
        ends = np.cumsum((np.fromiter(map(len, rows), np.int64, len(rows)) // 4)[codes])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.concatenate(([0], ends))[offsets]


@lru_cache(maxsize=4)
def word_tokenizer(path: str, special: bool = True) -> WordTokenizer:
    """One tokenizer a Python worker."""
    return WordTokenizer(path, special)
