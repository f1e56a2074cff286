"""Frequent phrases of two to five words by partitioning, and how much more often they come than their parts explain.

Documents fall into shards by the hash of their key. A phrase with the global support in a language has, in at least one
shard, that support lowered in proportion to the shard's words: so every shard is mined completely at its lowered
support (pairs first, then the longer phrases all of whose pairs were found in the shard), the phrases found are united,
and one more pass counts all of them exactly. A shard is a grouping key, not a task: its words are read by any number of
tasks, and counts meet by phrase after adding up within tasks.

What was found travels to the tasks as a bit table over 64-bit hashes, of bounded size: a hit by chance only brings a
phrase more to the exact count, so results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.operators.ranks import attach
from gramwise.session import stored

LONGEST, SUPPORT, SHARDS, REPORTED = 5, 100, 8, 2000
_MOST_BITS = 28
_CHUNK_BYTES, _SMALL_CHUNK_BYTES = 6 << 20, 1 << 20
_BATCH_ROWS = 1 << 16
_PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


_FOLDED = bytes(10 if chr(b) in _PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
"""Byte table: A-Z lower-cased, tabs to blanks, all piece ends to line feeds; bytes of other characters as they are."""


def _string_hash(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, from their bytes."""
    values = values.cast(pa.large_string())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[place])))
    return _mix(sums[ends[1:]] - sums[ends[:-1]])


class _Text:
    """The words of some documents end to end, with their pieces, groups and hashes."""

    def __init__(self, langs: pa.Array, texts: pa.Array, extra: np.ndarray):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer((texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[ends[0] : ends[-1]].translate(_FOLDED), np.uint8)
        ends = ends - ends[0]
        stop = raw == 10
        inside = ~(stop | (raw == 32))
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True
        edge[1:] |= ~np.append(inside[:-1], False) if len(raw) else edge[1:]
        starts = np.flatnonzero(inside & edge[:-1])
        # one counter for every byte: half as wide where the text allows
        letters = np.cumsum(inside, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        offsets = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside]))
        coded = words.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.doc = np.searchsorted(ends, starts, "right") - 1
        piece = np.cumsum(stop)[starts] if len(starts) else starts
        self.joined = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        lang = langs.dictionary_encode()
        self.lang_names, of_doc = lang.dictionary, lang.indices.to_numpy().astype(np.int64)
        self.lang, self.extra = of_doc[self.doc], extra
        self.of_doc = of_doc
        self.keys: list[np.ndarray] = []

    @property
    def group(self) -> np.ndarray:
        """Per word a number for its language and value of ``extra``, which counts are kept apart by."""
        return np.unique(np.stack([self.of_doc, self.extra]), axis=1, return_inverse=True)[1].reshape(-1)[self.doc]

    def key(self, k: int) -> np.ndarray:
        """Hash of language and k words from every position on."""
        if not self.keys:
            self.word_hash = _string_hash(self.words)[self.codes]
            self.keys.append(_mix(self.word_hash ^ (_string_hash(self.lang_names) * np.uint64(3))[self.lang]))
        while len(self.keys) < k:
            shorter, at = self.keys[-1], len(self.keys)
            self.keys.append(_mix(shorter[:-1] * np.uint64(0xA0761D6478BD642F) + self.word_hash[at:]) if len(shorter) else shorter)
        return self.keys[k - 1]

    def counted(self, at: np.ndarray, names: np.ndarray, k: int, named: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the k-word phrases at positions ``at`` from those of their first k - 1 words; exact, no hashes.

        Returns (name of every position, one position for each name, count of each name); the first empty unless ``named``.
        """
        values = names * (len(self.words) + 1) + self.codes[at + k - 1]
        order = np.argsort(values)
        values = values[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        first = np.flatnonzero(fresh)
        inverse = np.zeros(len(values) if named else 0, np.int64)
        if named:
            inverse[order] = np.cumsum(fresh) - 1
        return inverse, at[order[first]], np.diff(np.append(first, len(values)))


def _per_chunk(work: Callable[[_Text], Iterator[pa.RecordBatch]], most_bytes: int = _CHUNK_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Call ``work`` on some megabytes of text at a time; a document is never cut."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + most_bytes, "right")))
                part = batch.slice(at, stop - at)
                for counted in work(_Text(part.column(0), part.column(1), part.column(2).to_numpy(zero_copy_only=False).astype(np.int64))):
                    # the other side holds a batch in memory whole
                    yield from (counted.slice(i, _BATCH_ROWS) for i in range(0, counted.num_rows, _BATCH_ROWS))
                    del counted
                pa.default_memory_pool().release_unused()
                at = stop

    return each


class _Found:
    """Bit table of hashes; may hold hashes that were never entered, never misses one that was."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(64 - bits), table

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> self.shift
        return (self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _found(keys: DataFrame, count: int, most_bits: int) -> _Found:
    """The table of a column ``key``: 32 bits for each entry up to 2^``most_bits`` bits, put together in the tasks."""
    bits = min(max(16, int(count).bit_length() + 5), most_bits)
    slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    cells = slots.groupBy(F.expr("cast(slot div 64 as int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    rows = cells.toArrow()
    table = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    table[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return _Found(bits, table.astype("<i8").view(np.uint8))


def _count_words(text: _Text) -> Iterator[pa.RecordBatch]:
    """(lang, shard, word, c): every word of a language (shard null), and the words of every shard (word null)."""
    span = len(text.words) + 1
    for by, shard in ((text.lang * span + text.codes, False), (text.extra[text.doc] + (text.lang << 32), True)):
        _, first, counts = np.unique(by, return_index=True, return_counts=True)
        empty = pa.nulls(len(first))
        yield pa.RecordBatch.from_arrays(
            [
                text.lang_names.take(pa.array(text.lang[first])).cast(pa.string()),
                pa.array(text.extra[text.doc[first]].astype(np.int32)) if shard else empty.cast(pa.int32()),
                empty.cast(pa.string()) if shard else text.words.take(pa.array(text.codes[first])).cast(pa.string()),
                pa.array(counts.astype(np.int64)),
            ],
            names=["lang", "shard", "word", "c"],
        )


def _mined(text: _Text, at: np.ndarray, counts: np.ndarray, k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(text.key(k)[at].view(np.int64)), pa.array(text.extra[text.doc[at]]), pa.array(counts.astype(np.int64))], names=["key", "cell", "c"]
    )


def _in_shard(keys: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return _mix(keys + (cell >> 32).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _shard_key() -> Callable[[pd.Series, pd.Series], pd.Series]:
    @F.pandas_udf("long")
    def mixed(key: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series(_in_shard(key.to_numpy(np.int64).view(np.uint64), cell.to_numpy(np.int64)).view(np.int64))

    return mixed


def _word_key(lang: Column, word: Column) -> Column:
    @F.pandas_udf("long")
    def key(lang: pd.Series, word: pd.Series) -> pd.Series:
        hashed = lambda s: _string_hash(pa.array(s, pa.string()))
        return pd.Series(_mix(hashed(word) ^ hashed(lang) * np.uint64(3)).view(np.int64))

    return key(lang, word)


def _pairs(words: _Found) -> Callable[[_Text], Iterator[pa.RecordBatch]]:
    """Counts of all pairs of frequent words, by shard."""

    def work(text: _Text) -> Iterator[pa.RecordBatch]:
        frequent = words.holds(text.key(1))
        at = np.flatnonzero(text.joined & frequent[:-1] & frequent[1:])
        _, first, counts = text.counted(at, text.group[at] * (len(text.words) + 1) + text.codes[at], 2, named=False)
        yield _mined(text, first, counts, 2)

    return work


def _longer(pairs: _Found, longest: int) -> Callable[[_Text], Iterator[pa.RecordBatch]]:
    """Counts of all phrases of three words and more whose pairs were all found in the shard."""

    def work(text: _Text) -> Iterator[pa.RecordBatch]:
        cell = text.extra[text.doc]
        pair = np.zeros(len(text.codes), bool)
        pair[:-1] = text.joined & pairs.holds(_in_shard(text.key(2), cell[:-1])) if len(text.codes) else text.joined
        at = np.flatnonzero(pair)
        names = text.counted(at, text.group[at] * (len(text.words) + 1) + text.codes[at], 2)[0]
        for k in range(3, longest + 1):
            on = np.append(pair, np.zeros(k, bool))[at + k - 2]
            at = at[on]
            names, first, counts = text.counted(at, names[on], k)
            yield _mined(text, first, counts, k)

    return work


def _exact(found: _Found, longest: int) -> Callable[[_Text], Iterator[pa.RecordBatch]]:
    """Counts of all phrases that were found in any shard, with their words."""

    def work(text: _Text) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(text.codes) + longest, bool)
        held[: len(text.joined)] = text.joined
        at = np.flatnonzero(held)
        names = text.lang[at] * (len(text.words) + 1) + text.codes[at]
        for k in range(2, longest + 1):
            if k > 2:
                # both shorter phrases inside must have been found as well
                names, at = names[on := held[at] & held[at + 1]], at[on]
            own = found.holds(text.key(k)[at])
            at, names = at[own], names[own]
            names, first, counts = text.counted(at, names, k)
            held[:] = False
            held[at] = True
            flat = text.words.take(pa.array(text.codes[(first[:, None] + np.arange(k)).reshape(-1)])).cast(pa.string())
            phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(first) + 1, k), pa.int32()), flat), " ")
            yield pa.RecordBatch.from_arrays(
                [text.lang_names.take(pa.array(text.lang[first])).cast(pa.string()), phrases, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "c"]
            )

    return work


def frequent_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, most_bits: int = _MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to ``longest`` words with f >= ``support``, (lang, n) of all words).

    Fewer shards prune better, more shards leave less to a shard; results are the same. A null language is ``und``, a
    null text empty, a null key falls into one shard of its own hash; repeated rows count as often as they come.
    """
    source = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int").alias("shard"),
    )
    counts = source.mapInArrow(_per_chunk(_count_words), "lang string, shard int, word string, c long")
    counts = counts.groupBy("lang", "shard", "word").agg(F.sum("c").alias("c"))
    counts = stored(counts.where(f"word is null or c >= {int(support)}"), "words")
    words, sizes = counts.where("word is not null"), counts.where("word is null")
    totals = sizes.groupBy("lang").agg(F.sum("c").alias("n"))
    # the lowered support of a shard, at least 1: below it in every shard is below the support in all
    lowered = sizes.join(totals, "lang").select("lang", "shard", F.expr(f"cast(ceil(cast({int(support)} as decimal(20, 0)) * c / n) as long)").alias("least"))
    cells = attach(source, lowered, ["lang", "shard"]).select("lang", "text", (F.shiftleft(F.col("shard").cast("long"), 32) + F.col("least")).alias("cell"))

    def broadcast(keys: DataFrame) -> _Found:
        keys = stored(keys, "found")
        return _found(keys, keys.count(), most_bits)

    def mined(work) -> DataFrame:
        rows = cells.mapInArrow(_per_chunk(work), "key long, cell long, c long").groupBy("key", "cell").agg(F.sum("c").alias("c"))
        return rows.where(F.col("c") >= F.col("cell").bitwiseAND(F.lit((1 << 32) - 1))).select("key", "cell")

    of_words = broadcast(words.select(_word_key(F.col("lang"), F.col("word")).alias("key")))
    pairs = stored(mined(_pairs(of_words)), "pairs")
    of_pairs = broadcast(pairs.select(_shard_key()("key", "cell").alias("key")))
    longer = mined(_longer(of_pairs, longest)) if longest > 2 else pairs.limit(0)
    found = broadcast(pairs.select("key").union(longer.select("key")).distinct())
    whole = source.select("lang", "text", F.lit(0).alias("cell")).mapInArrow(_per_chunk(_exact(found, longest), _SMALL_CHUNK_BYTES), "lang string, phrase string, c long")
    whole = whole.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= support)
    return stored(whole.union(words.select("lang", "word", "c")), "phrases"), totals


def collocations(docs: DataFrame, reported: int = REPORTED, salts: int = 16, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``reported`` phrases of every language.

    A phrase of two words and more that comes a times is cut where floor(1000 a n / (l r)) is least, l and r being the
    counts of its parts; ties go to the first cut. A phrase that comes no more often than a longer one around it is left
    out. Order: score, a, phrase in UTF-8 bytes. Settings are those of ``frequent_phrases``; so are nulls. Languages
    without a frequent phrase, and an empty table, give no rows.
    """
    phrases, totals = frequent_phrases(docs, **settings)
    parts = F.split("phrase", " ")
    candidates = phrases.select("lang", "phrase", F.col("f").alias("a"), parts.alias("w")).where(F.size("w") > 1)
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = attach(cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]), totals, ["lang"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000 as decimal(4, 0)) * {wide('a')} * cast(n as decimal(15, 0)) div ({wide('l')} * {wide('r')})"))
    least = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # a longer phrase as frequent as this one has a part of one word more that is as frequent: two parts each suffice
    inner = candidates.where(F.size("w") > 2).select("lang", F.explode(F.array(joined(F.lit(1), F.size("w") - 1), joined(F.lit(2), F.size("w") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within salted parts of a language, so that no task ranks all its phrases
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= reported)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= reported)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(support: int = SUPPORT, longest: int = LONGEST, reported: int = REPORTED) -> str:
    """The same rows in DuckDB SQL, every phrase of every text spelt out."""
    return rf"""
    with texts as (
        select coalesce(lang, 'und') as lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) as piece
        from documents
    ),
    pieces as (
        select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from texts
    ),
    starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0),
    grams as (select lang, w, i, unnest(range(1, least({longest}, len(w) - i + 1) + 1)) as k from starts),
    counts as (
        select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from grams group by all having count(*) >= {support}
    ),
    totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
    cuts as (
        select c.lang, c.phrase, c.k, c.f as a, x.f as l, y.f as r, n, cut,
               ((1000::hugeint * c.f * n) // (x.f::hugeint * y.f))::bigint as score
        from (select *, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from counts where k > 1) c
        join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:cut], ' ')
        join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[cut + 1:], ' ')
        join totals t on t.lang = c.lang
    ),
    least_cuts as (
        select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
    ),
    insides as (
        select lang, array_to_string(string_split(phrase, ' ')[a:b], ' ') as phrase, f
        from (select *, unnest(range(1, k + 1)) as a from counts where k > 2), lateral (select unnest(range(a + 1, k + 1)) as b)
        where b - a + 1 < k
    ),
    kept as (
        select c.* from least_cuts c left join (select lang, phrase, max(f) as f from insides group by all) i using (lang, phrase)
        where i.f is null or 100 * i.f < 100 * c.a
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from kept qualify rank <= {reported}
    """
