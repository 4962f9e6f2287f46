"""Phrase collocations: counts of short phrases from an FM-index over the word ids of each shard,
summed over the shards, and scored by how often their parts come together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewell.sources.io import materialize

LONGEST, LEAST, COVERED_PERCENT, TOP = 3, 10, 50, 2000
#: Words of a shard. A text is cut at the ends of its pieces, so only a piece without any mark
#: that is longer than this makes a shard larger.
SHARD_WORDS = 1_000_000
#: Bytes of a text that are split into words at once.
CUT_BYTES = 4_000_000
#: Bits of the filter of frequent phrases, as a power of two: 64 MB at most, whatever their number.
LEAST_BITS, MOST_BITS = 15, 29
#: Parts into which a language's phrases are dealt before its first ones are taken.
RANK_PARTS = 64
UNKNOWN = "und"
_END = 255  # a byte that no UTF-8 text holds
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = _END
_FOLD = bytes(_FOLD)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with ``b"\\xff"`` at the ends of pieces, in runs that end with one."""
    text = text.translate(_FOLD) + b"\xff"
    at = 0
    while at < len(text):
        cut = text.rfind(b"\xff", at, at + CUT_BYTES) + 1
        if cut <= at:
            cut = text.find(b"\xff", at) + 1
        yield text[at:cut].replace(b"\xff", b" \xff ").split()
        at = cut


class Ids(dict):
    """Numbers of words from 1, made as they come; 0 is the end of a piece."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({b"\xff": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        number = self[word] = len(self.names)
        return number


def word_hashes(names: Sequence[tuple[str, bytes]]) -> np.ndarray:
    """Spark's ``xxhash64(lang, word)`` of each word."""
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in {x for x, _ in names}}
    return np.array([xxhash.xxh64_intdigest(word, seeds[lang]) for lang, word in names], np.uint64)


# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def fold_hashes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Spark's ``xxhash64`` of an array of numbers, for many arrays: column i holds their i-th."""
    h = np.full(len(columns[0]), 42, np.uint64)
    for x in columns:
        h = (h + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    return h


@dataclass(frozen=True)
class Filter:
    """Bits set at the hashes of phrases; a phrase whose bit is not set is not frequent."""

    bits: np.ndarray
    power: int

    def has(self, words: Sequence[np.ndarray]) -> np.ndarray:
        """For phrases whose i-th words have the hashes of column i."""
        at = fold_hashes(words) & np.uint64((1 << self.power) - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(phrases: DataFrame, rows: int) -> Filter:
    """The filter of the ``rows`` rows (lang, phrase). What is collected are its bits, at most
    two to the power of ``MOST_BITS``."""
    power = min(MOST_BITS, max(LEAST_BITS, int(16 * rows).bit_length()))
    words = F.transform(F.split("phrase", " "), lambda w: F.xxhash64("lang", w))
    at = F.xxhash64(words).bitwiseAND(F.lit((1 << power) - 1)) + 1  # buckets count from 1
    bits = phrases.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
    bits = bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    held = bytearray((1 << power) // 8)
    for bucket, part in bits.collect():
        held[(bucket - 1) * len(part) : bucket * len(part)] = part
    return Filter(np.frombuffer(bytes(held), np.uint8), power)


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of whole numbers from 0: where key and place fit into one number, that is
    sorted, which is many times faster."""
    bits = max(1, len(keys) - 1).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    both = keys.astype(np.int64) << bits | np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1)


class Half:
    """One direction of an index over the ids: suffixes in the order of their first ``depth``
    symbols, the symbol before each (the BWT), and where each row goes when that is put before it."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        # The order by d + 1 symbols is that by d, one position earlier, sorted stably by symbol.
        order = np.arange(n)
        for _ in range(depth):
            order = order - 1
            order[order < 0] += n
            order = order[_order(ids[order])]
        self.before = np.roll(ids, 1)[order]
        self.goes = np.empty(n, np.int32)
        self.goes[_order(self.before)] = np.arange(n, dtype=np.int32)


@dataclass(frozen=True)
class Intervals:
    """Phrases of one length: ``words`` (a row each), the number of occurrences, and the first
    row of each phrase's interval in the index of the text and in that of the reversed text."""

    words: np.ndarray
    count: np.ndarray
    ahead: np.ndarray
    back: np.ndarray

    def only(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.words[keep], self.count[keep], self.ahead[keep], self.back[keep])


class Index:
    """A bidirectional FM-index over word ids, for phrases of up to ``depth`` words and their
    extensions by one. 0 is no word: it ends a piece and is in no phrase."""

    def __init__(self, ids: np.ndarray, depth: int):
        ids = np.concatenate([np.zeros(1, ids.dtype), ids])  # cyclic, so one end is needed
        self.ids = ids[(ids > 0) | (np.roll(ids, 1) > 0) | (np.arange(len(ids)) == 0)]
        self.depth = depth

    @cached_property
    def ahead(self) -> Half:
        return Half(self.ids, self.depth)

    @cached_property
    def back(self) -> Half:
        return Half(self.ids[::-1], self.depth)

    def single(self) -> Intervals:
        counts = np.bincount(self.ids)
        first = counts.cumsum() - counts
        words = np.nonzero(counts)[0]
        words = words[words > 0]
        return Intervals(words[:, None], counts[words], first[words], first[words])

    def left(self, of: Intervals) -> Intervals:
        """All phrases that are one of ``of`` with a word before it."""
        which, word, count, first, less = _extend(self.ahead, of.ahead, of.count)
        words = np.concatenate([word[:, None], of.words[which]], 1)
        return Intervals(words, count, first, of.back[which] + less)

    def right(self, of: Intervals) -> Intervals:
        """All phrases that are one of ``of`` with a word after it."""
        which, word, count, first, less = _extend(self.back, of.back, of.count)
        words = np.concatenate([of.words[which], word[:, None]], 1)
        return Intervals(words, count, of.ahead[which] + less, first)


def _extend(half: Half, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every interval and every word in its part of the BWT: the interval's number, the word,
    how often it is there, the first row of the extended phrase, and how many symbols of the
    interval are less, by which the interval of the other direction moves."""
    which = np.repeat(np.arange(len(first)), count)
    start = count.cumsum() - count
    rows = np.arange(len(which)) - np.repeat(start - first, count)
    symbol = half.before[rows]
    size = int(symbol.max(initial=0)) + 1
    order = _order(which * size + symbol)  # stable: the first row of a run is its first in the BWT
    sym, of = symbol[order], which[order]
    new = np.ones(len(order), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (of[1:] != of[:-1])
    at = np.nonzero(new)[0]
    times = np.diff(np.append(at, len(order)))
    word = sym[at] > 0
    at, times = at[word], times[word]
    return of[at], sym[at], times, half.goes[rows[order[at]]], at - start[of[at]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[str, bytes]]]]:
    """Word ids of whole pieces, about ``SHARD_WORDS`` at a time, and the names of the ids."""
    names: list[tuple[str, bytes]] = []
    ids: dict[str, Ids] = {}
    runs: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            of = ids.get(lang)
            if of is None:
                of = ids[lang] = Ids(lang, names)
            for words in words_of(text.as_py()):
                runs.append(np.fromiter(map(of.__getitem__, words), np.int32, len(words)))
                held += len(words)
            if held >= SHARD_WORDS:
                yield np.concatenate(runs), names
                names, ids, runs, held = [], {}, [], 0
    if held:
        yield np.concatenate(runs), names


def _rows(found: Intervals, names: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    lang, word = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.binary())
    for lo in range(0, len(found.count), 65_536):
        words = found.words[lo : lo + 65_536] - 1
        parts = [word.take(pa.array(words[:, k])) for k in range(words.shape[1])]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())).cast(pa.string())
        columns = [lang.take(pa.array(words[:, 0])), phrase, pa.array(found.count[lo : lo + 65_536].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])


def _summed(counts: DataFrame, least: int, stem: str) -> DataFrame:
    """Counts summed over the shards; those of at least ``least`` stay."""
    total = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialize(total.filter(F.col("f") >= least), stem)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the words of each shard, and of all of them with a null phrase."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names in _shards(batches):
            counts = np.bincount(ids, minlength=len(names) + 1)[1:]
            words = np.arange(1, len(names) + 1)[:, None]
            yield from _rows(Intervals(words, counts, counts, counts), names)
            total: dict[str, int] = {}
            for (lang, _), n in zip(names, counts.tolist(), strict=True):
                total[lang] = total.get(lang, 0) + n
            columns = [pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    return texts.mapInArrow(each, "lang string, phrase string, f long")


def _phrase_counts(texts: DataFrame, length: int, filters: list[Filter]) -> DataFrame:
    """(lang, phrase, f) of phrases of ``length`` words in each shard, of those whose words and
    shorter phrases the filters know, one filter for each length below ``length``."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for ids, names in _shards(batches):
            hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(names)])
            has = lambda words, of: known[of].has([hashes[w] for w in words.T])
            frequent = has(np.arange(len(hashes))[:, None], 0)
            frequent[0] = False
            index = Index(np.where(frequent[ids], ids, 0), length - 1)
            found = index.single()
            for n in range(2, length + 1):
                # To the left and to the right in turn, from phrases that are frequent themselves.
                found = index.left(found) if n % 2 == 0 else index.right(found)
                if n < length:
                    found = found.only(has(found.words, n - 1))
            if length > 2:  # and the part that the last step put together
                part = found.words[:, 1:] if length % 2 else found.words[:, :-1]
                found = found.only(has(part, length - 2))
            yield from _rows(found, names)

    return texts.mapInArrow(each, "lang string, phrase string, f long")


def counts(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for every length from 1 to ``longest`` the table (lang, phrase,
    f) of the phrases with f of at least ``least``.

    A phrase occurs at most as often as any part of it, so a shard counts only phrases whose
    words and shorter phrases are frequent over all shards; that is known from a filter of bits
    which lets some others through, but leaves none out. Counts are exact.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(lang, F.col(f"`{text_col}`").cast("binary").alias("text"))
    words = _word_counts(texts).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = materialize(words.filter((F.col("f") >= least) | F.col("phrase").isNull()), "phrases-words")
    total = words.filter("phrase is null").select("lang", F.col("f").alias("n"))
    tables, filters = [words.filter("phrase is not null")], []
    for length in range(2, longest + 1):
        filters.append(filter_of(tables[-1], tables[-1].count()))
        tables.append(_summed(_phrase_counts(texts, length, filters), least, f"phrases-{length}"))
    return total, tables


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    A phrase is 2 to ``longest`` words of one piece of a text, ``a`` its occurrences, ``n`` all
    words of the language, ``l`` and ``r`` the occurrences of its two parts at the cut that scores
    least: the whole part of 1,000,000 a a / (l r), ties to the shorter first part. Phrases rarer
    than ``least`` are left out, and those inside a longer one that has ``covered`` percent of
    their occurrences or more. Order: score, a, descending; phrase in byte order.

    A null language is ``und``. Null and empty texts have no words. Repeated rows count each. No
    rows, or no frequent phrase, give no rows. Other columns are not read. Texts are read once for
    each length; a very long text is split at the ends of its pieces.
    """
    total, tables = counts(docs, lang_col, text_col, longest, least)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    wide = [t.withColumn("words", F.lit(k)) for k, t in enumerate(tables[1:], 2)]
    schema = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    if not wide:
        return docs.sparkSession.createDataFrame([], schema)
    found = wide[0]
    for t in wide[1:]:
        found = found.unionByName(t)

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # 15 digits for a count: products of two and the factor have at most 38.
    wide_of = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * (wide_of("a") * wide_of("a")))
    cuts = cuts.withColumn("under", wide_of("l") * wide_of("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = None  # the most occurrences of a longer phrase that holds it
    for words, table in enumerate(tables[2:], 3):
        for size in range(2, words):
            for begin in range(words - size + 1):
                held = f"substring_index(substring_index(phrase, ' ', {begin + size}), ' ', -{size})"
                rows = table.select("lang", F.expr(held).alias("phrase"), F.col("f").alias("longer"))
                inside = rows if inside is None else inside.unionByName(rows)
    if inside is not None:
        inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left")
        enough = F.lit(100) * F.col("longer") >= F.lit(covered) * F.col("a")
        scored = scored.filter(~F.coalesce(enough, F.lit(False)))

    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = scored.withColumn("part", parts)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    near = near.filter(F.col("rank") <= top).drop("rank", "part")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= top).join(total, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, row_number() over () as doc,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), split as (
    select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces
), grams as (
    select lang, k as words, unnest(list_transform(range(1, len(words) - k + 2),
                                                   lambda i: array_to_string(words[i:i + k - 1], ' '))) as phrase
    from split, (values (1), (2), (3)) sizes(k)
    where len(words) >= k
), counted as (
    select lang, words, phrase, count(*) as f from grams group by all
), total as (
    select lang, sum(f) as n from counted where words = 1 group by lang
), candidates as (
    select lang, words, phrase, f as a, string_split(phrase, ' ') as w from counted where words >= 2 and f >= 10
), cuts as (
    select c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') as first_part,
           array_to_string(w[k + 1:], ' ') as rest
    from candidates c, (values (1), (2)) cut(k) where k < c.words
), scores as (
    select cuts.lang, cuts.phrase, a, k, x.f as l, y.f as r,
           (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score
    from cuts join counted x on x.lang = cuts.lang and x.phrase = first_part and x.words = k
    join counted y on y.lang = cuts.lang and y.phrase = rest
), lowest as (
    select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
    select lang, phrase, max(a) as most from (
        select lang, array_to_string(w[1:2], ' ') as phrase, a from candidates where words = 3
        union all select lang, array_to_string(w[2:3], ' '), a from candidates where words = 3)
    group by all
), kept as (
    select lowest.* from lowest left join longer using (lang, phrase)
    where most is null or 100 * most < 50 * a
)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as int) as rank,
       phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from kept join total using (lang)
qualify rank <= 2000
"""
