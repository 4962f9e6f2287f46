"""Ranked lexical search by MaxScore with bounds on pairs of terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewell.sources.io import materialize

#: Bytes of item texts that are searched for at once; what is sent to every task is bounded by it.
BLOCK_BYTES = 16_000_000
#: Postings of a shard (a document has at most one for each term of a block of items).
SHARD_POSTINGS = 2_000_000
#: A term's joint maxima are stored with so many of the next lighter terms of an item.
NEIGHBOURS = 3
TOP = 20
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_parts(words: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 for a document of average length, 75 for one without words."""
    if 25 * int(words.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * words * documents // max(1, total)
    return np.array([75 + 25 * w * documents // total for w in words.tolist()], np.int64)


@dataclass(frozen=True)
class Item:
    """Distinct terms of an item, heaviest first, and how often each is in it."""

    terms: np.ndarray
    times: np.ndarray


@dataclass
class Best:
    """The best documents of an item so far, best first."""

    score: np.ndarray
    doc: np.ndarray

    def add(self, score: np.ndarray, doc: np.ndarray, k: int) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[:k]
        self.score, self.doc = score[order], doc[order]

    def least(self, k: int) -> int:
        """What a score must reach."""
        return int(self.score[k - 1]) if len(self.score) >= k else 0


class Shard:
    """Postings of some documents: for each term its documents in order, their impacts and the
    largest of them; for stored pairs of terms the largest joint impact of the documents in the
    intersection of both lists, and the k-th largest."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, rows: int, size: int):
        order = np.lexsort((docs, terms))
        terms, self.docs, self.impacts = terms[order], docs[order], impacts[order]
        self.rows = rows
        self.first = np.searchsorted(terms, np.arange(size + 1)).tolist()
        self.most = np.zeros(size, np.int64)
        if len(terms):
            start = np.nonzero(np.diff(terms, prepend=-1))[0]
            self.most[terms[start]] = np.maximum.reduceat(self.impacts, start)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.first[term], self.first[term + 1]
        return self.docs[lo:hi], self.impacts[lo:hi]

    def found(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The impact of a term on each of the documents, 0 where it is not in one."""
        own, impact = self.of(term)
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, impact[at], 0)

    def pairs(self, wanted: Sequence[tuple[int, int]], k: int) -> dict[tuple[int, int], tuple[int, int]]:
        """For each pair of terms of the shard, its joint maximum (0 if no document has both) and
        its k-th largest joint impact (0 if fewer have both)."""
        stored = {}
        for a, b in wanted:
            if not self.most[a] or not self.most[b]:
                continue
            few, many = (a, b) if self.first[a + 1] - self.first[a] <= self.first[b + 1] - self.first[b] else (b, a)
            docs, impact = self.of(few)
            other = self.found(many, docs)
            joint = (impact + other)[other > 0]
            kth = int(np.partition(joint, len(joint) - k)[len(joint) - k]) if len(joint) >= k else 0
            stored[a, b] = int(joint.max(initial=0)), kth
        return stored


def neighbours(item: Item) -> list[tuple[int, int]]:
    """The pairs of an item whose joint maxima are stored."""
    t = item.terms.tolist()
    return [(t[i], t[j]) for i in range(len(t)) for j in range(i + 1, min(i + 1 + NEIGHBOURS, len(t)))]


def bounds(shard: Shard, item: Item, stored: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """Parts of the item's terms with a bound on what each can add to a document, least first.

    A pair's bound is its joint maximum, or the larger of the two where only one is in a document.
    Pairs that gain most over the sum of both are taken first, each term into one part.
    """
    times = dict(zip(item.terms.tolist(), item.times.tolist(), strict=True))
    single = {t: c * int(shard.most[t]) for t, c in times.items() if shard.most[t]}
    gains = []
    for a, b in neighbours(item):
        if (a, b) in stored:
            both = min(times[a], times[b])
            joint = both * stored[a, b][0]
            joint += (times[a] - both) * int(shard.most[a]) + (times[b] - both) * int(shard.most[b])
            bound = min(max(joint, single[a], single[b]), single[a] + single[b])
            gains.append((bound - single[a] - single[b], bound, a, b))
    parts, free = [], set(single)
    for gain, bound, a, b in sorted(gains):
        if gain < 0 and a in free and b in free:
            free -= {a, b}
            parts.append((bound, [a, b]))
    parts += [(single[t], [t]) for t in free]
    return sorted(parts)


def search(shard: Shard, item: Item, stored: dict, ids: np.ndarray, best: Best, k: int) -> int:
    """Add the shard's documents that may be among the ``k`` best; returns how many were scored.

    Documents that have only terms of the lightest parts, whose bounds sum to less than the score
    to reach, are never looked at. Of the others, those that can't reach it any more are given up
    part by part.
    """
    parts = bounds(shard, item, stored)
    if not parts:
        return 0
    times = dict(zip(item.terms.tolist(), item.times.tolist(), strict=True))
    # k documents have at least a pair's k-th joint impact.
    need = max([best.least(k), 1, *[stored[p][1] for p in neighbours(item) if p in stored]])
    below = np.concatenate([[0], np.cumsum([b for b, _ in parts])])
    needed = int(np.searchsorted(below, need)) - 1  # parts before it can't reach the score alone
    total = np.zeros(shard.rows, np.int64)
    for _, terms in parts[needed:]:
        for t in terms:
            docs, impact = shard.of(t)
            total[docs] += times[t] * impact
    near = np.nonzero(total)[0]
    scored = len(near)
    for i in range(needed - 1, -1, -1):
        near = near[total[near] + below[i + 1] >= need]
        for t in parts[i][1]:
            total[near] += times[t] * shard.found(t, near)
    near = near[total[near] >= need]
    best.add(total[near], ids[near], k)
    return scored


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the number of them in each row."""
    sizes = np.diff(np.asarray(column.offsets))
    return np.asarray(column.flatten(), np.int64), sizes


@dataclass(frozen=True)
class Plan:
    """A block of items, the weights of their terms, and what the table's totals are."""

    items: list[Item]
    weights: np.ndarray
    documents: int
    words: int

    def pairs(self) -> list[tuple[int, int]]:
        return sorted({p for item in self.items for p in neighbours(item)})

    def shard(self, words: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> Shard:
        part = length_parts(words, self.documents, self.words)
        doc = np.repeat(np.arange(len(words)), sizes)
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * part[doc]))
        return Shard(term, doc, impact, len(words), len(self.weights))


def _forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): every document with its number of terms, and of the terms known
    their numbers and how often each is in it."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, term, tf = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                times = Counter(map(number, words))
                times.pop(None, None)
                n.append(len(words))
                term.append(list(times))
                tf.append(list(times.values()))
            kinds = pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
            made = [pa.array(x, kind) for x, kind in zip((n, term, tf), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(each, "doc_id long, n long, term array<int>, tf array<long>")


def _best(forward: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best documents of each item in each task."""
    shared = forward.sparkSession.sparkContext.broadcast(plan)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[tuple[np.ndarray, ...]] = []
        postings = 0
        for batch in batches:
            lo = 0
            term, sizes = _lists(batch["term"])
            tf, _ = _lists(batch["tf"])
            # A null id is the largest: it comes last among equal scores.
            ids = np.asarray(batch["doc_id"].fill_null(np.iinfo(np.int64).max), np.int64)
            words = np.asarray(batch["n"], np.int64)
            ends = sizes.cumsum()
            while lo < len(ids):
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARD_POSTINGS - postings, side="right"))
                hi = min(max(hi, lo + 1), len(ids))
                a, b = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
                held.append((ids[lo:hi], words[lo:hi], term[a:b], tf[a:b], sizes[lo:hi]))
                postings += b - a
                lo = hi
                if postings >= SHARD_POSTINGS:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, postings = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        wanted = plan.pairs()
        none = np.zeros(0, np.int64)
        best = [Best(none, none) for _ in plan.items]
        for ids, words, term, tf, sizes in shards(batches):
            shard = plan.shard(words, term, tf, sizes)
            stored = shard.pairs(wanted, k)
            for item, found in zip(plan.items, best, strict=True):
                search(shard, item, stored, ids, found, k)
        for lo in range(0, len(best), 1000):
            some = best[lo : lo + 1000]
            item = np.repeat(np.arange(lo, lo + len(some)), [len(b.doc) for b in some])
            doc = np.concatenate([b.doc for b in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc, mask=doc == np.iinfo(np.int64).max), pa.array(np.concatenate([b.score for b in some]))],
                ["item", "doc_id", "score"],
            )

    return forward.select("doc_id", "n", "term", "tf").mapInArrow(each, "item int, doc_id long, score long")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): of all documents the ``k`` with the highest score above 0
    for each item, equal scores by smaller doc_id, a null one last.

    A document's score for a term that is in an item c times and in the document tf times is
    c w ((1000000000 tf) div (1000 tf + 12 m)), with the weight w of rare terms and m for its
    length. Null and empty texts have no term: such documents are found by no item, such items
    find none. Repeated documents are ranked each; repeated items are one, an item_id with several
    texts is an item for each. No documents or no items give no rows. Other columns are not read.

    Texts are read once for each block of items, blocks being dealt by their bytes: what a
    document has of a block's terms is written, then scored in shards of bounded size. A task
    takes its shards one after the other and keeps the best of all.
    """
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("binary").alias("text"))
    asked = materialize(asked.filter("octet_length(text) > 0").distinct(), "search-items")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    result = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    result = result.withColumn("item_id", F.col("item_id").cast(item_kind))
    for block in range(blocks):
        dealt = F.pmod(F.xxhash64("text"), F.lit(blocks)) == block
        rows = asked.filter(dealt).orderBy("item_id", "text").collect()  # bounded by BLOCK_BYTES
        result = result.unionByName(_rank_block(texts, [(r["item_id"], bytes(r["text"])) for r in rows], item_kind, k))
    return result


def _rank_block(texts: DataFrame, rows: list[tuple], item_kind, k: int) -> DataFrame:
    spark = texts.sparkSession
    words = [Counter(terms_of(text)) for _, text in rows]
    known = {t: i for i, t in enumerate(sorted(set().union(*words)))}
    forward = materialize(_forward(texts, known), "search-forward")
    documents, total = forward.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)  # as many as terms of the block
    for term, held in forward.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[term] = held
    weights = np.array([weight(documents, int(d)) for d in df], np.int64)
    made = []
    for of in words:
        terms = np.array([known[t] for t in of], np.int64)
        order = np.lexsort((terms, -weights[terms]))
        made.append(Item(terms[order], np.array(list(of.values()), np.int64)[order]))
    found = _best(forward, Plan(made, weights, documents, total), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(rows)], f"item int, item_id {item_kind.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
with terms_of_docs as (
    select doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
), lengths as (
    select doc_id, count(*) as n from terms_of_docs group by doc_id
), totals as (
    select count(*) as docs, cast(sum(n) as bigint) as words from lengths
), parts as (
    select doc_id, 75 + (25 * n * docs) // words as m from lengths, totals
), postings as (
    select term, doc_id, count(*) as tf from terms_of_docs group by all
), weights as (
    select term, cast(floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1))) as bigint) as w
    from postings, totals group by term
), asked as (
    select item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), scores as (
    select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
    from asked join weights using (term) join postings using (term) join parts using (doc_id)
    group by item_id, doc_id
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank,
       doc_id, score
from scores where score > 0
qualify rank <= 20
"""
