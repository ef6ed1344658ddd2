"""Evaluation texts inside a corpus, by spaced seeds and substitution-tolerant verification.

A seed is a fixed mask over word positions: three words that count, and others between them
that are ignored. Seeds are hashed by their counting words alone, so that a changed, an
inserted and a dropped word each leave seeds that still meet. The seeds of all test items and
those of all documents are joined by their hash; pairs with enough common seeds are verified
by the longest common word sequence around the hits: of all of the item's words, and of those
that few items have, so that stock phrases alone prove nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tidemark.llm.prose import UNSPACED
from tidemark.operators.skew import salted_join
from tidemark.session import durable, spread

#: Word positions that count (1) and that are ignored (0).
MASKS = ("111", "1101", "1011", "10101")
#: Share of an item's seeds that a document must hold before the two are compared (one seed at least). A third of the
#: item keeps a third of its seeds, and a tenth of those if every other word of it is changed.
MIN_HITS = 0.03
#: Share of an item's words, and of its rare words, that a document must hold in their order; and words at least.
MIN_WORDS, MIN_RARE, LEAST_WORDS = 1 / 3, 1 / 3, 3
#: A word is rare if at most this share of all items (or two of them) has it; items that share half of their seeds count as one.
RARE, ALIKE = 0.025, 0.5
#: Least hashes by which items that may be alike are brought together.
BANDS = 8
#: Bits of the filter that spares documents' seeds the join: per seed of the items, and in all. A full filter lets everything pass to the join.
FILTER_BITS, MOST_BITS = 512, 1 << 27
#: Hashes of words a worker keeps; beyond that it starts afresh.
CACHE = 1_000_000

_GONE = dict.fromkeys([0xAD, 0xFEFF, 0x2060, *range(0x200B, 0x2010)])
_WORD = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])[^\W_])+")
_LONGS = ArrayType(LongType())
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words without case, accents, width forms, invisible characters, marks and line layout; letters of unspaced scripts singly."""
    if not text:
        return []
    text = text.translate(_GONE)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hash of a word, kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def common_length(own: dict[int, int], n: int, other: Iterable[int]) -> int:
    """Length of the longest common subsequence; ``own`` maps a word to the bits of its n places (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for w in other:
        m = own.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places(ids: Sequence[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counting words at each start (uint64); which positions were ignored does not enter it."""
    m = len(ids) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                out = (out ^ ids[i : i + m]) * _PRIME
                out ^= out >> np.uint64(29)
    return out


def item_seeds(ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Distinct seeds that hold a rare word; all seeds of an item without rare words."""
    out = []
    for mask in MASKS:
        own = seed_hashes(ids, mask)
        if len(own):
            kept = np.zeros(len(own), bool)
            for i, c in enumerate(mask):
                if c == "1":
                    kept |= rare[i : i + len(own)]
            out.append(own[kept] if rare.any() else own)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


class Passage:
    """An item ready for comparison: its seeds, and the places of its words and of its rare words."""

    def __init__(self, ids: np.ndarray, rare: np.ndarray) -> None:
        self.n, some = len(ids), ids[rare].tolist()
        self.seeds, self.all = item_seeds(ids, rare), places(ids.tolist())
        self.rare, self.few = places(some), len(some)

    def shares(self, document: np.ndarray) -> tuple[float, float]:
        """The largest shares of the item's words and of its rare words that stand in their order around common seeds."""
        near = np.zeros(len(document) + 1, np.int64)  # starts and ends of what lies within an item's length of a hit
        for mask in MASKS:
            own = seed_hashes(document, mask)
            at = np.flatnonzero(self.seeds[np.minimum(np.searchsorted(self.seeds, own), len(self.seeds) - 1)] == own)
            np.add.at(near, np.maximum(at - self.n, 0), 1)
            np.add.at(near, np.minimum(at + len(mask) + self.n, len(document)), -1)
        inside = np.cumsum(near[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        best = (0.0, 0.0)
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            part = [w for w in document[a:b].tolist() if w in self.all]
            n = common_length(self.all, self.n, part)
            if n >= LEAST_WORDS and n >= MIN_WORDS * self.n:
                share = n / self.n
                best = max(best, (share, common_length(self.rare, self.few, part) / self.few if self.few else share), key=min)
        return best


#: Texts that are looked through at once, bounded by their characters.
BATCH_TEXTS, BATCH_CHARACTERS = 500, 2_000_000


def pieces_of(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are looked through together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin >= BATCH_TEXTS or size + len(t or "") > BATCH_CHARACTERS):
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(parts: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(np.concatenate([*parts, np.zeros(0, np.uint64)])))


def _rows_of(column: pa.ListArray) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _word_hashes(items: DataFrame) -> DataFrame:
    """``__row, __item, words``: the words of each item as hashes, in order; items of fewer than LEAST_WORDS words are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            ids = [np.array([known[w] for w in words(t)], np.uint64) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__item"), _lists(ids)], ["__row", "__item", "words"])

    schema = StructType([items.schema["__row"], items.schema["__item"]]).add("words", _LONGS)
    return items.mapInArrow(run, schema).where(F.size("words") >= LEAST_WORDS)


def _all_seeds(rows: DataFrame) -> DataFrame:
    """``__row, seed``: distinct seeds of contiguous words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(seed_hashes(x.view(np.uint64), MASKS[0])) for x in _rows_of(batch.column("words"))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), _lists(own)], ["__row", "seeds"])

    return rows.select("__row", "words").mapInArrow(run, "__row long, seeds array<long>").select("__row", F.explode("seeds").alias("seed"))


def families(rows: DataFrame) -> DataFrame:
    """``__row, family``: near-copies of an item under one number, so that their common words do not pass for stock phrases.

    Items are brought together by the least of their hashed seeds, BANDS times over, each with the
    group's smallest number only, and count as one if they share at least ALIKE of their seeds.
    """
    seeds = durable(_all_seeds(rows))
    least = seeds.groupBy("__row").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.xxhash64("seed", F.lit(j))).alias(f"m{j}") for j in range(BANDS)])
    bands = least.select("__row", F.posexplode(F.array(*[f"m{j}" for j in range(BANDS)])).alias("band", "least"))
    first = bands.groupBy("band", "least").agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    asked = salted_join(bands.withColumn("at", F.xxhash64("band", "least")), first.select(F.xxhash64("band", "least").alias("at"), "first"), "at", "__row", small=True).where("__row <> first").select("__row", "first").distinct()
    theirs = seeds.select(F.col("__row").alias("first"), "seed")
    both = asked.join(seeds, "__row").join(theirs, ["first", "seed"]).groupBy("__row", "first").agg(F.count(F.lit(1)).alias("shared"))
    n = least.select("__row", "n")
    both = both.join(n, "__row").join(n.select(F.col("__row").alias("first"), F.col("n").alias("m")), "first")
    alike = both.where(F.col("shared") >= ALIKE * (F.col("n") + F.col("m") - F.col("shared"))).groupBy("__row").agg(F.min("first").alias("first"))
    return rows.select("__row").join(alike, "__row", "left").select("__row", F.coalesce(F.least("first", "__row"), "__row").alias("family"))


def with_rare(rows: DataFrame) -> DataFrame:
    """The rows of the items with ``rare``: whether few of all items have the word at each place."""
    own = families(rows)
    at = rows.join(own, "__row").select("__row", "family", F.posexplode("words").alias("place", "word"))
    total = own.agg(F.count_distinct("family")).scalar()
    having = at.select("family", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("having"))
    having = having.select("word", (F.col("having") <= F.greatest(F.lit(2.0), RARE * total)).alias("rare"))
    marked = salted_join(at.select("__row", "place", "word"), having, "word", "__row", small=True)
    listed = marked.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("place", "rare"))).alias("r")).select("__row", F.col("r")["rare"].alias("rare"))
    return rows.join(listed, "__row")


def indexed(rows: DataFrame) -> DataFrame:
    """``__row, need, seed``: the seeds by which an item is looked for, and how many of them a document must hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(_rows_of(batch.column("words")), _rows_of(batch.column("rare")), strict=True)
            own = [(x := item_seeds(w.view(np.uint64), r), max(1, -int(-MIN_HITS * len(x) // 1))) for w, r in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array([k for _, k in own], pa.int32()), _lists([s for s, _ in own])], ["__row", "need", "seeds"])

    return rows.select("__row", "words", "rare").mapInArrow(run, "__row long, need int, seeds array<long>").select("__row", "need", F.explode("seeds").alias("seed"))


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for the lower and one for the upper half of every seed, as words of 64 bits: at most MOST_BITS / 64 numbers, whatever the items."""
    count = seeds.count()
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (count * FILTER_BITS).bit_length()))
    at = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 AS int))")
    rows = at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _passes(filter_: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    most, six = np.uint64(len(filter_) * 64 - 1), np.uint64(6)
    ok = np.ones(len(seeds), bool)
    for half in (seeds, seeds >> np.uint64(32)):
        bit = half & most
        ok &= (filter_[bit >> six] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return ok


def probed(corpus: DataFrame, filter_: np.ndarray) -> DataFrame:
    """``__key, __doc, words, seeds``: documents with a seed that passes the filter, their words as hashes, and those seeds."""
    shared = corpus.sparkSession.sparkContext.broadcast(filter_)
    gap = max(map(len, MASKS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = _Hashes(), shared.value
        for batch in batches:
            found = batch.column("__text").to_pylist()
            for a, b in pieces_of(found):
                flat: list[int] = []
                starts = [0]
                for t in found[a:b]:
                    flat += [known[w] for w in words(t)]
                    starts.append(len(flat))
                ids, ends = np.array(flat, np.uint64), np.array(starts, np.int64)
                text, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for mask in MASKS:
                    own = seed_hashes(ids, mask)
                    at = np.flatnonzero(_passes(bits, own))
                    of = np.searchsorted(ends, at, "right") - 1
                    inside = at + len(mask) <= ends[of + 1]  # no seed spans two texts
                    text.append(of[inside])
                    seed.append(own[at[inside]])
                of, hit = np.concatenate(text), np.concatenate(seed)
                order = np.lexsort((hit, of))
                of, hit = of[order], hit[order]
                fresh = np.r_[True, (of[1:] != of[:-1]) | (hit[1:] != hit[:-1])][: len(of)]
                of, hit = of[fresh], hit[fresh]
                docs, first = np.unique(of, return_index=True)
                where = pa.array(docs + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key").take(where), batch.column("__doc").take(where), _lists([ids[ends[d] : ends[d + 1]] for d in docs]), _lists(np.split(hit, first[1:]) if len(docs) else [])],
                    ["__key", "__doc", "words", "seeds"],
                )

    schema = StructType([corpus.schema["__key"]]).add("__doc", "long").add("words", _LONGS).add("seeds", _LONGS)
    return corpus.mapInArrow(run, schema)


#: Pairs that one task compares, about.
PAIRS_A_TASK = 20_000
#: Items that a worker keeps ready for comparison.
READY = 10_000


def verified(pairs: DataFrame) -> DataFrame:
    """``__key, __item, share, rare_share`` of the pairs that hold enough of the item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Passage] = {}
        for batch in batches:
            got = []
            for row, d, w, r in zip(batch.column("__row").to_pylist(), *(_rows_of(batch.column(c)) for c in ("document", "words", "rare")), strict=True):
                if row not in ready:
                    if len(ready) >= READY:
                        ready.clear()
                    ready[row] = Passage(w.view(np.uint64), r)
                got.append(ready[row].shares(d.view(np.uint64)))
            both = np.array(got, np.float64).reshape(-1, 2)
            kept = np.flatnonzero((both[:, 0] >= MIN_WORDS) & (both[:, 1] >= MIN_RARE))
            where = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(where), batch.column("__item").take(where), pa.array(both[kept, 0]), pa.array(both[kept, 1])], ["__key", "__item", "share", "rare_share"])

    schema = StructType([pairs.schema["__key"], pairs.schema["__item"]]).add("share", "double").add("rare_share", "double")
    return pairs.select("__row", "__key", "__item", "document", "words", "rare").mapInArrow(run, schema)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text") -> DataFrame:
    """``key, item, share, rare_share``: each document with each item of which it holds a passage, once.

    A passage is at least MIN_WORDS of the item's words in their order, with or without
    gaps, whatever their case, accents, marks and layout, at least MIN_RARE of its rare
    words, and LEAST_WORDS words. Which words are rare follows from all items. Null, empty and
    too short texts and items leak nothing. Documents and items of a null key are kept under null.

    Seeds of documents and items meet in one hash join, salted by document, as a copied text may
    hold a third of all rows; pairs are counted on the map side, and only those with enough
    common seeds are joined with their words again.
    """
    test = items.select(F.col(item).alias("__item"), F.col(passage).alias("__text")).where(F.col("__text").isNotNull()).withColumn("__row", F.xxhash64("__item", "__text")).distinct()
    known = durable(with_rare(durable(_word_hashes(test))))
    seeds = durable(indexed(known))
    corpus = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull()).withColumn("__doc", F.xxhash64("__key", "__text"))
    found = durable(probed(spread(corpus, "__key"), seed_filter(seeds.select("seed").distinct())))
    hits = salted_join(found.select("__doc", F.explode("seeds").alias("seed")), seeds, "seed", "__doc", small=True)
    pairs = durable(hits.groupBy("__doc", "__row").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("__doc", "__row"))
    parts = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS_A_TASK)
    both = salted_join(pairs, known, "__row", "__doc", small=True).repartition(parts, "__doc")
    whole = both.join(found.select("__doc", "__key", F.col("words").alias("document")), "__doc")
    merged = verified(whole).groupBy("__key", "__item").agg(F.max("share").alias("share"), F.max("rare_share").alias("rare_share"))
    return merged.select(F.col("__key").alias(key), F.col("__item").alias(item), "share", "rare_share")
