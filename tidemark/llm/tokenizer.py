"""Byte-level BPE over a whole corpus.

Every distinct pre-split word is encoded once, by a higher-order fold that applies the
lowest-ranked merge until none is left; ranks come from a literal map. Documents are dealt to
buckets, and the distinct words of each bucket are joined with their ids: so a frequent word is one
row a bucket, however often it occurs, and each bucket's texts are filled from its own dictionary.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidemark.session import durable, spread

#: White space by the Unicode property, which Java's own class does not follow.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Fixed: the public pre-splitting pattern of byte-level BPE.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Longer words (in bytes) go through a heap instead of the fold, whose time grows with the square of the length.
LONG = 512
_BUCKETS = 8192
_IDS = "array<int>"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@dataclass(frozen=True)
class ByteBpe:
    """Ids of single bytes, and the id that each mergeable pair of ids becomes; a lower id merges first."""

    bytes_: tuple[int, ...]
    pairs: dict[tuple[int, int], int]

    @classmethod
    def read(cls, path: str) -> ByteBpe:
        """From a tokenizer file in the public JSON format; its merges must be numbered in rank order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids) or len(set(ids)) != len(ids):
            raise ValueError("the ids of this vocabulary do not follow the ranks of its merges")
        return cls(tuple(vocab[c] for c in _byte_letters()), {(vocab[a], vocab[b]): i for (a, b), i in zip(merges, ids, strict=True)})

    @cached_property
    def pieces(self) -> dict[int, bytes]:
        """The bytes of every id."""
        out = {i: bytes([b]) for b, i in enumerate(self.bytes_)}
        for (a, b), i in self.pairs.items():
            out[i] = out[a] + out[b]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word by a heap over adjacent pairs: n log n for n bytes."""
        ids: list[int] = [self.bytes_[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue  # one side has been merged meanwhile
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (m := self.pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    # Columns

    @cached_property
    def _ranks(self) -> str:
        buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
        for (a, b), i in self.pairs.items():
            buckets[(a * 31 + b) % _BUCKETS][str(a << 32 | b)] = i
        return json.dumps(buckets, separators=(",", ":"))

    def merged(self, a: Column, b: Column) -> Column:
        """The id that two adjacent ids become, null if they do not merge: a lookup in the literal rank map."""
        ranks = F.from_json(F.lit(self._ranks), "array<map<string,int>>").cast("array<map<bigint,int>>")
        bucket = F.pmod(a * F.lit(31) + b, F.lit(_BUCKETS))
        return F.try_element_at(F.get(ranks, bucket), F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long")))

    def fold(self, word: Column) -> Column:
        """Ids of a word: the lowest rank among adjacent pairs is merged, at its first place, until none is left."""
        codes = F.split(F.lit(",".join(map(str, self.bytes_))), ",").cast(_IDS)
        start = F.transform(F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.get(codes, F.conv(h, 16, 10).cast("int")))
        ranks = lambda ids: F.transform(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda right, i: self.merged(F.get(ids, i), right))
        state = lambda ids, ranked: F.struct(ids.cast(_IDS).alias("ids"), ranked.cast(_IDS).alias("ranks"))

        def step(s: Column, _: Column) -> Column:
            least = F.array_min(s["ranks"])
            at = F.array_position(s["ranks"], least).cast("int")  # 1-based place of the left id
            some = lambda column, start, n: F.slice(column, start, F.greatest(n, F.lit(0)))
            left = F.when(at > 1, F.array(self.merged(F.get(s["ids"], at - 2), least))).otherwise(F.array().cast(_IDS))
            right = F.when(at + 1 < F.size(s["ids"]), F.array(self.merged(least, F.get(s["ids"], at + 1)))).otherwise(F.array().cast(_IDS))
            ids = F.concat(some(s["ids"], F.lit(1), at - 1), F.array(least), some(s["ids"], at + 2, F.size(s["ids"]) - at - 1))
            ranked = F.concat(some(s["ranks"], F.lit(1), at - 2), left, right, some(s["ranks"], at + 2, F.size(s["ranks"]) - at - 1))
            return F.when(least.isNull(), s).otherwise(state(ids, ranked))

        steps = F.slice(start, 2, F.greatest(F.size(start) - 1, F.lit(0)))  # at most one merge less than bytes
        return F.aggregate(steps, state(start, ranks(start)), step, lambda s: s["ids"])

    def decode(self, ids: Column) -> Column:
        """Text of ids; null for null, and bytes that are no UTF-8 show as replacement characters. Unknown ids add nothing."""
        pieces = self.pieces
        table = F.split(F.lit(",".join(pieces.get(i, b"").hex() for i in range(max(pieces) + 1))), ",")
        whole = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
        return F.make_valid_utf8(F.unhex(whole).cast("string"))


def words_of(text: Column) -> Column:
    """Pre-split words in order; their concatenation is the text. Null as the empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def word_ids(words: DataFrame, bpe: ByteBpe) -> DataFrame:
    """``word, ..., ids`` for distinct words; the long ones by a heap in Arrow batches."""
    short = words.where(F.octet_length("word") <= LONG).withColumn("ids", bpe.fold(F.col("word")))

    def heap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [bpe.encode_word(w.encode()) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    long = words.where(F.octet_length("word") > LONG)
    return short.unionByName(long.mapInArrow(heap, f"{', '.join(f'{n} {t}' for n, t in words.dtypes)}, ids {_IDS}"))


def _filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``__key, ids``: buckets come one after the other, each with its dictionary first and then its texts by hash; equal texts of a key once."""
    bucket: int | None = None
    words: list[pa.Array] = []
    ids: list[pa.Array] = []
    known: tuple[pa.Array, pa.Array, np.ndarray] | None = None
    hash_: int | None = None
    keys: set = set()
    for batch in batches:
        of, tag = batch.column("__bucket").to_numpy(), batch.column("__tag").to_numpy()
        cuts = np.flatnonzero((of[1:] != of[:-1]) | (tag[1:] != tag[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if of[a] != bucket:
                bucket, words, ids, known, hash_, keys = int(of[a]), [], [], None, None, set()
            if tag[a] == 0:
                words.append(part.column("word"))
                ids.append(part.column("ids"))
                continue
            if known is None:
                lists = pa.concat_arrays([x for x in ids] or [pa.array([], pa.list_(pa.int32()))])
                known = pa.concat_arrays([x for x in words] or [pa.array([], pa.string())]), lists, pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            hashes = part.column("__hash").to_numpy()
            if hashes[0] == hash_ or (hashes[1:] == hashes[:-1]).any():
                kept = []
                for i, (h, k) in enumerate(zip(hashes.tolist(), part.column("__key").to_pylist(), strict=True)):
                    if h != hash_:
                        hash_, keys = h, set()
                    if k not in keys:
                        keys.add(k)
                        kept.append(i)
                part = part.take(pa.array(kept, pa.int64()))
            else:
                hash_, keys = int(hashes[-1]), {part.column("__key")[-1].as_py()}
            own = part.column("words")
            at = pc.index_in(own.flatten(), value_set=known[0])
            sizes = np.r_[0, np.cumsum(known[2][at.to_numpy(zero_copy_only=False)])].astype(np.int32)
            ends = np.r_[0, np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes[ends]), known[1].take(at).flatten())
            yield pa.RecordBatch.from_arrays([part.column("__key"), lists], ["__key", "ids"])


def encode(documents: DataFrame, bpe: ByteBpe, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """``key, out``: the ids of every text, without special tokens; their spelling is ordinary text.

    A null and an empty text give an empty array. Equal (key, text) rows give one row; a
    key with several texts, or null, keeps a row for each text. Texts are shuffled once; a task
    holds the distinct words of one bucket, and the number of buckets grows with the input.
    """
    docs = documents.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, 2 * docs.rdd.getNumPartitions())
    docs = docs.withColumn("__bucket", F.pmod(F.xxhash64("__key", "__hash"), F.lit(parts)).cast("int"))
    held = durable(spread(docs, "__key").select("__bucket", F.explode(words_of(F.col("__text"))).alias("word")).distinct())
    # few bytes but much work a word: as many tasks as asked for, not as few as the bytes would need
    vocabulary = word_ids(held.select("word").repartition(parts, "word").distinct(), bpe)
    known = held.join(vocabulary, "word").withColumn("__tag", F.lit(0))
    rows = known.unionByName(docs.withColumn("__tag", F.lit(1)), allowMissingColumns=True).repartition(parts, "__bucket").sortWithinPartitions("__bucket", "__tag", "__hash")
    placed = rows.select("__bucket", "__tag", "__key", "__hash", "word", "ids", F.when(F.col("__tag") == 1, words_of(F.col("__text"))).alias("words"))
    schema = StructType([placed.schema["__key"]]).add("ids", ArrayType(IntegerType()))
    return placed.mapInArrow(_filled, schema).select(F.col("__key").alias(key), F.col("ids").alias(out))
