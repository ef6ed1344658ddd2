"""Language of documents and of their segments by hyperdimensional profiles.

Every letter has a random +-1 vector. The vector of an n-gram binds (multiplies) its
letters' vectors, each rotated by its place; a text's vector bundles (adds) those of its
n-grams. A language is the bundle of labelled texts; texts are compared with the
languages by cosine, after the mean of all languages is taken off both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prose import sentences
from tidemark.session import durable, spread

#: Length of the vectors, lengths of the n-grams, start of the random numbers.
DIMENSIONS, GRAMS, SEED = 2048, (3, 4), 11
#: Weight of a text's script against its letters.
SCRIPT = 0.7
#: Labelled documents that the profiles are fitted on, at most: those of the smallest hashes.
TRAINING_DOCUMENTS = 20_000
#: Tasks that the sample and its n-grams are dealt to.
TASKS = 12
#: n-grams whose dot products a worker keeps, and those it is given from the start, at most; beyond that it makes them itself.
CACHE, GIVEN = 500_000, 200_000

#: Two- and three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "ru": ("rus", "russian"),
    "ja": ("jpn", "japanese"),
    "zh": ("zho", "chi", "chinese"),
}


def label_of(column: Column) -> Column:
    """Two-letter code of a label: a code, a locale tag or an English name, whatever its case and blanks; else null."""
    names = {n: code for code, others in LANGUAGES.items() for n in (code, *others)}
    word = F.lower(F.trim(F.regexp_replace(column, r"[\s\x{A0}]+", " ")))
    tag = F.regexp_extract(word, r"^([a-z]{2,3})[-_][a-z0-9]+([-_][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), F.try_element_at(table, tag))


def letter_vector(c: int) -> np.ndarray:
    """The random +-1 vector of a code point."""
    bits = np.random.default_rng([SEED, c]).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


#: Odd factors that make a code of an n-gram's letters, by its length: a linear hash of 64 bits.
_FACTORS = {n: np.random.default_rng([SEED, 1 << 30, n]).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in GRAMS}


@dataclass(frozen=True)
class Grams:
    """The n-grams of some texts: text number and place among the distinct ones of each; codes and letters of the distinct ones."""

    owner: np.ndarray
    place: np.ndarray
    codes: np.ndarray
    letters: np.ndarray

    def sums(self, values: np.ndarray, texts: int) -> np.ndarray:
        """For each text the sum of its n-grams' values, a row of ``values`` for each distinct one."""
        out = np.zeros((texts, values.shape[1]))
        # the texts' numbers ascend within the n-grams of one length
        turns = np.r_[0, np.flatnonzero(np.diff(self.owner) < 0) + 1, len(self.owner)]
        for a, b in zip(turns[:-1], turns[1:], strict=True):
            owner = self.owner[a:b]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
            if len(starts):
                out[owner[starts]] += np.add.reduceat(values[self.place[a:b]], starts, axis=0, dtype=np.float64)
        return out

    def squares(self, texts: int) -> np.ndarray:
        """Sum of squared counts of each text's distinct n-grams."""
        if not len(self.owner):
            return np.zeros(texts)
        key = np.sort(self.owner * np.int64(len(self.codes)) + self.place)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)]).astype(np.float64)
        return np.bincount(key[starts] // len(self.codes), counts**2, texts)


def raw_grams(texts: Sequence[str]) -> Grams:
    """Every n-gram of the texts, of whole code points; each text with a blank at both ends."""
    joined = "".join(f" {t} " for t in texts)
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = letters.astype(np.uint64)
    number = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    codes, owners, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in GRAMS:
        m = len(letters) - n + 1
        if m > 0:
            at = np.flatnonzero(number[:m] == number[n - 1 :])
            code = wide[:m] * _FACTORS[n][0]
            for i in range(1, n):
                code += wide[i : m + i] * _FACTORS[n][i]
            codes.append(code[at])
            owners.append(number[at])
            starts.append(at * 8 + n)
    encoded = pa.array(np.concatenate(codes)).dictionary_encode()
    place, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_numpy()
    first = np.zeros(len(distinct), np.int64)
    first[place[::-1]] = np.concatenate(starts)[::-1]
    which, length = first // 8, first % 8
    padded = np.r_[letters, np.zeros(max(GRAMS), np.uint32)]
    spelled = np.stack([np.where(i < length, padded[which + i], 0) for i in range(max(GRAMS))], axis=1) if len(first) else np.zeros((0, max(GRAMS)), np.uint32)
    return Grams(np.concatenate(owners), place, distinct, spelled)


def scripts_of(texts: Sequence[str], squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A further symbol for the script of each text and its weight, SCRIPT of the length of the rest."""
    return np.array([script_of(t) for t in texts], np.uint64), SCRIPT * np.sqrt(squares)


def _script_letters(kinds: np.ndarray) -> np.ndarray:
    """Scripts are spelled as letters of the control range, which no n-gram of prose holds."""
    out = np.zeros((len(kinds), max(GRAMS)), np.uint32)
    out[:, 0] = kinds
    return out


def script_of(text: str) -> int:
    """1 for unspaced scripts, 2 for Greek, Cyrillic and their neighbours, 3 for the rest: by the first letter."""
    c = text[:1]
    return 1 if c >= "\u2e80" else 2 if "\u0370" <= c <= "\u1fff" else 3


class Letters:
    """Vectors of letters by their place in an n-gram, made once per worker."""

    def __init__(self) -> None:
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def at(self, c: int, place: int) -> np.ndarray:
        v = self.made.get((c, place))
        if v is None:
            v = np.roll(letter_vector(c), place) if c else np.ones(DIMENSIONS, np.int8)
            self.made[c, place] = v
        return v

    def bind(self, spelled: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given by their letters, a row each: the product of their letters' vectors."""
        out = np.ones((len(spelled), DIMENSIONS), np.int8)
        for place in range(spelled.shape[1]):
            letters, inverse = np.unique(spelled[:, place], return_inverse=True)
            if letters.any():
                out *= np.stack([self.at(int(c), place) for c in letters])[inverse]
        return out


class GramTable:
    """Dot products of n-gram vectors with fixed axes, made when an n-gram is first met: a worker's cache, which may be given some."""

    def __init__(self, axes: np.ndarray, codes: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.axes, self.letters = axes.astype(np.float32), Letters()
        self.codes = np.zeros(0, np.uint64) if codes is None else codes
        self.values = np.zeros((0, len(self.axes)), np.float32) if values is None else values

    def made(self, spelled: np.ndarray) -> np.ndarray:
        parts = [self.letters.bind(spelled[i : i + 4096]).astype(np.float32) @ self.axes.T for i in range(0, len(spelled), 4096)]
        return np.concatenate([np.zeros((0, len(self.axes)), np.float32), *parts])

    def look_up(self, codes: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Values of distinct codes, a row each."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = np.flatnonzero(self.codes[at] != codes) if len(self.codes) else np.arange(len(codes))
        if not len(new):
            return self.values[at]
        own = self.made(spelled[new])
        out = np.empty((len(codes), len(self.axes)), np.float32)
        if len(self.codes):
            out[:] = self.values[at]
        out[new] = own
        kept = len(self.codes) + len(new) <= CACHE
        all_codes = np.r_[self.codes, codes[new]] if kept else codes[new]
        all_values = np.concatenate([self.values, own]) if kept else own
        order = np.argsort(all_codes)
        self.codes, self.values = all_codes[order], all_values[order]
        return out


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: unit vectors after the mean was taken off."""

    codes: tuple[str, ...]
    mean: np.ndarray
    vectors: np.ndarray
    #: n-grams of the training texts with their dot products, GIVEN at most: what workers need not make again.
    given: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, sums: dict[str, np.ndarray]) -> Profiles:
        codes = tuple(sorted(sums))
        if not codes:
            return cls((), np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32))
        units = np.array([_unit(sums[c]) for c in codes], np.float32)
        mean = units.mean(axis=0) if len(codes) > 1 else np.zeros(DIMENSIONS, np.float32)
        return cls(codes, mean, np.array([_unit(u - mean) for u in units], np.float32))

    def table(self) -> GramTable:
        """Dot products of n-gram vectors with the mean and each language; those of a bundle are their sums."""
        return GramTable(self.axes, *(self.given or ()))

    @property
    def axes(self) -> np.ndarray:
        return np.concatenate([self.mean[None, :], self.vectors])

    def cosines(self, table: GramTable, texts: Sequence[str]) -> np.ndarray:
        """Cosine of every text with every language, the mean taken off; zeros for a text without n-grams."""
        grams = raw_grams(texts)
        if not len(grams.owner):
            return np.zeros((len(texts), len(self.codes)))
        values = table.look_up(grams.codes, grams.letters)
        dots = grams.sums(values, len(texts))
        squares = grams.squares(len(texts))
        script, weight = scripts_of(texts, squares)
        kinds, of = np.unique(script, return_inverse=True)
        dots += table.look_up(kinds, _script_letters(kinds))[of] * weight[:, None]
        # n-gram vectors are orthogonal but for chance, so squares add up to a bundle's length
        norms = np.sqrt(DIMENSIONS * (squares + weight**2))
        dots /= np.where(norms == 0, 1, norms)[:, None]
        m = float(self.mean @ self.mean)
        length = np.sqrt(np.maximum(1 - 2 * dots[:, 0] + m, 1e-9))  # of the unit bundle less the mean
        return (dots[:, 1:] - self.vectors @ self.mean) / length[:, None]

    def confidence(self, cosines: np.ndarray) -> np.ndarray:
        """Softmax over languages, sharp enough that a clear lead is near 1."""
        e = np.exp(20 * (cosines - cosines.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n else v


def _weights(sample: DataFrame, profiles: Profiles | None) -> DataFrame:
    """``code, letters, weights``: each n-gram of the sample with its weight in every label's bundle; with profiles, of the documents they agree with.

    Tasks add up their own texts, so that what is shuffled is a row per task, label and n-gram.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = profiles.table() if profiles is not None else None
        for batch in batches:
            labels, prose = np.array(batch.column("label").to_pylist(), object), batch.column("prose").to_pylist()
            own = [s for x in prose for s in x]
            if not own:
                continue
            document = np.repeat(np.arange(len(prose)), [len(x) for x in prose])
            kept = np.ones(len(own), bool)
            if scores is not None:
                # a document of another language, or of several, teaches nothing
                best = np.array(profiles.codes, object)[profiles.cosines(scores, own).argmax(axis=1)]
                right = np.bincount(document, best == labels[document], len(prose))
                kept = (4 * right >= 3 * np.array([len(x) for x in prose]))[document]
            names, number = np.unique(labels[document].astype(str), return_inverse=True)
            grams = raw_grams(own)
            squares = grams.squares(len(own))
            script, weight = scripts_of(own, squares)
            norm = np.sqrt(DIMENSIONS * (squares + weight**2))
            use = kept[grams.owner] & (norm[grams.owner] > 0)
            owner, place = grams.owner[use], grams.place[use]
            sums = np.bincount(number[owner] * len(grams.codes) + place, 1 / norm[owner], len(names) * len(grams.codes))
            at = np.flatnonzero(sums)
            which = np.flatnonzero(kept & (weight > 0))
            kinds, of = np.unique(script[which], return_inverse=True)
            marks = np.bincount(number[which] * max(1, len(kinds)) + of, weight[which] / norm[which], len(names) * len(kinds))
            more = np.flatnonzero(marks)
            codes = np.r_[grams.codes[at % len(grams.codes)], kinds[more % max(1, len(kinds))]]
            spelled = np.concatenate([grams.letters[at % len(grams.codes)], _script_letters(kinds)[more % max(1, len(kinds))]])
            label = np.r_[names[at // len(grams.codes)], names[more // max(1, len(kinds))]]
            letters = pa.FixedSizeListArray.from_arrays(pa.array(spelled.astype(np.int32).ravel()), spelled.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(label.tolist(), pa.string()), pa.array(codes.view(np.int64)), letters, pa.array(np.r_[sums[at], marks[more]])], ["label", "code", "letters", "weight"])

    rows = sample.mapInArrow(run, "label string, code long, letters array<int>, weight double")
    # few rows, but binding them is work for all cores
    each = rows.repartition(TASKS, "code").groupBy("code", "label").agg(F.first("letters").alias("letters"), F.sum("weight").alias("weight"))
    return each.groupBy("code").agg(F.first("letters").alias("letters"), F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("weights"))


def _spelled(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("letters")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.uint32)


def _bundles(weights: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of each label: every n-gram's vector is bound once, times its weight in each label, and added up by task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(), {}
        for batch in batches:
            by = [dict(w) for w in batch.column("weights").to_pylist()]
            names = sorted({n for w in by for n in w})
            matrix = np.array([[w.get(n, 0.0) for n in names] for w in by], np.float32).reshape(len(by), len(names))
            spelled = _spelled(batch)
            for i in range(0, len(spelled), 4096):
                part = matrix[i : i + 4096].T @ letters.bind(spelled[i : i + 4096]).astype(np.float32)
                for n, row in zip(names, part.astype(np.float64), strict=True):
                    total[n] = total.get(n, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([b.tolist() for b in total.values()], pa.list_(pa.float64()))], ["label", "bundle"])

    out: dict[str, np.ndarray] = {}
    for label, bundle in weights.mapInArrow(run, "label string, bundle array<double>").collect():  # a row per task and language
        out[label] = out.get(label, 0) + np.array(bundle)
    return out


def _given(weights: DataFrame, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and dot products of the GIVEN n-grams of most weight."""
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, w: a + w)
    most = weights.orderBy(total.desc(), "code").limit(GIVEN).select("code", "letters").toArrow()
    codes = most.column("code").to_numpy().astype(np.int64).view(np.uint64)
    flat = most.column("letters").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    table = GramTable(profiles.axes)
    values = table.made(flat.reshape(len(codes), -1).astype(np.uint32)) if len(codes) else table.values
    order = np.argsort(codes)
    return codes[order], values[order]


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", limit: int = TRAINING_DOCUMENTS, rounds: int = 2) -> Profiles:
    """Profiles of the labelled documents, of which a share may be labelled wrongly.

    Fitted on at most ``limit`` different (text, label) pairs, those of the smallest text hashes; each further
    round keeps the documents whose label the last profiles confirm for three quarters of the sentences.
    """
    labelled = documents.select(label_of(F.col(lang)).alias("label"), F.col(text).alias("text")).where(F.col("label").isNotNull() & (F.length("text") > 20)).distinct()
    sample = labelled.orderBy(F.xxhash64("text"), "label").limit(limit).repartition(TASKS)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prose = [sentences(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(prose, pa.list_(pa.string()))], ["label", "prose"])

    sample = sample.mapInArrow(split, "label string, prose array<string>").persist()
    try:
        profiles = None
        for _ in range(rounds + 1):
            weights = durable(_weights(sample, profiles))
            profiles = Profiles.of(_bundles(weights))
        return replace(profiles, given=_given(weights, profiles))
    finally:
        sample.unpersist()


def identify(documents: DataFrame, profiles: Profiles, text: str = "text", out: str = "segments") -> DataFrame:
    """All columns but ``text``, and ``out``: the document's segments in order.

    A segment is a run of prose sentences of one language: lang, confidence (mean over its
    sentences), sentences, letters. Empty for a null, empty or prose-free text.
    """
    from pyspark.sql.types import StructType

    kind = "array<struct<lang:string,confidence:double,sentences:int,letters:int>>"
    schema = StructType([f for f in documents.schema.fields if f.name != text]).add(StructType.fromDDL(f"`{out}` {kind}").fields[0])
    cell = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("letters", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = profiles.table()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                own = [sentences(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                unique = {s: i for i, s in enumerate(dict.fromkeys(s for x in own for s in x))}
                cells: list[list[dict]] = [[] for _ in own]
                if unique and profiles.codes:
                    scores = profiles.confidence(profiles.cosines(table, list(unique)))
                    best, most = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
                    for i, x in enumerate(own):
                        at = [unique[s] for s in x]
                        if len({best[k] for k in at}) == 1:  # one language, whatever is sure
                            cells[i] = [{"lang": profiles.codes[best[at[0]]], "confidence": sum(most[k] for k in at) / len(at), "sentences": len(at), "letters": sum(map(len, x))}]
                        elif at:
                            cells[i] = segments_of([scores[k] for k in at], [len(s) for s in x], profiles.codes)
                kept = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in kept), pa.array(cells, cell)], [*kept, out])

    return documents.mapInArrow(run, schema)


#: A sentence with a confidence below SURE brings in no language of its own, unless the next one
#: has the same and both reach PAIR.
SURE, PAIR = 0.7, 0.5
#: A sentence to which all those languages give less than this part of its own best (one of another script) keeps its own.
UNLIKE = 0.01


def segments_of(scores: Sequence[np.ndarray], letters: Sequence[int], codes: Sequence[str]) -> list[dict]:
    """Runs of sentences of one language.

    A sentence that is neither sure nor half of a pair takes the likeliest of the languages
    that the document's other sentences bring in, if there are any.
    """
    best = [int(s.argmax()) for s in scores]
    most = [float(s.max()) for s in scores]
    sure = [m >= SURE for m in most]
    for i in range(1, len(best)):
        if best[i] == best[i - 1] and min(most[i - 1], most[i]) >= PAIR:
            sure[i - 1] = sure[i] = True
    known = sorted({b for b, ok in zip(best, sure, strict=True) if ok})
    if known:
        likely = [max(known, key=lambda k: s[k]) for s in scores]
        best = [b if ok or s[k] < UNLIKE * s[b] else k for b, k, ok, s in zip(best, likely, sure, scores, strict=True)]
    elif scores:
        whole = int(sum(np.log(s + 1e-9) * n for s, n in zip(scores, letters, strict=True)).argmax())
        best = [whole] * len(best)
    out: list[dict] = []
    for lang, s, n in zip(best, scores, letters, strict=True):
        if out and out[-1]["lang"] == codes[lang]:
            last = out[-1]
            last["confidence"] += (float(s[lang]) - last["confidence"]) / (last["sentences"] + 1)
            last["sentences"] += 1
            last["letters"] += n
        else:
            out.append({"lang": codes[lang], "confidence": float(s[lang]), "sentences": 1, "letters": n})
    return out


def mislabelled(documents: DataFrame, profiles: Profiles | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, lang``: documents with prose whose label is missing, wrong or names one of several languages.

    A row for each language in which the document has at least a sentence of prose.
    """
    profiles = profiles or fit(documents, text, lang)
    rows = documents.select(F.col(key).alias("__key"), label_of(F.col(lang)).alias("__label"), F.col(text).alias("__text"))
    found = identify(spread(rows, "__key"), profiles, "__text").withColumn("langs", F.array_distinct(F.transform("segments", lambda s: s["lang"])))
    wrong = (F.size("langs") > 0) & (F.col("__label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("__label", F.lit(""))))
    return found.where(wrong).select(F.col("__key").alias(key), F.explode("langs").alias("lang")).distinct()
