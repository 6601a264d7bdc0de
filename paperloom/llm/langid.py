"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language. An unseen word backs off to its character
n-grams: the longest n of which some are known gives the mean log frequency of those. The model is fitted on a bounded,
hash-drawn sample of labelled documents and holds all of its words and n-grams; predictions read every whole text. Words are
cut by one Arrow function in training and prediction, and each distinct word of a batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import small_batches

#: The bound of the model: documents drawn for each language. Its words and n-grams are all that these have.
SAMPLE_DOCS = 1000
#: Character n-grams of an unseen word, longest first. Words are put between underscores.
GRAMS = (4, 3, 2, 1)
#: A document's evidence counts as that of so many words at most, so that scores keep telling texts apart.
EVIDENCE = 30
#: Bytes of text that are cut into words at once.
CHUNK = 1 << 20
#: Unseen words whose scores a worker keeps.
CACHE = 20_000


def held_out(id_col: Column) -> Column:
    """True for documents that are kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text number and the word of each word, in order: lower-cased maximal runs of letters. A null text has none."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.utf8_lower(texts), ""), r"\P{L}+")
    at, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(words), 0)
    return at.filter(some).to_numpy(zero_copy_only=False), words.filter(some)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """The texts in slices of about `size` bytes; a longer text is a slice by itself."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _grams(padded: str, n: int) -> list[str]:
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Languages, and log frequencies of words and n-grams: one row of a matrix for each."""

    def __init__(self, langs: list[str], words: list[tuple], grams: list[tuple] | None = None, smooth: float = 0.5):
        """words: (word, count in each language); grams alike, by default those of the words."""
        self.langs = langs
        self.words, counts = self._counts(words)
        if grams is None:
            self.grams, gram_counts, names = {}, np.zeros((0, len(langs))), list(self.words)
            for k in range(0, len(names), 10_000):  # parts keep the lists short
                found = [[self.grams.setdefault(g, len(self.grams)) for n in GRAMS for g in _grams(f"_{w}_", n)] for w in names[k : k + 10_000]]
                more = np.zeros((len(self.grams), len(langs)))
                more[: len(gram_counts)] = gram_counts
                np.add.at(more, np.concatenate(found), np.repeat(counts[k : k + 10_000], [len(f) for f in found], axis=0))
                gram_counts = more
        else:
            self.grams, gram_counts = self._counts(grams)
        self.word_logs, self.gram_logs = self._logs(counts, smooth), self._logs(gram_counts, smooth)

    def _counts(self, rows: list[tuple]) -> tuple[dict[str, int], np.ndarray]:
        rows = sorted(rows, key=lambda r: r[0])
        return {r[0]: i for i, r in enumerate(rows)}, np.array([[c or 0 for c in r[1:]] for r in rows], np.float64).reshape(len(rows), len(self.langs))

    @staticmethod
    def _logs(counts: np.ndarray, smooth: float) -> np.ndarray:
        return (np.log((counts + smooth) / (counts + smooth).sum(axis=0)) if len(counts) else counts).astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """The score of unseen words: mean log frequencies of the longest n-grams of which some are known, else zeros."""
        flat, sizes, known = [], [], self.grams.get
        for w in words:
            at: list[int] = []
            for n in GRAMS:
                if at := [v for g in _grams(f"_{w}_", n) if (v := known(g)) is not None]:
                    break
            flat += at
            sizes.append(len(at))
        out, some = np.zeros((len(words), len(self.langs))), np.array(sizes, np.int64) > 0
        if flat:
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.gram_logs[flat].astype(np.float64), starts, axis=0) / np.array(sizes)[some][:, None]
        return out

    def score_words(self, words: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
        """The score of each word in each language: its own log frequencies, or those of its n-grams."""
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out = self.word_logs[at].astype(np.float64) if len(self.words) else np.zeros((len(words), len(self.langs)))
        new = [i for i in np.flatnonzero(at < 0).tolist() if words[i] not in cache]
        got = self.unseen([words[i] for i in new])
        for i in np.flatnonzero(at < 0).tolist():
            if (hit := cache.get(words[i])) is not None:
                out[i] = hit
        out[new] = got
        if len(cache) + len(new) > CACHE:
            cache.clear()
        if len(new) <= CACHE:
            cache.update((words[i], got[k]) for k, i in enumerate(new))
        return out

    def predict(self, texts: pa.Array, cache: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, k = len(texts), len(self.langs)
        if not k:
            return ["und"] * n, np.zeros(n)
        at, words = words_of(texts)
        coded = pc.dictionary_encode(words)
        scores = self.score_words(coded.dictionary.to_pylist(), cache)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        total = np.stack([np.bincount(at, weights=scores[codes, i], minlength=n) for i in range(k)], axis=1)
        count = np.bincount(at, minlength=n)
        total = total * np.minimum(1.0, EVIDENCE / np.maximum(count, 1))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)  # the first of equals: languages are in order
        score = np.where(count > 0, p[np.arange(n), best] / p.sum(axis=1), 0.0)
        return [self.langs[b] if c else "und" for b, c in zip(best.tolist(), count.tolist())], score


def drawn_share(sample_docs: int, n: int) -> int:
    """The bound below which a 63-bit hash falls for about sample_docs of n documents, exactly; all of them if n is no more."""
    return (1 << 63) - 1 if n <= sample_docs else (sample_docs << 63) // n


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", sample_key: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of docs where train holds and text and language aren't null.

    About sample_docs documents of each language are drawn by the hash of sample_key (the text by default), so the draw
    doesn't depend on how the table is stored. What comes to the driver is one count for each language and the sample's
    words, all of them: the model is bounded by sample_docs for each language.
    """
    small_batches(docs.sparkSession)
    key = F.xxhash64(sample_key if sample_key is not None else F.col(text)).bitwiseAND(F.lit((1 << 63) - 1))
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), key.alias("key"), train.alias("train")).where("train and lang is not null and text is not null")
    per_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], [])
    part = F.lit(0).cast("long")
    for name in langs:
        part = F.when(F.col("lang") == name, F.lit(drawn_share(sample_docs, per_lang[name])).cast("long")).otherwise(part)
    drawn = rows.where(F.col("key") <= part).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in _sliced(b.column(1)):
                at, words = words_of(part)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + start)), words], names=["lang", "w"])

    counted = drawn.mapInArrow(cut, "lang string, w string").groupBy("w").pivot("lang", langs).count().toArrow()
    return Model(langs, list(zip(*(c.to_pylist() for c in counted.columns))))


def _sliced(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    start = 0
    for part in chunks(texts):
        yield start, part
        start += len(part)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred and score. und with score 0 for a null text, one without letters, and
    where the model has learned no language. Equal texts get equal results; equal scores go to the first language in order.
    Very long texts are read whole, each as a slice by itself. An empty table gives an empty result.
    Columns of docs named lang_pred and score, if not in keep, don't clash."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the sample
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = Model.__new__(Model), {}
        vars(m).update(shared.value)
        pa.default_memory_pool().release_unused()
        for b in batches:
            for start, part in _sliced(b.column(b.num_columns - 1)):
                names, scores = m.predict(part, cache)
                kept = [c.slice(start, len(part)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, (schema + ", " if schema else "") + "lang_pred string, score double")


def chance_margin(languages: int, margin: float = 0.05) -> float:
    """The score that lies `margin` of the way from chance, 1 / languages, to certainty; 0 if there are no languages."""
    return 1 / languages + margin * (1 - 1 / languages) if languages else 0.0


def accepted(docs: DataFrame, model: Model, text: str = "text", margin: float = 0.05) -> DataFrame:
    """docs without the rows whose language isn't told: und, or a score hardly above chance, whatever the number of
    languages (see chance_margin). Columns unchanged, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    found = predict(docs.toDF(*names), model, names, names[at])
    told = (F.col("lang_pred") != "und") & (F.col("score") >= chance_margin(len(model.langs), margin))
    return found.where(told).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
