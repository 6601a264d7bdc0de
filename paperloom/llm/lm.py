"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are quantised on a log scale: an n-gram of level q is in the
filter q times, under the numbers 1 to q. A count is read back by probing 1, 2, ... until a probe fails; a false positive raises
a count by one level in about one of 80 cases. The filter is cut into segments by the n-gram's hash, so each is built by one
small task, and into blocks of 512 bits, so all probes of an n-gram read one cache line. While the filter is small enough
it is broadcast; beyond that, texts ask for their n-grams in units of a few MB: a unit's different n-grams go to the task
that has their segments, packed, and their levels come back, a byte each. Exact word counts, for the base score, never pass through the
filter: those of the most frequent words are broadcast, of which there is a fixed number, the others are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import drop_staged, small_batches, stage
from paperloom.llm.langid import chunks

#: Bits that each n-gram has in the filter for one of its levels, set bits of a level, bits of a block.
BITS, HASHES, BLOCK = 10, 4, 512
#: Training tokens to a segment: what one task holds to build it.
SEGMENT_TOKENS = 1 << 19
#: The largest filter that is broadcast.
BROADCAST_BYTES = 128 << 20
#: Most frequent words whose exact counts are broadcast, at most.
HEAD_WORDS = 1 << 18
#: Bytes of text that are cut at once, and n-grams that a task counts before it passes them on.
CHUNK, PENDING = 4 << 20, 1 << 21
#: Segments of pairs that answer together, n-grams that are put to one task at once, about, and rounds in which pairs are asked
#: for, and texts summed: each moves one part of them, so that the disk holds that part only.
TOGETHER, ASKED, ROUNDS = 4, 4 << 20, 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that looks random (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Stand for the start of a text as history and for its end as token: no word has a blank.
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(b, 42)) for b in (b" begin", b" end"))


def held_out(id_col: Column) -> Column:
    """True for documents that are kept from training: crc32 of the id as text leaves 2 modulo 7. A null id trains."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text number and word number of each word, in order, and the distinct words: lower-cased runs between ASCII blanks."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    at, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(some).dictionary_encode()
    return at.filter(some).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def shifted(tokens: np.ndarray, ends: np.ndarray, begin) -> np.ndarray:
    """What stands before each token; `begin` at the start of a text. ends: where each text's end stands."""
    before = np.concatenate([[begin], tokens[:-1]]) if len(tokens) else tokens
    before[ends[:-1] + 1] = begin
    return before


class Stream:
    """Tokens of some texts by number: hashes has those of the distinct words, then the end's, which closes each text."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers, self.ends = hashes, numbers, np.flatnonzero(numbers == len(hashes) - 1)
        self.texts, self.text = len(self.ends), np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=-1))
        self.token = hashes[numbers]
        self.history = shifted(self.token, self.ends, BEGIN)

    def pairs(self) -> np.ndarray:
        return pair_hash(self.history, self.token)

    def packed(self) -> tuple[bytes, bytes]:
        """The hashes, and the numbers as four planes of bytes, of which the upper ones hold little."""
        return self.hashes.tobytes(), self.numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()

    @classmethod
    def unpacked(cls, hashes: bytes, numbers: bytes) -> Stream:
        planes = np.frombuffer(numbers, np.uint8).reshape(4, -1)
        return cls(np.frombuffer(hashes, np.uint64), np.ascontiguousarray(planes.T).view(np.uint32).ravel())


class Tokens(Stream):
    """Tokens of some texts: for each the text, the hash of the token and of its history."""

    def __init__(self, texts: pa.Array):
        self.at, self.codes, self.words = words_of(texts)
        n = len(texts)
        numbers = np.full(len(self.codes) + n, len(self.words), np.int64)
        numbers[np.arange(len(self.codes)) + self.at] = self.codes
        super().__init__(np.append(word_hashes(self.words), END), numbers)


def pair_hash(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(history + GOLDEN * mix(token))


def summed(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, with the sums of their counts."""
    order = np.argsort(x, kind="stable")
    x, counts = x[order], counts[order]
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[starts], np.add.reduceat(counts, starts) if len(x) else counts


def level(counts: np.ndarray) -> np.ndarray:
    """1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts.astype(np.float64))[1]


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for 0."""
    return np.where(levels > 0, (np.exp2(levels - 1.0) + np.exp2(levels) - 1) / 2, 0.0)


def segment_of(x: np.ndarray, segments: int) -> np.ndarray:
    return ((x >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def block_of(x: np.ndarray, blocks) -> np.ndarray:
    """The block within a segment of so many blocks."""
    return (((x & np.uint64(0xFFFFFFFF)) * np.asarray(blocks, np.uint64)) >> np.uint64(32)).astype(np.int64)


def bits_of(x: np.ndarray, number: int) -> Iterator[np.ndarray]:
    """The bits that an n-gram of at least that level has set in its block."""
    z = mix(x + np.uint64(int(GOLDEN) * number % (1 << 64)))
    for k in range(HASHES):
        yield ((z >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)).astype(np.int64)


def build(x: np.ndarray, counts: np.ndarray, per_entry: int = BITS) -> bytes:
    """The blocks of a segment."""
    levels = level(counts)
    blocks = max(1, -(-int(levels.sum()) * per_entry // BLOCK))
    first, bits = block_of(x, blocks) * BLOCK, np.zeros(blocks * BLOCK, bool)
    for number in range(1, int(levels.max(initial=0)) + 1):
        some = levels >= number
        for bit in bits_of(x[some], number):
            bits[first[some] + bit] = True
    return np.packbits(bits, bitorder="little").tobytes()


def probe(words: np.ndarray, first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Levels of n-grams: the numbers 1, 2, ... are probed until one fails. first: the word in which each one's block begins."""
    levels, alive, number = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    while len(alive) and number < 64:
        number += 1
        hit = np.ones(len(alive), bool)
        for bit in bits_of(x[alive], number):
            hit &= (words[first[alive] + (bit >> 6)] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        alive = alive[hit]
        levels[alive] = number
    return levels


class Filter:
    """All segments, or some neighbouring ones, in one array."""

    def __init__(self, data: bytes, sizes: np.ndarray, start: int = 0, segments: int | None = None):
        """data: the segments one after the other; sizes: of each, in words; start: the first one's number, of so many."""
        self.words, self.blocks, self.first = np.frombuffer(data, np.uint64), sizes * 64 // BLOCK, np.cumsum(sizes) - sizes
        self.start, self.segments = start, segments or len(sizes)

    def levels(self, x: np.ndarray) -> np.ndarray:
        at = segment_of(x, self.segments) - self.start
        return probe(self.words, self.first[at] + block_of(x, self.blocks[at]) * (BLOCK // 64), x)


def packed(parts: Iterator[tuple[np.ndarray, np.ndarray]], segments: int) -> Iterator[pa.RecordBatch]:
    """(seg, x, counts): n-grams counted within the task as far as PENDING allows, a row for each segment."""

    def rows(x: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        at = segment_of(x, segments)
        order = np.argsort(at, kind="stable")
        segs, starts = np.unique(at[order], return_index=True)
        xs, cs = np.split(x[order], starts[1:]), np.split(counts[order], starts[1:])
        return pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array([v.tobytes() for v in xs], pa.binary()), pa.array([v.tobytes() for v in cs], pa.binary())], names=["seg", "x", "counts"])

    pending, size = [], 0
    for x, counts in parts:
        pending.append(summed(x, counts))
        size += len(pending[-1][0])
        if size >= PENDING:
            x, counts = summed(*(np.concatenate(v) for v in zip(*pending)))
            pending, size = [(x, counts)], len(x)
            if size >= PENDING // 2:
                yield rows(x, counts)
                pending, size = [], 0
    if size:
        yield rows(*summed(*(np.concatenate(v) for v in zip(*pending))))


def built(counted: DataFrame, label: str, per_entry: int) -> DataFrame:
    """(seg, bits, n): the segments of the filter and how many n-grams each holds."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x, counts = summed(*(np.concatenate([np.frombuffer(b, kind) for b in group[c]]) for c, kind in (("x", np.uint64), ("counts", np.int64))))
        return pd.DataFrame({"seg": [int(group["seg"].iloc[0])], "bits": [build(x, counts, per_entry)], "n": [len(x)]})

    return stage(counted.groupBy("seg").applyInPandas(one, "seg long, bits binary, n long"), label)


class Model:
    """What was counted: tokens, vocab (distinct tokens), texts, mu, word counts and both filters as tables, their segments."""

    def __init__(self, vocabulary: DataFrame, tokens: int, vocab: int, texts: int):
        self.vocabulary, self.tokens, self.vocab, self.texts = vocabulary, tokens, vocab, texts
        self.mu, self.words, self.pairs = 1.0, None, None
        self.word_segments, self.pair_segments = max(1, vocab // SEGMENT_TOKENS), max(1, tokens // SEGMENT_TOKENS)

    def log_p(self, token: np.ndarray, history: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of the probability of tokens from the levels of token, history and pair: the pair's count, smoothed by mu
        times the token's own add-one probability. A pair whose parts aren't known is not known."""
        base = (count_of(token) + 1) / (self.tokens + self.vocab + 1)
        before = count_of(history)
        seen = np.where((token > 0) & (history > 0), np.minimum(count_of(pair), before), 0.0)
        return np.log10((seen + self.mu * base) / (before + self.mu))


def cut_texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts."""
    for b in batches:
        start = 0
        for part in chunks(b.column(column), CHUNK):
            yield b.slice(start, len(part)), part
            start += len(part)


def fit(docs: DataFrame, train: Column, text: str = "text", per_entry: int = BITS) -> Model:
    """The model of docs where train holds. Null texts are empty; a text has its words and one end. All words and pairs of
    all texts are counted, however long or frequent; counts are summed in tasks before they are shuffled."""
    small_batches(docs.sparkSession)
    rows = docs.where(train).select(F.coalesce(F.col(text), F.lit("")).alias("t"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in cut_texts(batches):
            _, codes, names = words_of(part)
            counts = [*np.bincount(codes, minlength=len(names)).tolist(), len(part)]  # null is the end of a text
            yield pa.RecordBatch.from_arrays([pa.array([*names.to_pylist(), None], pa.string()), pa.array(counts, pa.int64())], names=["word", "c"])

    vocabulary = stage(rows.mapInArrow(words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    got = vocabulary.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    model = Model(vocabulary, got[0] or 0, got[1], got[2] or 0)
    segments, pair_segments = model.word_segments, model.pair_segments

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in batches:
                x = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w, 42) for w in b.column(0).to_pylist()), np.uint64, b.num_rows)
                counts = b.column(1).to_numpy()
                yield x, counts
                if (ends := x == END).any():  # as many texts begin as end
                    yield np.array([BEGIN]), counts[ends]

        yield from packed(parts(), segments)

    def doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((x := Tokens(part).pairs(), np.ones(len(x), np.int64)) for _, part in cut_texts(batches)), pair_segments)

    schema = "seg long, x binary, counts binary"
    model.words = built(vocabulary.mapInArrow(singles, schema), "word-filter", per_entry)
    model.pairs = built(rows.mapInArrow(doubles, schema), "pair-filter", per_entry)
    distinct = model.pairs.agg(F.sum("n")).first()[0]
    model.mu = distinct / model.vocab if distinct else 1.0  # different followers of a history, on average
    return model


def head_of(vocabulary: DataFrame, most: int) -> pa.Table:
    """The words of the highest counts, at most so many: all with a count from some eighth of a power of two on."""
    eighth = F.floor(8 * F.log2("c")).cast("int")
    sizes = vocabulary.where("word is not null").groupBy(eighth.alias("e")).count().collect()  # some hundred rows
    least, words = 1 << 20, 0
    for r in sorted(sizes, key=lambda r: -r.e):
        words += r["count"]
        if words > most:
            break
        least = r.e
    return vocabulary.where(F.col("word").isNotNull() & (eighth >= least)).select("word", "c").toArrow()


def _laid_out(segs: list[int], bits: list[bytes], start: int, stop: int) -> tuple[bytes, np.ndarray]:
    """The segments from start to stop one after the other, and their sizes in words."""
    own = [bytes(BLOCK // 8)] * (stop - start)  # one empty block where no n-gram fell
    for seg, b in zip(segs, bits):
        own[seg - start] = b
    return b"".join(own), np.array([len(b) // 8 for b in own], np.int64)


def _collected(filters: DataFrame, segments: int) -> tuple[bytes, np.ndarray]:
    got = filters.select("seg", "bits").toArrow()
    return _laid_out(got.column("seg").to_pylist(), got.column("bits").to_pylist(), 0, segments)


class Desks:
    """Where n-grams of one kind are asked for: `together` neighbouring segments are a desk; a desk that is asked for more
    than ASKED n-grams has `copies`, among which units are dealt. Numbers of desks start at `base`."""

    def __init__(self, segments: int, together: int, asked: int, base: int):
        self.segments, self.together, self.base = segments, together, base
        desks = -(-segments // together)
        self.copies = max(1, -(-asked // (desks * ASKED)))
        self.end = base + desks * self.copies

    def of(self, x: np.ndarray) -> np.ndarray:
        """The desk of each n-gram, as if there were no copies."""
        return segment_of(x, self.segments) // self.together

    def asked(self, unit: int, x: np.ndarray) -> Iterator[tuple[int, bytes]]:
        desk = self.of(x)
        order = np.argsort(desk, kind="stable")
        numbers, starts = np.unique(desk[order], return_index=True)
        copy = int(mix(np.array([unit], np.uint64))[0]) % self.copies
        for k, own in zip(numbers.tolist(), np.split(x[order], starts[1:])):
            yield self.base + k * self.copies + copy, own.tobytes()

    def answered(self, x: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Levels of x from answers in the order of desks."""
        out = np.empty(len(x), np.int64)
        out[np.argsort(self.of(x), kind="stable")] = levels
        return out

    def filter(self, desk: int, segs: list[int], bits: list[bytes]) -> Filter:
        start = (desk - self.base) // self.copies * self.together
        return Filter(*_laid_out(segs, bits, start, min(start + self.together, self.segments)), start, self.segments)

    def table(self, filters: DataFrame, rounds: int = 1, now: int = 0) -> DataFrame:
        """(desk, seg, bits): the segments at each desk of this round."""
        number = F.floor(F.col("seg") / self.together)
        first = F.lit(self.base) + number * self.copies
        return filters.where(number % rounds == now).select(F.explode(F.sequence(first, first + (self.copies - 1))).alias("desk"), "seg", "bits")


def _logs_asked(units: DataFrame, model: Model, tokens: int, words: int) -> DataFrame:
    """(l_row, logs): the score of each text of units (row, hashes, numbers), where the filter is too large for a worker. row is the
    first text's, the others follow it; tokens and words: numbers of tokens, and of words of units, together."""
    plain = {k: getattr(model, k) for k in ("tokens", "vocab", "mu")}
    pairs = Desks(model.pair_segments, TOGETHER, tokens, 0)
    singles = Desks(model.word_segments, 1, words, pairs.end)

    def ask(now: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for unit, hashes, numbers in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if now < ROUNDS:
                        x = Stream.unpacked(hashes, numbers).pairs()
                        asked = list(pairs.asked(unit, np.unique(x[pairs.of(x) % ROUNDS == now])))
                    else:
                        asked = list(singles.asked(unit, np.append(np.frombuffer(hashes, np.uint64), BEGIN)))
                    yield pa.RecordBatch.from_arrays([pa.array([unit] * len(asked), pa.int64()), pa.array([k for k, _ in asked], pa.int64()), pa.array([x for _, x in asked], pa.binary())], names=["unit", "desk", "x"])

        return run

    def answer(key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        f = (pairs if key[0] < pairs.end else singles).filter(key[0], own["seg"].tolist(), own["bits"].tolist())
        out, many = [], np.cumsum([len(x) for x in asked["x"]]) // (1 << 21)
        for _, some in asked["x"].groupby(many):
            levels = f.levels(np.frombuffer(b"".join(some), np.uint64)).astype(np.uint8).tobytes()
            ends = np.cumsum([len(x) // 8 for x in some]).tolist()
            out += [levels[i:k] for i, k in zip([0, *ends], ends)]
        return pd.DataFrame({"unit": asked["unit"], "desk": asked["desk"], "levels": out})

    def sums(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        m = Model.__new__(Model)
        vars(m).update(plain)
        unit, hashes, numbers = own.iloc[0]
        s, answers = Stream.unpacked(hashes, numbers), answers.sort_values("desk")
        of = lambda some: np.frombuffer(b"".join(answers["levels"][some]), np.uint8)
        x, inverse = np.unique(s.pairs(), return_inverse=True)
        level = singles.answered(np.append(s.hashes, BEGIN), of(answers["desk"] >= pairs.end))
        token, pair = level[s.numbers], pairs.answered(x, of(answers["desk"] < pairs.end))[inverse]
        logs = m.log_p(token, shifted(token, s.ends, level[-1]), pair)
        return pd.DataFrame({"l_row": unit + np.arange(s.texts), "logs": np.bincount(s.text, weights=logs, minlength=s.texts)})

    got = []
    for now in range(ROUNDS + 1):
        filters = pairs.table(model.pairs, ROUNDS, now) if now < ROUNDS else singles.table(model.words)
        asked = units.mapInArrow(ask(now), "unit long, desk long, x binary")
        got.append(stage(asked.groupBy("desk").cogroup(filters.groupBy("desk")).applyInPandas(answer, "unit long, desk long, levels binary"), "levels"))
    answers = reduce(DataFrame.union, got)
    turn = lambda unit: F.pmod(F.xxhash64(unit), F.lit(ROUNDS))
    logs = []
    for now in range(ROUNDS):
        own, answered = units.where(turn("row") == now), answers.where(turn("unit") == now)
        logs.append(stage(own.groupBy("row").cogroup(answered.groupBy("unit")).applyInPandas(sums, "l_row long, logs double"), "logs"))
    drop_staged(*got)
    return reduce(DataFrame.union, logs)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, head_words: int = HEAD_WORDS) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, train_tokens, base_score and score.

    base_score is exact: the add-one log10 probability of the tokens by their own counts. score is the model's, a bigram with
    quantised counts; with these, the probabilities of all tokens after a history sum to 1 but for quantising. A null text is empty and has
    only its end. If nothing was learned, all counts are 0, each token's probability is 1 and its logarithm 0. Repeated
    rows get equal results; texts of any length are read whole, in one task each. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    head = head_of(model.vocabulary, head_words)
    size = sum(f.agg(F.sum(F.length("bits"))).first()[0] or 0 for f in (model.words, model.pairs))
    filters = (_collected(model.words, model.word_segments), _collected(model.pairs, model.pair_segments)) if size <= broadcast_bytes else None
    plain = {k: getattr(model, k) for k in ("tokens", "vocab", "texts", "mu")}
    shared = sc.broadcast((head.column("word").combine_chunks(), head.column("c").to_numpy(), filters, plain))
    small = filters is not None
    del filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, own, values = shared.value
        m = Model.__new__(Model)
        vars(m).update(values)
        singles, doubles = (Filter(*own[0]), Filter(*own[1])) if small else (None, None)
        counts = np.append(counts, -1)  # for words that aren't in the head
        for b, part in cut_texts(batches, len(names)):
            tokens = Tokens(part)
            at = pc.index_in(tokens.words, value_set=known)
            c = counts[pc.fill_null(at, len(counts) - 1).to_numpy()][tokens.codes]
            seen = c >= 0
            total = lambda v: np.bincount(tokens.at, weights=v, minlength=tokens.texts)  # noqa: B023, E731
            n = np.bincount(tokens.at, minlength=tokens.texts) + 1
            base = total(np.log10(np.maximum(c, 0) + 1.0)) + np.log10(m.texts + 1.0)
            out = [*b.columns[:-1], pa.array(n), pa.array(total(seen).astype(np.int64) + (m.texts > 0)), pa.array(base)]
            if small:
                pairs, inverse = np.unique(tokens.pairs(), return_inverse=True)
                # levels of a slice's different tokens and pairs, read once
                singly, of = np.unique(np.append(tokens.token, BEGIN), return_inverse=True)
                levels = singles.levels(singly)[of]
                history = np.concatenate([levels[-1:], levels[:-2]])
                history[np.flatnonzero(tokens.history == BEGIN)] = levels[-1]
                logs = m.log_p(levels[:-1], history, doubles.levels(pairs)[inverse])
                out.append(pa.array(np.bincount(tokens.text, weights=logs, minlength=tokens.texts)))
            # words beyond the head, each of a text once, with their frequency
            key, tf = np.unique(tokens.at[~seen].astype(np.int64) * max(1, len(tokens.words)) + tokens.codes[~seen], return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(key // max(1, len(tokens.words)), minlength=tokens.texts))).astype(np.int32)
            out += [pa.ListArray.from_arrays(ends, tokens.words.take(pa.array(key % max(1, len(tokens.words))))), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))]
            if not small:  # a slice is a unit, and its first text has its tokens
                out += [pa.array([v, *[None] * (tokens.texts - 1)], pa.binary()) for v in tokens.packed()]
                out.append(pa.array([len(tokens.hashes), *[None] * (tokens.texts - 1)], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=labels)

    kinds = [*[(f.name, f.dataType.simpleString()) for f in rows.schema.fields[:-1]], ("n", "long"), ("known", "long"), ("base", "double"), *[("logs", "double")] * small, ("tail", "array<string>"), ("tfs", "array<int>"), *[("hashes", "binary"), ("numbers", "binary"), ("words", "long")] * (not small)]
    labels = [k for k, _ in kinds]
    scored = stage(rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds)).withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    tails = scored.select("row", F.explode(F.arrays_zip("tail", "tfs")).alias("x")).select("row", F.col("x.tail").alias("tail"), F.col("x.tfs").alias("tf"))
    counted = model.vocabulary.where("word is not null").select("word", "c")
    more = tails.join(counted, F.col("tail") == F.col("word")).groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("m_base"), F.sum("tf").alias("m_known"))
    out = scored.join(more.withColumnRenamed("row", "m_row"), F.col("row") == F.col("m_row"), "left")
    if not small:
        tokens, asked = scored.agg(F.sum("n"), F.sum("words")).first()
        logs = _logs_asked(scored.where("hashes is not null").select("row", "hashes", "numbers"), model, tokens or 0, asked or 0)
        out = out.join(logs, F.col("row") == F.col("l_row"), "left")
    per_token = F.log10(F.lit(float(model.tokens + model.vocab + 1)))
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keep)], F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("m_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("m_base", F.lit(0.0)) - F.col("n") * per_token).alias("base_score"), F.col("logs").alias("score"),
    )

