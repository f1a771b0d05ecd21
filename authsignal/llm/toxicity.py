"""Toxicity of documents by multiple-instance learning over their sentences.

Labels mark documents, but only some sentences of a toxic document offend. Each sentence s gets a
probability p(s) from its words by a logistic model; the document's is the noisy-or,
1 - product(1 - p(s)). The sentence model is fitted through that formula from document labels, so it
learns which sentences explain the labels, and its sentence scores then locate the offending ones.

The fit uses a bounded sample of labelled rows (``Limits``); scoring reads every whole text.

Defined cases: a row without an id teaches nothing and is not held out; of texts that repeat an id the
one of least hash teaches, all are scored; a null text counts as empty; an empty text has one sentence without words, whose
score is that of the model's bias; labels other than 0 and 1 teach nothing, of labels repeated for
one id the largest counts; with no usable labels the score is 0 for all; repeated rows are scored
each; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm.common import batches, rows_of, ship, texts

# bytes: sentence ends become line feeds, letters and digits stay (A-Z in lower case), others blanks
FORM = bytes(
    10 if c in b".!?\n" else c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit; none of them touches what is scored."""

    documents: int = 20_000  # labelled ids that the model is fitted on, one text each
    marks: int = 20_000_000  # words of the model in sentences that it is fitted on, over all those texts
    vocabulary: int = 2_000  # words of the sentence model
    word_bytes: int = 64  # longer words, and their beginnings, are no words of the model
    least_documents: int = 5  # a word of the model is in so many labelled rows
    rounds: int = 400
    rate: float = 0.05
    penalty: float = 2e-4


PREFIXES = (5, 6, 7)  # bytes: inflected and compound forms share the start of a word
OFFENDING = 0.5  # a sentence or document of this score or more is toxic
NONE: frozenset[bytes] = frozenset()
MOST_WORDS = 500_000  # words whose features one Python worker remembers


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[bytes, float]


def sentences(text: str) -> tuple[bytes, list[bytes]]:
    """The text's bytes in model form, and its sentences; a byte keeps its place."""
    form = text.encode().translate(FORM)
    return form, form.split(b"\n")


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


class Known(dict):
    """The model's features of each word met, found once a word."""

    def __init__(self, names):
        super().__init__()
        self.names = frozenset(names)

    def __missing__(self, word: bytes) -> frozenset[bytes]:
        if len(self) >= MOST_WORDS:
            self.clear()
        # most words have no feature: they share one empty set
        found = self[word] = self.names.intersection(features(word)) or NONE
        return found

    def of(self, words) -> set[bytes]:
        return set().union(*map(self.__getitem__, words))


def learn(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), keep=None) -> Model:
    """Fit the sentence model on ``labels`` (doc_id, toxic) for which ``keep`` (a column) holds."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    if keep is not None:
        known = known.where(keep)
    # at most ``limits.documents`` rows of two numbers
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.documents)
    chosen = written(chosen, "chosen")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one, F.first("toxic").alias("toxic"))
    sample = written(sample, "sample", compression="zstd")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        return Model(-np.inf, {})
    words = vocabulary(sample, seen[1], seen[0], limits)
    rows = bounded(written(instances(sample, words), "instances"), limits.marks)
    fitted = rows.repartition(1).mapInArrow(fit(len(words), limits), "place int, weight double").collect()
    weights = {r["place"]: r["weight"] for r in fitted}
    return Model(weights[len(words)], {w: weights[k] for k, w in enumerate(words) if weights[k]})


def vocabulary(sample: DataFrame, toxic: int, clean: int, limits: Limits) -> list[bytes]:
    """The words that tell the two labels apart best, by the likelihood ratio of document counts."""
    longest = limits.word_bytes
    schema = pa.schema([("word", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for part in parts:
                sums = (Counter(), Counter())
                for text, label in rows_of(part, "text", "toxic"):
                    words = set(sentences(text)[0].split())
                    sums[label].update({name for word in words if len(word) <= longest for name in features(word)})
                for word in sums[0].keys() | sums[1].keys():
                    yield word, sums[1][word], sums[0][word]

        yield from batches(found(), schema)

    n = F.col("toxic") + F.col("clean")
    total = float(toxic + clean)

    def part(seen, of: int):
        expected = n * F.lit(of / total)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    def rest(seen, of: int):
        expected = (F.lit(total) - n) * F.lit(of / total)
        left = F.lit(float(of)) - seen
        return F.when(left > 0, left * F.log(left / expected)).otherwise(0.0)

    ratio = part(F.col("toxic"), toxic) + part(F.col("clean"), clean) + rest(F.col("toxic"), toxic) + rest(F.col("clean"), clean)
    counts = sample.select("text", "toxic").mapInArrow(count, "word binary, toxic long, clean long")
    best = (
        counts.groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(n >= limits.least_documents)
        .withColumn("ratio", ratio)
        .orderBy(F.desc("ratio"), "word")
        .limit(limits.vocabulary)
    )
    return [bytes(r["word"]) for r in best.collect()]


def instances(sample: DataFrame, words: list[bytes]) -> DataFrame:
    """Rows (doc_id, toxic, plain, places, marks): sentences without model words are only counted."""
    places_of = {w: k for k, w in enumerate(words)}
    schema = pa.schema(
        [("doc_id", pa.int64()), ("toxic", pa.int32()), ("plain", pa.int32()), ("places", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32()))]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(words)

        def found():
            for part in parts:
                for doc_id, text, label in rows_of(part, "doc_id", "text", "toxic"):
                    plain, places, marks = 0, [], []
                    for k, sentence in enumerate(sentences(text)[1]):
                        own = {places_of[name] for name in known.of(sentence.split())}
                        if own:
                            places += sorted(own)
                            marks += [k] * len(own)
                        else:
                            plain += 1
                    yield doc_id, label, plain, places, marks

        yield from batches(found(), schema, 512)

    return sample.select("doc_id", "text", "toxic").mapInArrow(
        run, "doc_id long, toxic int, plain int, places array<int>, marks array<int>"
    )


def bounded(rows: DataFrame, marks: int) -> DataFrame:
    """The rows, in order of a hash of the id, whose marks together are at most ``marks``.

    Only pairs of numbers are put in order, one for each of the ids of the bounded sample.
    """
    total = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", F.size("places").alias("size"))
    within = sizes.withColumn("total", F.sum("size").over(total)).where(F.col("total") <= marks).select("doc_id")
    return rows.join(within, "doc_id", "left_semi")


def fit(n_words: int, limits: Limits):
    """The task that fits the weights on the bounded sample: full-batch Adam on the noisy-or likelihood."""
    schema = pa.schema([("place", pa.int32()), ("weight", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for part in parts for row in rows_of(part, "toxic", "plain", "places", "marks")]
        rows.sort()  # the order in which rows arrive doesn't reach the weights
        if not rows:
            return
        toxic = np.array([r[0] for r in rows])
        plain = np.array([r[1] for r in rows], dtype=float)
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        place = np.array([p for r in rows for p in r[2]], dtype=np.int64)
        mark = np.array([m for r in rows for m in r[3]], dtype=np.int64)
        _, of = np.unique(np.stack((doc, mark)), axis=1, return_inverse=True)
        of = of.reshape(-1)
        n_sentences = int(of.max()) + 1 if len(of) else 0
        doc_of = np.zeros(n_sentences, dtype=np.int64)
        doc_of[of] = doc
        weights, bias = np.zeros(n_words), -6.0
        first, second = np.zeros(n_words + 1), np.zeros(n_words + 1)
        for step in range(1, limits.rounds + 1):
            z = np.bincount(of, weights[place], n_sentences) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p0 = 1 / (1 + np.exp(-bias))
            # log(1 - p) summed over sentences is the log of the noisy-or's product
            miss = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows)) + plain * np.log1p(-p0)
            whole = np.maximum(-np.expm1(miss), 1e-9)
            # d loss / d miss, then d miss / d z = -p
            slope = np.where(toxic == 1, np.exp(miss) / whole, -1.0) / len(rows)
            by_sentence = -slope[doc_of] * p
            grad = np.bincount(place, by_sentence[of], n_words) + limits.penalty * np.sign(weights)
            full = np.concatenate((grad, [by_sentence.sum() - (slope * plain).sum() * p0]))
            first = 0.9 * first + 0.1 * full
            second = 0.999 * second + 0.001 * full**2
            move = limits.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - move[-1]
        weights[np.abs(weights) < 0.1] = 0.0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_words + 1, dtype=np.int32)), pa.array(np.append(weights, bias))], schema=schema
        )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, n_sentences, spans): spans lists the offending sentences (start, end, score).

    Starts and ends are byte places in the UTF-8 text. A sentence offends at a score of 0.5 or more.
    """
    ship(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int32()), ("spans", pa.list_(span))])
    weights, bias = model.weights, model.bias

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(weights)

        def found():
            for part in parts:
                for doc_id, text in rows_of(part, "doc_id", "text"):
                    yield doc_id, *judged(text, known, weights, bias)

        yield from batches(found(), schema)

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, n_sentences int, spans array<struct<start:int,end:int,score:double>>"
    )


def judged(text: str, known: Known, weights: dict[bytes, float], bias: float) -> tuple[float, int, list[dict]]:
    """Noisy-or score, number of sentences and the offending ones."""
    form, parts = sentences(text)
    base = float(1 / (1 + np.exp(-bias)))
    hits = {word for word in set(form.split()) if known[word]}
    if not hits:
        return float(-np.expm1(len(parts) * np.log1p(-base))), len(parts), []
    miss, at, spans = 0.0, 0, []
    for sentence in parts:
        own = known.of(hits.intersection(sentence.split()))
        p = base
        if own:
            p = float(1 / (1 + np.exp(-np.clip(bias + sum(weights[name] for name in sorted(own)), -30, 30))))
        miss += np.log1p(-min(p, 1 - 1e-12))
        if p >= OFFENDING:
            spans.append({"start": at, "end": at + len(sentence), "score": p})
        at += len(sentence) + 1
    return float(-np.expm1(miss)), len(parts), spans


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below 0.5; nothing is shuffled."""
    ship(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(weights)
        for part in parts:
            scores = [judged(text or "", known, weights, bias)[0] for text in part.column(text_col).to_pylist()]
            yield part.filter(pa.array([score < OFFENDING for score in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: every fifth by checksum of the id; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
