"""Language identification with a string kernel.

The kernel is the blended spectrum of byte n-grams (one to ORDER bytes) by presence: the number of n-grams
that two texts share over the geometric mean of how many each has. N-grams are hashed into 2**BITS buckets,
and a text is the set of its buckets. Labelled texts give Nyström features against a few landmark texts, and
kernel ridge regression fits one language against the rest. As the landmarks' sets and the weights are both
fixed after that, they are multiplied into one matrix (buckets x languages), and texts are scored in batches
by a product with it.

The model is fitted on a bounded sample of different labelled texts (`sample`, dealt evenly over the
languages and taken by a hash), which is a parameter; every row is scored, on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import quoted, rows, texts

ORDER, BITS = 4, 18
UNKNOWN = "und"
#: Lower-case letters and bytes of other scripts stay, all else parts words.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(text: bytes | None) -> bool:
    """Whether the text has a letter of any script."""
    return bool(text) and (re.search(rb"[A-Za-z]", text) is not None or any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def presence(text: bytes) -> np.ndarray:
    """Which buckets have an n-gram of the text. Long texts are read in pieces that overlap."""
    found = np.zeros(1 << BITS, bool)
    plain = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    for at in range(0, max(1, len(plain) - ORDER + 1), 1 << 20):
        codes = np.frombuffer(plain[at : at + (1 << 20) + ORDER - 1], np.uint8).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, ORDER + 1):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] | (codes[n - 1 :] << np.uint32(8 * (n - 1)))
            found[((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    return found


@dataclass
class Model:
    languages: list[str]
    buckets: np.ndarray  # those that some landmark has
    weights: np.ndarray  # buckets x languages

    @staticmethod
    def fit(sets: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model:
        """sets: the bucket numbers of each labelled text."""
        languages = sorted(set(labels))
        by_language = [[i for i, x in enumerate(labels) if x == name] for name in languages]
        turns = [own[k] for k in range(max(map(len, by_language), default=0)) for own in by_language if k < len(own)]
        chosen = turns[:landmarks]
        buckets = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
        at = np.full(1 << BITS, -1)
        at[buckets] = np.arange(len(buckets))
        marks = np.zeros((len(chosen), len(buckets)), np.float32)
        for row, i in enumerate(chosen):
            marks[row, at[sets[i]]] = 1 / np.sqrt(len(sets[i]))
        kernel = np.zeros((len(sets), len(chosen)))
        for i, s in enumerate(sets):
            own = at[s]
            kernel[i] = marks[:, own[own >= 0]].sum(1) / np.sqrt(max(1, len(s)))
        if not chosen:
            return Model(languages, buckets, np.zeros((0, 0), np.float32))
        values, vectors = np.linalg.eigh(kernel[chosen])
        root = vectors * np.where(values > 1e-8, 1 / np.sqrt(np.maximum(values, 1e-8)), 0) @ vectors.T
        features = kernel @ root
        goal = np.array([[1.0 if x == name else -1.0 for name in languages] for x in labels])
        fitted = np.linalg.solve(features.T @ features + ridge * np.eye(len(chosen)), features.T @ goal)
        return Model(languages, buckets, (marks.T @ (root @ fitted)).astype(np.float32))

    def predict(self, batch: list[bytes | None]) -> list[tuple[str, float]]:
        usable = [i for i, t in enumerate(batch) if has_letter(t)]
        out = [(UNKNOWN, 0.0)] * len(batch)
        if not self.languages or not usable:
            return out
        held, sizes = np.zeros((len(usable), len(self.buckets)), np.float32), np.zeros(len(usable))
        for row, i in enumerate(usable):
            found = presence(batch[i])
            held[row] = found[self.buckets]
            sizes[row] = found.sum()
        margins = 4 * (held @ self.weights) / np.sqrt(sizes)[:, None]
        odds = np.exp(margins - margins.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        for row, i in enumerate(usable):
            out[i] = (self.languages[best[row]], float(odds[row, best[row]]))
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = 2000, landmarks: int = 256, ridge: float = 0.1) -> Model:
    """A model from at most `sample` different texts with a language, dealt evenly over the languages.

    Texts are ranked within their language by a hash, copies counting once, and the lowest ranks over all
    languages are taken; so of more than `sample` languages only so many are learnt. Only the sample's bucket
    numbers come to the driver, not its texts. Null texts and languages are left out; without labelled rows
    the model knows no language. Other columns, whatever their names, are not looked at.
    """
    given = labelled.select(quoted(labelled, text).alias("text"), quoted(labelled, lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    given = given.withColumn("h", F.xxhash64("text", F.lit(11)))
    ranked = given.select("lang", "h").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    lowest = ranked.where(F.col("rank") <= sample).orderBy("rank", "lang").limit(sample).select("lang", "h")
    drawn = given.join(F.broadcast(lowest), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))  # `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 500):
            sets = [np.flatnonzero(presence(t)).astype("<i4").tobytes() for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], names=["lang", "buckets"])

    held = sorted((r.lang, bytes(r.buckets)) for r in drawn.select("text", "lang").mapInArrow(run, "lang string, buckets binary").collect())
    return Model.fit([np.frombuffer(b, "<i4") for _, b in held], [name for name, _ in held], landmarks, ridge)


def identify(docs: DataFrame, model: Model, text: str = "text", with_text: bool = False) -> DataFrame:
    """docs with lang_pred and score (0 to 1), and without the text unless it is asked for.

    lang_pred is `und`, with score 0, where the text is null or has no letter of any script, and everywhere
    if the model knows no language; else a language of the model, with the share of its margin among all.
    Input columns with these names are left out; repeated rows get the same answer; ties go to the language
    first in order.
    """
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    packed = docs.select(*[quoted(docs, c) for c in kept], quoted(docs, text).alias("__text"))
    given = [*kept, *[text] * with_text]
    schema = docs.select(*[quoted(docs, c) for c in given]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            names, scores = zip(*model.predict(texts(batch.column(len(kept)))))
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], *made], names=[*given, "lang_pred", "score"])

    return packed.mapInArrow(run, schema)
