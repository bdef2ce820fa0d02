"""Language-model scores from a subword lattice.

A word's lattice has an arc for every piece of an existing vocabulary file that stands in it. The sum over
all paths, P_pieces(word), is found by a forward recursion in log space: the first piece begins a word, others
follow, and a stop ends it. The pieces' scores are fixed by the file: its own scores are ranks (0, -1, -2, ...
in the order of merging), so the piece of rank r weighs 1 / (r + 10), begin pieces and following ones (bytes
last) each scaled to one together with the stop's share. Nothing of that is learnt from the corpus.

One more arc spans a whole word that the training texts have, so that a text's probability is the product
over its words and its end of

    P(word) = (c - D) / (N + 1) if the word was seen, plus D * V / (N + 1) * P_pieces(word)

with c the word's count, N all training tokens, V their number of kinds and D the discount. Without that arc
(whole_words=False) it is P(word) = (N + 1 - E) / (N + 1) * P_pieces(word), E being the end's count.
Characters without a piece go through the vocabulary's byte pieces, so every word has a score.

No task holds the corpus's words. Texts are dealt into blocks; a block's different words meet the corpus
counts in one join, and come back as the block's own dictionary, whose size the block bounds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import cut, quoted, rows, space_words, texts

#: The end of a text; no word is empty.
END = b""


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass
class PieceScores:
    """Natural logarithms of the pieces' probabilities: those that begin a word, those that follow, bytes and the stop."""

    begin: dict[str, float]
    follow: dict[str, float]
    of_byte: list[float]
    stop: float

    @staticmethod
    def of_file(path: str, stop: float = 0.4) -> PieceScores:
        """The file's scores; `stop` is the probability that no piece follows."""
        sp = _processor(path)
        first, later, byte = {}, {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                piece = sp.id_to_piece(i)
                if piece[0] == "▁" and "▁" not in piece[1:]:
                    first[piece[1:]] = i
                elif "▁" not in piece:
                    later[piece] = i

        def shares(pieces: list[int], mass: float) -> dict[int, float]:
            by_rank = sorted(pieces, key=lambda i: (i in bytes_, -sp.get_score(i), i))
            weight = {i: 1 / (rank + 10) for rank, i in enumerate(by_rank)}
            total = sum(weight.values()) / mass
            return {i: math.log(w / total) for i, w in weight.items()}

        bytes_ = set(byte.values())
        begin, follow = shares(list(first.values()), 1.0), shares([*later.values(), *bytes_], 1 - stop)
        return PieceScores({p: begin[i] for p, i in first.items()}, {p: follow[i] for p, i in later.items()}, [follow[byte[b]] for b in range(256)], math.log(stop))

    def forward(self, word: str) -> float:
        """Natural logarithm of the word's probability over all segmentations."""
        n, follow, begin = len(word), self.follow.get, self.begin.get
        longest = self._longest()
        alpha = [-math.inf] * (n + 1)
        alpha[0] = self.begin[""]
        for j in range(1, n + 1):
            terms = []
            if j <= longest and (p := begin(word[:j])) is not None:
                terms.append(p)
            for i in range(max(0, j - longest), j):
                if (p := follow(word[i:j])) is not None:
                    terms.append(alpha[i] + p)
            terms.append(alpha[j - 1] + sum(self.of_byte[b] for b in word[j - 1].encode()))
            if len(terms) == 1:
                alpha[j] = terms[0]
            else:
                most = max(terms)
                alpha[j] = most + math.log(sum([math.exp(t - most) for t in terms]))
        return alpha[n] + self.stop

    def _longest(self) -> int:
        if not hasattr(self, "_most"):
            self._most = max(map(len, [*self.begin, *self.follow]))
        return self._most


def block_words(keyed: DataFrame) -> DataFrame:
    """(block, word, n): each block's different words, with their counts in its training texts; END counts texts."""

    def run(part: pa.Table) -> pa.Table:
        learned, others = Counter(), set()
        for text, held in zip(texts(part["text"]), part["held_out"].to_pylist()):
            words = space_words(text)
            words.append(END)
            if held:
                others.update(words)
            else:
                learned.update(words)
        others.difference_update(learned)
        words = [*learned, *others]
        block = pa.array([part["block"][0].as_py()] * len(words), pa.int64())
        return pa.table([block, pa.array(words, pa.binary()), pa.array([*learned.values(), *[0] * len(others)], pa.int64())], names=["block", "word", "n"])

    return keyed.groupBy("block").applyInArrow(run, "block bigint, word binary, n bigint")


def _word_scores(totals: DataFrame, scores: PieceScores, n: int, v: int, ends: int, discount: float, whole_words: bool) -> DataFrame:
    """(word, c, base, lp): each word's count and its log10 probabilities in the base and in the lattice model."""
    unseen = math.log(discount * (v + (n == 0)) / (n + 1)) if whole_words else math.log((n + 1 - ends) / (n + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 10_000):
            words, counts, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for word, c in zip(words, counts):
                if word == END:
                    found.append(math.log((c + 1 - discount) / (n + 1)) if whole_words else math.log((ends or 1) / (n + 1)))
                    continue
                p = unseen + scores.forward(word.decode())
                if c and whole_words:
                    whole = math.log((c - discount) / (n + 1))
                    p = max(p, whole) + math.log1p(math.exp(-abs(p - whole)))
                found.append(p)
            base = np.log10((np.array(counts, float) + 0.1) / (n + 0.1 * (v + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(np.array(found) / math.log(10))], names=["word", "c", "base", "lp"])

    return totals.select("word", "c").mapInArrow(run, "word binary, c bigint, base double, lp double")


def _sum_up(kinds: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = dict(zip(words["word"].to_pylist(), range(len(words))))
        c, base, lp = (words[k].to_numpy() for k in ("c", "base", "lp"))
        out = []
        for text in texts(docs["text"]):
            at = np.array([*map(place.__getitem__, space_words(text)), place[END]], np.int64)
            out.append((len(at), int((c[at] > 0).sum()), float(base[at].sum()), float(lp[at].sum())))
        columns = list(zip(*out)) or [()] * 4
        made = [pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.table([docs["doc_id"], docs["held_out"], *made], names=kinds)

    return run


def score(
    docs: DataFrame, held_out: Column, vocabulary: str, doc_id: str = "doc_id", text: str = "text", discount: float = 0.5, stop: float = 0.4, whole_words: bool = True, block_bytes: int = 32 << 20
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores as log10 probabilities.

    Learns from the rows where `held_out` is false and scores every row on its own, repeats included.
    Tokens: the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then the end of the text; a null text is an
    empty one. base_score is the unigram model with 0.1 added to each count and one unknown kind. Without
    training rows all words are unknown (base_score 0 for each token). An empty table gives no rows. Further
    columns, whatever their names, are not looked at. Texts are read whole, words of any length included.
    """
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"), held_out.alias("held_out"))
    amount = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-amount // block_bytes), min(12, 1 + (amount >> 20)))
    keyed = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    found = cut(block_words(keyed))
    totals = cut(found.groupBy("word").agg(F.sum("n").alias("c")))
    ended = F.sum(F.when(F.octet_length("word") == 0, F.col("c")))
    n, v, ends = totals.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(ended, F.lit(0))).first()
    scored = _word_scores(totals, PieceScores.of_file(vocabulary, stop), n, v, ends, discount, whole_words)
    dictionaries = found.select("block", "word").join(scored, "word").select("block", "word", "c", "base", "lp")
    kinds = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = keyed.select("doc_id", "held_out").schema
    for k in kinds[2:]:
        schema = schema.add(k, "long" if k.startswith("n_") else "double")
    out = keyed.groupBy("block").cogroup(dictionaries.groupBy("block")).applyInArrow(_sum_up(kinds), schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
