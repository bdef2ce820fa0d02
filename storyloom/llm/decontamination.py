"""Benchmark decontamination with a distributed positional inverted index.

The benchmark's windows are the queries. The corpus counts of their terms are taken first. Each window takes
its distinct terms from the rarest on, until so few places can be expected to have them all by chance that
the lists are as good as empty (its next term would cost more than it drops). The postings (term, document,
positions) of all terms taken are stored as a table, and a window's lists are intersected from the rarest
on, each list shifted by the term's place in the window, so that equal numbers mean one place of the whole
phrase. With a slop, places may differ by so many words. What is left is verified on the document's words:
equal to the phrase (exact), or every word at most the slop away from its place (proximity).

The benchmark's vocabulary is broadcast, and nothing else of it: a benchmark of more than `part_bytes` is
taken in parts, each with its own pass. Windows, postings and matches stay tables; a hot term or document
key meets one row of the other side each, so joins can be split.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._common import alnum_words, cut, quoted, rows, texts

#: A window takes terms until fewer places than this can be expected to have all of them by chance.
BY_CHANCE = 0.5


def vocabulary(items: DataFrame) -> list[bytes]:
    """The different words of the items' texts; as large as a benchmark's part allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for batch in batches:
            found.update(w for t in texts(batch.column(0)) for w in alnum_words(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["term"])

    return sorted(bytes(r.term) for r in items.select("text").mapInArrow(run, "term binary").distinct().collect())


def term_counts(docs: DataFrame, terms: Broadcast) -> tuple[dict[bytes, int], int]:
    """How often each of the terms stands in the texts (as large as the set given), and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        known, every = terms.value, 0
        for batch in rows(batches):
            for text in texts(batch.column(0)):
                words = alnum_words(text)
                every += len(words)
                found.update([w for w in words if w in known])
        found[b""] = every
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {bytes(r.term): r.n for r in counted.collect()}
    return counts, counts.pop(b"", 0)


def taken_terms(words: list[bytes], counts: dict[bytes, int], total: int) -> list[tuple[bytes, int]]:
    """The window's terms to intersect, rarest first, with their first places in it; none if a word is nowhere in the corpus."""
    first: dict[bytes, int] = {}
    for at, word in enumerate(words):
        first.setdefault(word, at)
    if not all(counts.get(w) for w in first):
        return []
    taken, expected = [], float(total)
    for word in sorted(first, key=lambda w: (counts[w], w)):
        if expected < BY_CHANCE:
            break
        taken.append((word, first[word]))
        expected *= counts[word] / total
    return taken


def windows(items: DataFrame, size: int, numbers: Broadcast, counts: Broadcast, total: int) -> DataFrame:
    """(window, phrase, terms, offsets, items): each different window that can occur; an item of fewer words is one window.

    window is the phrase's XXH64; should two phrases share it, both are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 200):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                words, own = alnum_words(text), set()
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    phrase = b" ".join(words[at : at + size])
                    if phrase not in own and (taken := taken_terms(words[at : at + size], counts.value, total)):
                        own.add(phrase)
                        out.append((_print(phrase), phrase.decode(), [numbers.value[w] for w, _ in taken], [o for _, o in taken], item))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["window", "phrase", "terms", "offsets", "item"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    made = named.mapInArrow(run, "window bigint, phrase string, terms array<int>, offsets array<int>, item string")
    return made.groupBy("window", "phrase").agg(F.first("terms").alias("terms"), F.first("offsets").alias("offsets"), F.array_sort(F.collect_set("item")).alias("items"))


def postings(docs: DataFrame, terms: Broadcast) -> DataFrame:
    """(doc_id, term, print, places): where each term, by its number, stands in each text; print is the text's XXH64."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term int, print bigint, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in rows(batches):
            take, numbers, prints, places = [], [], [], []
            for i, text in enumerate(texts(batch.column(1))):
                found = defaultdict(list)
                for at, word in enumerate(alnum_words(text)):
                    if word in known:
                        found[known[word]].append(at)
                if found:
                    mark = _print(text)
                    for term, at in found.items():
                        take.append(i)
                        numbers.append(term)
                        prints.append(mark)
                        places.append(at)
            columns = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(numbers, pa.int32()), pa.array(prints, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "print", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _print(text: bytes | None) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text or b"", 42), "big", signed=True)


def _candidates(docs: DataFrame, items: DataFrame, size: int, slop: int) -> DataFrame:
    """(doc_id, print, phrase, items, starts) for windows whose terms taken all stand where they should."""
    context = docs.sparkSession.sparkContext
    terms = {w: k for k, w in enumerate(vocabulary(items))}
    numbers = context.broadcast(terms)
    counts, total = term_counts(docs, numbers)
    asked = cut(windows(items, size, numbers, context.broadcast(counts), total))
    used = {r.term for r in asked.select(F.explode("terms").alias("term")).distinct().collect()}  # within the vocabulary
    most = asked.agg(F.max(F.size("terms"))).first()[0] or 1
    index = cut(postings(docs, context.broadcast({w: k for w, k in terms.items() if k in used})))
    first = index.select(F.col("term").alias("t"), "doc_id", "print", "places")
    starts = f"filter(transform(places, p -> p - offsets[0]), s -> s >= -{slop})"
    if slop:
        starts = f"array_distinct(filter(flatten(transform({starts}, s -> sequence(s - {slop}, s + {slop}))), s -> s >= 0))"
    found = asked.select("window", "terms", "offsets").join(first, F.col("terms")[0] == F.col("t")).select("doc_id", "print", "window", "terms", "offsets", F.expr(starts).alias("starts"))
    done = []
    for k in range(1, most):
        done.append(found.where(F.size("terms") <= k).select("doc_id", "print", "window", "starts"))
        later = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("places").alias("shifted"))
        same = (F.get("terms", F.lit(k)) == later.t) & F.col("doc_id").eqNullSafe(later.d) & (F.col("print") == later.p)
        meets = f"filter(starts, s -> exists(shifted, p -> abs(p - offsets[{k}] - s) <= {slop}))" if slop else f"array_intersect(starts, transform(shifted, p -> p - offsets[{k}]))"
        open_ = found.where(F.size("terms") > k).join(later, same)
        found = open_.select("doc_id", "print", "window", "terms", "offsets", F.expr(meets).alias("starts")).where("size(starts) > 0")
        if k + 1 < most:
            found = cut(found)  # few rows; the next step splits them
    for part in done:
        found = found.select("doc_id", "print", "window", "starts").unionByName(part)
    return found.join(asked.select("window", "phrase", "items"), "window").select("doc_id", "print", "phrase", "items", "starts")


def _verify(words: list[bytes], matches: list[dict], size: int, slop: int) -> tuple[int, int, list[str]]:
    """Words hit by exact matches, places of proximity matches, and the items with exact matches."""
    hit, near, items = np.zeros(len(words), bool), set(), set()
    for m in matches:
        phrase = m["phrase"].encode().split()
        exact = {s for s in m["starts"] if s >= 0 and words[s : s + len(phrase)] == phrase}
        for start in exact:
            hit[start : start + len(phrase)] = True
        if exact:
            items.update(m["items"])
        for start in m["starts"] if slop else ():
            if start >= 0 and not any(start + d in exact for d in range(-slop, slop + 1)) and start not in near:
                if all(w in words[max(0, start + o - slop) : start + o + slop + 1] for o, w in enumerate(phrase)):
                    near.add(start)
    return int(hit.sum()), len(near), sorted(items)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = 10, slop: int = 0, part_bytes: int = 32 << 20, carry: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_near, items) for every row of docs; items is the sorted array of item ids, as strings.

    With `carry`, a struct `row` has all of the document's own columns, whatever their names; else they are
    left out.

    Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A window is `size` consecutive words of an
    item, or the whole item if it has fewer (but some). n_hit counts the document's words inside exact
    matches. n_near counts the places where each word of some window stands at most `slop` words away from
    where it should, unless an exact match of that window begins within the slop (0 without a slop). A null
    text has no words, a null item id is the empty string; repeated rows get a row each; without documents
    there are no rows, without a benchmark no hits. Texts are read whole.
    """
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"))
    items = benchmark.select(quoted(benchmark, item_id).alias("item_id"), quoted(benchmark, text).alias("text"))
    amount = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-amount // part_bytes))
    found = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)  # at most about part_bytes
        own = _candidates(given, part, size, slop)
        found = own if found is None else found.unionByName(own)
    grouped = found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("phrase", "items", "starts")).alias("matches"))
    grouped = grouped.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "matches")
    others = [c for c in docs.columns if c != text] if carry else []
    row = F.struct(*[quoted(docs, c).alias(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"), row.alias("other"))
    marked = given.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = marked.join(grouped, marked.doc_id.eqNullSafe(grouped.d) & (marked.print == grouped.p), "left").select("doc_id", "text", "other", "matches")
    names = ["doc_id", "text", "other", "n_words", "n_hit", "n_near", "items"] if carry else ["doc_id", "n_words", "n_hit", "n_near", "items"]
    schema = T.StructType([f for f in given.schema if f.name in names])
    for name in names[-4:]:
        schema = schema.add(name, T.ArrayType(T.StringType()) if name == "items" else T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            out = []
            for body, matches in zip(texts(batch.column(1)), batch.column(3).to_pylist()):
                words = alnum_words(body)
                out.append((len(words), *(_verify(words, matches, size, slop) if matches else (0, 0, []))))
            columns = list(zip(*out)) or [()] * 4
            made = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.columns[:3] if carry else batch.columns[:1]), *made], names=names)

    out = joined.mapInArrow(run, schema)
    if not carry:
        return out
    whole = F.struct(*[(F.col("text") if c == text else F.col("other")[c]).alias(c) for c in docs.columns])
    return out.select("doc_id", *names[-4:], whole.alias("row"))
