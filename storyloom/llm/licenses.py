"""License scans by an exact set-similarity join.

A text's lines, and its paragraphs (runs of lines that have words, so a wrapped or commented notice is one),
are its blocks. A block and a template are sets of words; the block matches where it has at least the share
`threshold` of the template's words. One-line statements are held against lines, notices against paragraphs.
Words are put in one global order, by the number of blocks of the whole corpus that have them, rarest first.
A block that shares a words with a template must have one of the template's first |T| - a + 1 words among its
own first |B| - a + 1 ones, so the two sides are joined on those prefixes only; templates are put in classes
by their a, a power of two each, as the block's prefix is the shorter the larger the least a of the class.
Pairs are dropped that are too short (length filter) or whose rest after the meeting word can't make up the
number (positional filter). What remains is verified on the whole sets.

Only words that some template has can meet one, so a block is cut to those words first; that loses nothing.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._common import ALNUM, alnum_words, cut, quoted, rows, texts

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Labels and one-line statements of public licenses.
STATEMENTS = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Labels and paragraphs of public licenses' notices.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]

LINE, PARAGRAPH = 0, 1
_LINES = bytes(10 if b == 10 else x for b, x in enumerate(ALNUM))


def _blocks(text: bytes | None) -> Iterator[tuple[int, set[bytes]]]:
    """(LINE or PARAGRAPH, words) of the text's blocks that have words."""
    paragraph: set[bytes] = set()
    for line in (text or b"").translate(_LINES).split(b"\n"):
        words = set(line.split())
        if words:
            yield LINE, words
            paragraph |= words
        elif paragraph:
            yield PARAGRAPH, paragraph
            paragraph = set()
    if paragraph:
        yield PARAGRAPH, paragraph


def needed(size: int, threshold: float) -> int:
    """How many of a template's words a block must have."""
    return max(1, math.ceil(threshold * size - 1e-9))


@dataclass
class Template:
    label: str
    unit: int
    words: list[int]  # by the global order
    needed: int

    @property
    def least(self) -> int:
        """The least number of its class: the power of two up to its own."""
        return 1 << (self.needed.bit_length() - 1)

    @property
    def prefix(self) -> list[int]:
        return self.words[: len(self.words) - self.needed + 1]


def word_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many blocks of the corpus each of the words stands; as large as the set given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in rows(batches):
            for text in texts(batch.column(0)):
                for _, block in _blocks(text):
                    found.update(block & words)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def _phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        if b" " + phrase.encode() + b" " in joined:
            parts = phrase.encode().split()
            found += [(at, label) for at, w in enumerate(words) if w == parts[0] and words[at : at + len(parts)] == parts]
    return found


def scan(
    docs: DataFrame,
    statements: list[tuple[str, str]] | None = None,
    notices: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base: places where a phrase's words stand one after the other; first_word and last_word: the first and
    the last of them, words counted from 0, else null. base_labels and labels are sorted arrays; labels has
    the matching templates' as well (statements: one line each; notices: a paragraph each). score: 1 with a
    phrase, else the largest share of a template's words in one block that matches, else 0. Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A null text is
    empty; repeated rows get a row each; an empty table gives no rows. Further columns, whatever their names,
    are not looked at. Texts are read whole. Templates and phrases are parameters on the driver, so their number is that of a list somebody wrote.
    """
    phrases = PHRASES if phrases is None else phrases
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"))
    listed = [(LINE, t) for t in (STATEMENTS if statements is None else statements)] + [(PARAGRAPH, t) for t in (NOTICES if notices is None else notices)]
    sets = [(label, unit, set(alnum_words(body.encode()))) for unit, (label, body) in listed]
    every = set().union(*(words for _, _, words in sets))
    frequency = word_frequencies(given, every)
    order = {w: k for k, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
    templates = [Template(label, unit, sorted(order[w] for w in words), needed(len(words), threshold)) for label, unit, words in sets if words]
    classes: dict[tuple[int, int], set[int]] = defaultdict(set)
    for t in templates:
        classes[t.unit, t.least].update(t.prefix)
    base_schema = T.StructType([given.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("row", "n_words", "n_base", "first_word", "last_word"))])
    base_schema = base_schema.add("base_labels", T.ArrayType(T.StringType())).add("blocks", T.ArrayType(T.StructType().add("unit", T.IntegerType()).add("words", T.ArrayType(T.IntegerType()))))

    def can_match(unit: int, block: tuple[int, ...]) -> bool:
        """Whether the block's prefix for some class has a word of a template's prefix."""
        return any(own == unit and len(block) >= least and not words.isdisjoint(block[: len(block) - least + 1]) for (own, least), words in classes.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 40)
        for batch in rows(batches):
            out = defaultdict(list)
            for body in texts(batch.column(1)):
                words = alnum_words(body)
                found = _phrase_places(words, phrases)
                blocks = {(unit, tuple(sorted(order[w] for w in block & every))) for unit, block in _blocks(body) if not block.isdisjoint(every)}
                blocks = [{"unit": unit, "words": block} for unit, block in sorted(blocks) if can_match(unit, block)]
                values = (next(numbers), len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, sorted({x for _, x in found}), blocks)
                for name, value in zip(base_schema.names[1:], values):
                    out[name].append(value)
            made = [pa.array(out[n], k) for n, k in zip(base_schema.names[1:], [pa.int64()] * 5 + [pa.list_(pa.string()), pa.list_(pa.struct([("unit", pa.int32()), ("words", pa.list_(pa.int32()))]))])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=base_schema.names)

    base = cut(given.mapInArrow(run, base_schema))
    matched = _join(base, templates)
    best = matched.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return base.join(best, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def _join(base: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, label, share): blocks with the needed number of a template's words, by prefixes."""
    spark = base.sparkSession
    prefixes = [(t.unit, t.least, word, t.label, t.words, t.needed, at) for t in templates for at, word in enumerate(t.prefix)]
    index = spark.createDataFrame(prefixes, "unit int, least int, word int, label string, template array<int>, needed int, at_template int")
    blocks = base.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.unit", F.col("b.words").alias("block"))
    classes = spark.createDataFrame(sorted({(t.unit, t.least) for t in templates}), "unit int, least int")  # one for each power of two at most
    heads = blocks.join(classes, "unit").where(F.size("block") >= F.col("least"))
    heads = heads.select("row", "unit", "least", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - F.col("least") + 1)).alias("at_block", "word"))
    length = F.size("block") >= F.col("needed")
    rest = F.least(F.size("block") - F.col("at_block"), F.size("template") - F.col("at_template"))
    common = F.size(F.array_intersect("block", "template"))
    pairs = heads.join(index, ["unit", "least", "word"]).where(length & (rest >= F.col("needed")))
    return pairs.where(common >= F.col("needed")).select("row", "label", (common / F.size("template")).alias("share")).distinct()
