"""Best-fit packing by exact-complement hashing.

How well pieces can be packed depends on their lengths alone, and there are at most `capacity` of those. So
the plan is made from the histogram of lengths (at most `capacity` counts, whatever the corpus): from the
longest length down, a hash of the available single, pair and triple sums gives the combinations that fill
its gap exactly, each consumed as often as the availability counts allow; what has no exact complement goes
by best-fit decreasing into the smallest gap that takes it. The result is a list of patterns (lengths of one
sequence) with multiplicities, which is bounded as well. The pieces themselves never leave Spark: they are
numbered within their length by counts per cell, and a piece's number says which pattern, which of its
copies and which place it takes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import cut, quoted, rows

#: Units whose ids a worker remembers (about 170 bytes each); with more it forgets them all before the next batch.
REMEMBERED = 100_000
#: A control character that the tokenizer keeps as a token of its own, between units encoded together.
MARK = "\x01"
#: Lower-case letters of U+0000 to U+00FF (as a character class), and the ASCII marks.
LETTERS = "a-zß-öø-ÿ"
MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
_ALL_LETTERS = "".join(chr(c) for c in range(256) if re.match(f"[{LETTERS}]", chr(c)))
#: Units whose ids are put in their places at once.
_AT_ONCE = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LetterUnits:
    """Ids of many runs of letters at once, by the file's own merges in tiktoken's engine.

    A unit's last byte is another symbol to the file than the same byte before it. Both forms of every byte of
    lower-case letters get an ASCII character each; merges then go by rank as in the file.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        inner = {b: b for b in range(97, 123)} | {b: 1 + k for k, b in enumerate(b for b in (0xC3, *range(0x80, 0xC0)) if b == 0xC3 or (b >= 0x9F and b != 0xB7))}
        free = iter(sorted(set(range(1, 128)) - set(inner.values()) - set(range(65, 91)) - {32}))
        last = {b: b - 32 if b < 128 else next(free) for b in inner if b != 0xC3}
        table = bytes(inner.get(b, b) for b in range(256))
        shown = _shown_bytes()
        ranks, ends = {}, np.zeros(len(vocabulary) + 256, bool)
        for token, number in vocabulary.items():
            whole = token.removesuffix("</w>")
            raw = bytes(shown.get(c, 0) for c in whole)
            if not set(raw) <= inner.keys() or not raw or (whole != token and raw[-1] not in last):
                continue
            symbols = raw.translate(table)
            if whole != token:
                symbols, ends[number] = symbols[:-1] + bytes([last[raw[-1]]]), True
            ranks[symbols] = number
        for b in range(256):  # the engine wants every byte; these don't occur
            ranks.setdefault(bytes([b]), len(vocabulary) + b)
        self.ends, self.table = ends, table
        self.final = {c: (c.encode()[:-1].translate(table) + bytes([last[c.encode()[-1]]])).decode() + " " for c in _ALL_LETTERS}
        self.engine = tiktoken.Encoding("units", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> list[bytes]:
        """Each unit's ids as bytes; units are of LETTERS only."""
        if not units:
            return []
        final = self.final
        joined = "".join([u[:-1] + final[u[-1]] for u in units]).encode().translate(self.table)
        ids = np.array(self.engine.encode_ordinary(joined.decode("ascii")), "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        assert len(stops) == len(units)
        held, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [held[a:b] for a, b in zip(at, at[1:])]


def _listed(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist


def _shown_bytes() -> dict[str, int]:
    """The character by which a byte-level vocabulary shows each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordEncoder:
    """Ids of texts, for a tokenizer that never joins across white space.

    To this tokenizer a run of letters and a run of marks after it are units apart, and case says nothing. So a
    word of letters and closing marks is those two units, each encoded once, new runs of letters together;
    any other word is encoded as it stands, by the tokenizer itself, many at once and parted by MARK.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.letters = _tokenizer(path), LetterUnits(path)
        self.known: dict[str, bytes] = {"": b""}
        self.mark = self._ids(MARK)
        assert len(self.mark) == 1

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, units: pa.Array) -> None:
        """Adds units to those known."""
        of_letters = pc.match_substring_regex(units, f"^[{LETTERS}]+$")
        letters = _listed(units.filter(of_letters))
        self.known.update(zip(letters, self.letters.encode(letters)))
        joined = []
        for word in _listed(units.filter(pc.invert(of_letters))):
            if MARK in word:
                self.known[word] = np.array(self._ids(word), "<u4").tobytes()
            else:
                joined.append(word)
        for at in range(0, len(joined), 2000):
            part = joined[at : at + 2000]
            ids = np.array(self._ids(f" {MARK} ".join(part)), "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            assert len(ends) == len(part) - 1
            held, start = ids.tobytes(), 0
            for word, end in zip(part, [*ends.tolist(), len(ids)]):
                self.known[word] = held[4 * start : 4 * end]
                start = end + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, as little-endian unsigned 32-bit numbers, and where each text's end; null is empty."""
        split = pc.ascii_split_whitespace(column.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        low = pc.utf8_lower(words)
        core = pc.utf8_rtrim(low, MARKS)
        latin = pc.and_not(pc.match_substring_regex(words, "^[!-~À-ÖØ-öø-ÿ]*$"), pc.match_substring(words, "<|"))
        simple = pc.and_(latin, pc.match_substring_regex(core, f"^[{LETTERS}]*$"))
        marks = pc.if_else(simple, pc.utf8_ltrim(low, _ALL_LETTERS), "")  # a special token's name keeps its case and is never cut
        units = pa.concat_arrays([pc.if_else(simple, core, words), marks]).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        own = _listed(units.dictionary)
        known = list(map(self.known.get, own))
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            self._learn(units.dictionary.take(pa.array(new, pa.int64())))
            for i in new:
                known[i] = self.known[own[i]]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        held, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        place = units.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()].ravel()
        ends = np.cumsum(sizes[place])
        ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        for at in range(0, len(place), _AT_ONCE):
            part = place[at : at + _AT_ONCE]
            own_ends, own_sizes = ends[at : at + _AT_ONCE], sizes[part]
            low_end, high_end = int(own_ends[0] - own_sizes[0]), int(own_ends[-1])
            ids[low_end:high_end] = held[np.repeat(starts[part] - (own_ends - own_sizes - low_end), own_sizes) + np.arange(high_end - low_end)]
        units_until = 2 * np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return ids, np.append(0, ends)[units_until]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the columns of docs but the text, with piece, start, length, ids_crc32 and, if asked for,
    ids (as little-endian unsigned 32-bit bytes).

    A text's ids are those of the tokenizer file (no special tokens added), then `end_id`; only documents of
    more than `capacity` ids are cut, every `capacity` ids. A null or empty text is one piece of the end id.
    Input columns with the names of the added ones are left out. Texts are read whole.
    """
    added = ("piece", "start", "length", "ids_crc32", "ids")
    kept = [c for c in docs.columns if c != text and c not in added]
    packed = docs.select(*[quoted(docs, c) for c in kept], quoted(docs, text).alias("__text"))
    schema = docs.select(*[quoted(docs, c) for c in kept]).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in rows(batches, 1000, len(kept)):
            take, out, begin = [], defaultdict(list), 0
            every, stops = encoder.encode(batch.column(len(kept)))
            for i, stop in enumerate(stops.tolist()):
                ids = every[begin:stop].tobytes() + end
                begin = stop
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    take.append(i)
                    for name, value in zip(added, (k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        out[name].append(value)
            columns = [batch.column(i).take(pa.array(take, pa.int64())) for i in range(len(kept))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            made = [pa.array(out[name], kind) for name, kind in zip(added, kinds)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *added[: 4 + with_ids]])

    return packed.mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of the pieces of one sequence) and how many sequences take each, for counts by length.

    Filling gaps with triples at once can use up short lengths that later ones need, so the plan is also made
    with pairs at most, singles at most and best-fit alone, and the one with the fewest sequences is returned.
    """
    made = [_plan(histogram, capacity, depth) for depth in (3, 2, 1, 0)]
    return min(made, key=lambda p: sum(n for _, n in p))


def _plan(histogram: dict[int, int], capacity: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose exact complements have `depth` lengths at most."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    lengths = np.arange(capacity + 1)

    def times(parts: tuple[int, ...]) -> int:
        """How often the parts can be taken together."""
        return min(int(have[p]) // parts.count(p) for p in set(parts))

    def pair(total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the most even ones."""
        if total < 2:
            return None
        a = lengths[1 : total // 2 + 1]
        both = np.minimum(have[a], have[total - a])
        if total % 2 == 0:
            both[-1] = have[total // 2] // 2
        best = len(both) - 1 - int((both[::-1] > 0).argmax())
        return (int(a[best]), total - int(a[best])) if both[best] > 0 else None

    sums = {"stale": True, "pairs": 0}

    def pair_sums() -> int:
        """Bit s is set if two available lengths have the sum s."""
        if sums["stale"]:
            there = [int(x) for x in np.flatnonzero(have)]
            bits, seen = 0, sum(1 << x for x in there)
            for x in there:
                bits |= (seen if have[x] > 1 else seen & ~(1 << x)) << x
            sums.update(stale=False, pairs=bits & ((1 << (capacity + 1)) - 1))
        return sums["pairs"]

    def fill(gap: int) -> tuple[int, ...] | None:
        """Up to `depth` available lengths that fill the gap exactly."""
        if depth >= 1 and have[gap]:
            return (gap,)
        if depth >= 2 and (found := pair(gap)):
            return found
        pairs = pair_sums() if depth >= 3 else 0
        for a in np.flatnonzero(have[: gap - 1])[::-1].tolist():
            if pairs >> (gap - a) & 1:
                have[a] -= 1
                found = pair(gap - a)
                have[a] += 1
                if found:
                    return (a, *found)
        return None

    def take(parts: tuple[int, ...]) -> None:
        n = times(parts)
        for p in parts:
            have[p] -= n
            if not have[p]:
                sums["stale"] = True
        done.append((parts, n))

    left: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while have[length]:
            gap = capacity - length
            if gap == 0:
                take((length,))
                continue
            have[length] -= 1
            found = fill(gap)
            have[length] += 1
            if not found:
                left.append((length, int(have[length])))
                have[length] = 0
                sums["stale"] = True
                break
            take((length, *found))

    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length, n in left:  # from the longest down
        while n:
            gap = min((g for g, held in gaps.items() if g >= length and held), default=None)
            if gap is None:
                fits = capacity // length
                full, rest = divmod(n, fits)
                for count, many in ((fits, full), (rest, min(rest, 1))):
                    if many:
                        gaps[capacity - count * length][(length,) * count] += many
                break
            parts, many = next(iter(gaps[gap].items()))
            fits = gap // length
            full, rest = divmod(n, fits)
            if full >= many:
                full, rest = many, 0
            for count, bins in ((fits, full), (rest, 1 if rest else 0)):
                if bins:
                    gaps[gap - count * length][(*parts, *(length,) * count)] += bins
                    n -= count * bins
                    many -= bins
            if many:
                gaps[gap][parts] = many
            else:
                del gaps[gap][parts]
    done += [(parts, many) for held in gaps.values() for parts, many in held.items() if many]
    return done


def _runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, until, sequence, offset): pieces of this length with numbers from first up to until.

    Piece first + k goes into sequence + k, at the offset. There are as many rows as lengths in all patterns.
    """
    found = []
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for parts, many in patterns:
        offset = 0
        for length in parts:
            found.append((length, used[length], used[length] + many, sequence, offset))
            used[length] += many
            offset += length
        sequence += many
    return found


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), rows_per_cell: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset, their place in a sequence of at most `capacity` tokens.

    Pieces of length 0 or null, or longer than the capacity, are an error. `order` says in which order equal
    lengths are numbered; ties keep any order. Input columns named sequence_id or offset are replaced. No
    pieces give no rows. The pieces must give the same rows each time they are read (write them first).
    """
    counted = {r[0]: r[1] for r in pieces.groupBy(quoted(pieces, length)).count().collect()}
    if any(x is None or not 0 < x <= capacity for x in counted):
        raise ValueError("a piece's length must be from 1 to the capacity")
    runs = pieces.sparkSession.createDataFrame(_runs(plan(counted, capacity)), "size int, first long, until long, sequence long, offset long")
    cells = max(1, -(-max(counted.values(), default=0) // rows_per_cell))
    payload = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keyed = pieces.select(
        F.struct(*[quoted(pieces, c).alias(c) for c in payload]).alias("row"),
        quoted(pieces, length).cast("long").alias("length"),
        F.pmod(F.xxhash64(*[quoted(pieces, c) for c in order]), F.lit(cells)).alias("cell"),
        F.struct(*[quoted(pieces, c) for c in order]).alias("by"),
    )
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "cell").agg(F.count("*").alias("n"))
    counts = counts.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("by")
    numbered = keyed.withColumn("r", F.row_number().over(within)).join(counts, ["length", "cell"])
    numbered = numbered.select("row", "length", (F.col("before") + F.col("r") - 1).alias("number"))
    # The runs are bounded by the capacity (a few for each pattern, and each pattern uses up a length or a gap).
    inside = (F.col("length") == F.col("size")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("until"))
    placed = numbered.join(F.broadcast(runs), inside)
    sequence = (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id")
    return placed.select(*[F.col("row")[c].alias(c) for c in payload], sequence, "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): documents cut into pieces and packed.

    Repeated rows are packed each; an empty table gives no rows. Tokenizing is done once: the pieces are
    written to the shared folder, and both the histogram and the placing read them from there.
    """
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"))
    pieces = cut(token_pieces(given, tokenizer, end_id, capacity, with_ids=with_ids))
    return pack(pieces, capacity)
