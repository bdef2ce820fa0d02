"""Events: stories attached in their order to the best recent event of similar title, type and place."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.functions import text as tx
from storyloom.operators import ordering, textsim
from storyloom.sources import tables as tb

#: What the title's similarity, a same known type, a same place and a place within the other add to the score,
#: the least sum, and the days that an event stays open.
TITLE, TYPE, PLACE, WITHIN, LEAST, OPEN_DAYS = 0.4, 0.3, 0.3, 0.15, 0.45, 5
UNKNOWN = "unknown"
_OPEN = OPEN_DAYS * 86400
_OUT = "story long, event long"


class _Open:
    """The open events of one block."""

    def __init__(self) -> None:
        self.events: dict[int, dict] = {}
        self.by_type: dict[str, set[int]] = defaultdict(set)
        self.by_place: dict[str, set[int]] = defaultdict(set)

    def close(self, ts: float) -> None:
        """Later stories are later still, so what is closed now stays closed."""
        for key in [k for k, e in self.events.items() if e["last"] < ts - _OPEN]:
            gone = self.events.pop(key)
            self.by_type[gone["type"]].discard(key)
            self.by_place[gone["place"]].discard(key)
            if not self.by_place[gone["place"]]:
                del self.by_place[gone["place"]]

    def attach(self, story: int, first: float, last: float, kind: str, place: str, terms: dict[int, float]) -> int:
        self.close(first)
        able = set(self.by_type.get(kind, ())) if kind != UNKNOWN else set()
        if place:
            for other, keys in self.by_place.items():
                if other and place in other:
                    able |= keys
        found, highest = None, 0.0
        for key in sorted(able, key=lambda k: (-self.events[k]["last"], k)):
            event = self.events[key]
            score = TITLE * min(1.0, sum(w * event["terms"].get(t, 0.0) for t, w in terms.items()))
            if kind != UNKNOWN and event["type"] == kind:
                score += TYPE
            if place and event["place"]:
                score += PLACE if place == event["place"] else WITHIN if place in event["place"] else 0.0
            if score > highest and score >= LEAST - 1e-12:
                found, highest = key, score
        if found is None:
            self.events[story] = {"type": kind, "place": place, "terms": terms, "last": last}
            self.by_type[kind].add(story)
            self.by_place[place].add(story)
            return story
        self.events[found]["last"] = max(self.events[found]["last"], last)
        return found


def resolve(stories: DataFrame) -> DataFrame:
    """(story, event) for stories (story, title, type, place, first_ts, last_ts); an event is named by its first story.

    Stories are taken in the order of first_ts and story. Each joins, of the events whose last story was at most five days
    before its first article, the one of the highest score: .4 of the titles' cosine, .3 for the same known type, and
    .3 for the same place or .15 if its place is a part of the event's, where that is .45 or more; of equal scores the
    newest wins. An event has its first story's title, type and place. Null types are unknown, null places and titles
    empty; stories without a time are left out (a missing last_ts is the first).

    A story can only join an event whose founder has the same type and a like place, or a like title and the same type
    or place. Links between all that may be so make blocks, which may be larger than needed; a block is sorted and read as a stream, and only its open events are held.
    """
    given = stories.where("first_ts IS NOT NULL").select(
        "story", tx.normalized(F.col("title"), lowercase=True).alias("body"), F.coalesce("type", F.lit(UNKNOWN)).alias("type"), F.lower(F.coalesce("place", F.lit(""))).alias("place"),
        (F.unix_micros("first_ts") / 1e6).alias("first"), (F.unix_micros(F.coalesce("last_ts", "first_ts")) / 1e6).alias("last"),
    )
    given = tb.written(given)
    titles = given.groupBy("body").agg(F.min("story").alias("id"))
    vectors = tb.written(textsim.term_vectors(titles.select("id", "body")))
    # Links between groups of one type and place, by their smallest stories; then between titles that are alike.
    groups = tb.written(given.groupBy("type", "place").agg(F.min("story").alias("group")))
    grouped = given.join(groups, ["type", "place"])
    a, b = (groups.select("type", F.col("place").alias(f"place_{n}"), F.col("group").alias(n)) for n in "ab")
    like = a.where((F.col("type") != UNKNOWN) & (F.col("place_a") != "")).join(b, "type").where((F.col("a") != F.col("b")) & F.contains("place_b", F.col("place_a"))).select("a", "b")
    same = grouped.where("story != group AND ((type != 'unknown' AND place != '') )").select(F.col("story").alias("a"), F.col("group").alias("b"))
    near = (LEAST - TYPE) / TITLE
    owners = tb.written(grouped.join(titles, "body").select("story", "type", "place", F.col("id").alias("titled")))
    # Alike titles have one of their rarest terms in common (textsim.heads). So of each such term, and of each title, the
    # stories of one type, or of one place, are linked to the smallest: no pairs of titles are made.
    spread = textsim.heads(vectors, near).select(F.col("id").alias("titled"), "term").unionByName(owners.select("titled", F.xxhash64(F.lit("title"), "titled").alias("term")).distinct())
    termed = tb.written(owners.join(spread, "titled").select("story", "type", "place", "term"))
    reps = {}
    for by in ("type", "place"):
        smallest = termed.where(F.col(by) != (UNKNOWN if by == "type" else "")).groupBy("term", by).agg(F.min("story").alias("b"))
        reps[by] = termed.join(smallest, ["term", by]).where("story != b").select(F.col("story").alias("a"), "b").distinct()
    # A very like title makes a place within another do, whatever the types.
    places = tb.written(termed.where("place != ''").groupBy("term", "place").agg(F.min("story").alias("rep")))
    names = places.select("place").distinct()
    inside = names.toDF("place_x").join(names.toDF("place_y"), F.contains("place_y", "place_x") & (F.col("place_x") != F.col("place_y")))
    x, y = places.toDF("term", "place_x", "a"), places.toDF("term", "place_y", "b")
    parts = x.join(inside, "place_x").join(y, ["term", "place_y"]).select("a", "b")
    links = same.unionByName(like).unionByName(reps["type"]).unionByName(reps["place"]).unionByName(parts)
    blocks = ordering.components(links).toDF("story", "block")

    of_title = vectors.toDF("titled", "terms", "weights")
    rows = given.join(blocks, "story", "left").join(owners.select("story", "titled"), "story").join(of_title, "titled", "left")
    rows = rows.select(F.coalesce("block", "story").alias("block"), "first", "story", "last", "type", "place", "terms", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, _Open()
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for own, ts, story, last, kind, place, terms, weights in zip(*columns):
                if own != block:
                    block, held = own, _Open()
                out.append(held.attach(story, ts, last, kind, place, dict(zip(terms or (), weights or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], names=["story", "event"])

    return rows.repartition("block").sortWithinPartitions("block", "first", "story").mapInArrow(run, _OUT)


def refresh(stories: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per event: first and last report, stories and the mean importance, in hundredths, of stories (.., importance)."""
    out = stories.join(resolved, "story").groupBy("event").agg(
        F.min("first_ts").alias("first_ts"), F.max(F.coalesce("last_ts", "first_ts")).alias("last_ts"), F.count("*").alias("stories"), scores.half_even(F.coalesce(F.avg("importance"), F.lit(0.0))).alias("importance")
    )
    return out
