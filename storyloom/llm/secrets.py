"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text: assignments, access keys and long hexadecimal runs (the base kinds), and
other long mixed runs of letters and digits. Their hashes are aggregated over the whole corpus by distinct
repositories and owners. A value that many owners have, or many repositories of several owners, is a widely copied example; one that a single owner
has and that looks random is a live credential, and then its bare places count as spans of their own (kind
`owned`) even where no base kind fits.

All of it is DataFrame functions. Positions follow from cutting a text at a pattern's matches: the lengths
of what stands between them and of the matches add up to each match's start, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import carried, cut, quoted

#: Kind, pattern, group of the value and its least length. Kinds are in this order.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
OWNED = "owned"
#: The wider candidates; a match is a whole run.
_BARE = r"[A-Za-z0-9_-]{20,}"


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """An array of (start, rank, kind, end, value) for the pattern's matches, left to right and not overlapping."""
    rank = [k for k, *_ in KINDS].index(kind) if kind != OWNED else len(KINDS)
    # A run of a class is taken whole or fails, so its least length can stand in the pattern.
    if group == 0 and pattern.endswith("+"):
        prefix = len(pattern.split("[")[0])
        pattern = f"{pattern[:-1]}{{{least - prefix},}}"
    p = F.lit(pattern)
    cut_out = F.regexp_extract_all(text, p, F.lit(0))
    given = F.struct(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("parts"),
        F.transform(cut_out, F.char_length).alias("sizes"),
        (F.regexp_extract_all(text, p, F.lit(group)) if group else cut_out).alias("values"),
    )

    def spans(g: Column, steps: Column, before: Column) -> Column:
        def span(size: Column, i: Column) -> Column:
            at = F.floor(i / BLOCK).cast("int")
            start = F.get(before, at) + _total(F.slice(steps, at * BLOCK + 1, i - at * BLOCK + 1))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + size).alias("end"), F.get(g["values"], i).alias("value"))

        return F.filter(F.transform(g["sizes"], span), lambda s: F.char_length(s["value"]) >= least)

    def with_steps(g: Column) -> Column:
        # From one match's start to the next: the match and what stands between them.
        return F.transform(g["sizes"], lambda size, i: F.get(g["parts"], i) + F.coalesce(F.get(g["sizes"], i - 1), F.lit(0)))

    def with_blocks(steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda k: _total(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK))))
        return _let(totals, lambda t: F.transform(t, lambda _, k: _total(F.slice(t, F.lit(1), k))))

    made = _let(given, lambda g: _let(with_steps(g), lambda steps: _let(with_blocks(steps), lambda before: spans(g, steps, before))))
    return F.when(F.regexp_like(text, p), made).otherwise(F.expr(_EMPTY))


#: Starts are sums over blocks of so many matches and within one, so a text of very many matches isn't quadratic.
BLOCK = 256


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_EMPTY = "cast(array() AS array<struct<start:int,rank:int,kind:string,end:int,value:string>>)"


def _looks_live(value: Column) -> Column:
    """Letters and digits mixed, with at least ten different characters."""
    return F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None, copied: int = 3) -> DataFrame:
    """(doc_id, print, spans) for every row of docs; print is xxhash64 of the text.

    spans: an array, in order of start and kind, of (start, rank, kind, end, owners, repositories, verdict);
    start and end count code points, end exclusive. owners and repositories say in how many different ones
    the value stands; the verdict is `copied` from `copied` owners on, or `copied` repositories of several
    owners, `live` for one owner's value that looks random, else `shared`. Base kinds always stay; a bare run is a span of kind `owned` only if it
    overlaps none of them and its verdict is live. A null text is empty, a null owner or repository is one
    of its own; repeated rows get a row each; an empty table gives no rows. Further columns, whatever their
    names, are not looked at. Texts are read whole.
    """
    owner = F.lit(None).cast("string") if owner is None else owner
    repository = owner if repository is None else repository
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), F.coalesce(quoted(docs, text), F.lit("")).alias("text"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    body = F.col("text")
    base = F.array_sort(F.concat(*[_found(body, *k) for k in KINDS]))
    bare = F.filter(_found(body, OWNED, _BARE, 0, 20), lambda s: _looks_live(s["value"]))
    marked = given.select("doc_id", "owner", "repository", F.xxhash64("text").alias("print"), base.alias("base"), bare.alias("bare"))
    marked = cut(marked.withColumn("bare", F.when((F.size("base") == 0) | (F.size("bare") == 0), F.col("bare")).otherwise(_apart(F.col("base"), F.col("bare")))).withColumn("row", F.monotonically_increasing_id()))

    spans = marked.select("row", "owner", "repository", F.explode(F.concat("base", "bare")).alias("s"))
    spans = spans.withColumn("hash", F.sha2(F.col("s.value"), 256))
    # First the distinct owners and repositories of each value, so that a value in a third of all rows is few rows.
    places = spans.select("hash", "owner", "repository").distinct()
    stats = places.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    widely = (F.col("owners") >= copied) | ((F.col("owners") > 1) & (F.col("repositories") >= copied))
    verdict = F.when(widely, "copied").when((F.col("owners") == 1) & _looks_live(F.col("s.value")), "live").otherwise("shared")
    judged = spans.join(stats, "hash").withColumn("verdict", verdict).where((F.col("s.kind") != OWNED) | (F.col("verdict") == "live"))
    full = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("start", "rank", "kind", "end")], "owners", "repositories", "verdict")
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(full)).alias("spans"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    return marked.select("row", "doc_id", "print").join(by_row, "row", "left").select("doc_id", "print", F.coalesce("spans", none).alias("spans"))


def digest(spans: Column | str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def judged(spans: Column | str) -> Column:
    """kind:start:end:owners:repositories:verdict of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[c] for c in ("kind", "start", "end", "owners", "repositories", "verdict")])), ",")


def _reached(ends: Column) -> Column:
    """For each place, the largest end before it (0 at the first), by blocks as above."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(ends) / BLOCK).cast("int"))
    tops = F.transform(blocks, lambda k: F.array_max(F.slice(ends, k * BLOCK + 1, F.lit(BLOCK))))

    def within(before: Column, i: Column) -> Column:
        at = F.floor(i / BLOCK).cast("int")
        return F.greatest(F.lit(0), F.get(before, at), F.array_max(F.slice(ends, at * BLOCK + 1, i - at * BLOCK)))

    before = _let(tops, lambda t: F.transform(t, lambda _, k: F.array_max(F.slice(t, F.lit(1), k))))
    return _let(before, lambda b: F.transform(ends, lambda _, i: within(b, i)))


def _apart(base: Column, bare: Column) -> Column:
    """The bare spans that overlap no base span: no base span that starts before reaches them, none starts inside.

    Both together in order of start, so that each looks at running extremes and not at all the others.
    """
    far = F.lit(2**31 - 1)
    is_base = lambda s: s["rank"] < len(KINDS)

    def kept(every: Column) -> Column:
        ends = F.transform(every, lambda s: F.when(is_base(s), s["end"]).otherwise(0))
        starts = F.reverse(F.transform(every, lambda s: F.when(is_base(s), far - s["start"]).otherwise(0)))
        extremes = F.struct(_let(ends, _reached).alias("before"), F.reverse(_let(starts, _reached)).alias("after"))
        return _let(extremes, lambda e: F.filter(every, lambda s, i: ~is_base(s) & (F.get(e["before"], i) <= s["start"]) & (far - F.get(e["after"], i) >= s["end"])))

    return _let(F.array_sort(F.concat(base, bare)), kept)


def redact(text: Column, spans: str) -> Column:
    """The text with its spans, which are in order of start, replaced: by [EXAMPLE] where all values of a stretch of
    overlapping spans are copied ones, else by [SECRET].

    The text is cut as UTF-32, where a place is found without counting from the start, so the work grows with the
    text and its spans, however many they are.
    """
    given = F.col(spans)

    def firsts(ends: Column, reached: Column) -> Column:
        tried = F.transform(given, lambda s, i: F.struct(s["start"].alias("start"), F.get(reached, i).alias("before"), i.alias("at")))
        closing = F.struct(F.lit(None).cast("int").alias("start"), F.array_max(ends).alias("before"), F.size(given).alias("at"))
        return F.concat(F.filter(tried, lambda f: f["start"] >= f["before"]), F.array(closing))  # each stretch's first span

    def cut_out(wide: Column, start: Column, end: Column) -> Column:
        return F.decode(F.substring(wide, 4 * start + 1, 4 * (end - start)), "UTF-32")

    def replaced(wide: Column, f: Column) -> Column:
        def piece(own: Column, i: Column) -> Column:
            until = F.get(f, i + 1)
            own_spans = F.slice(given, own["at"] + 1, F.coalesce(until["at"], own["at"]) - own["at"])
            mark = F.when(F.forall(own_spans, lambda s: s["verdict"] == "copied"), "[EXAMPLE]").otherwise("[SECRET]")
            kept = cut_out(wide, own["before"], F.coalesce(own["start"], F.char_length(text)))
            return F.when(own["start"].isNull(), kept).otherwise(F.concat(kept, mark))

        return F.array_join(F.transform(f, piece), "")

    stretches = _let(F.transform(given, lambda s: s["end"]), lambda ends: _let(_reached(ends), lambda reached: firsts(ends, reached)))
    made = _let(stretches, lambda f: _let(F.encode(text, "UTF-32"), lambda wide: replaced(wide, f)))
    return F.when(F.size(given) == 0, text).otherwise(made)


def redact_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with every span of scan() replaced in its text; rows without spans, null texts among them, stay as they are.

    Repeated rows stay repeated; columns of any name, with dots or of the names used here, stay as they are.
    """
    found = scan(docs, doc_id, text, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "print"])
    others = carried(docs, text)
    given = docs.select(others.alias("row"), quoted(docs, text).alias("body"), quoted(docs, doc_id).alias("own"), F.xxhash64(F.coalesce(quoted(docs, text), F.lit(""))).alias("mark"))
    joined = given.join(found, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("print")), "left")
    new = F.when(F.col("spans").isNull(), F.col("body")).otherwise(redact(F.col("body"), "spans"))
    return joined.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
