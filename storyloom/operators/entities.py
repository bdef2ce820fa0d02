"""Entities: names of one person grouped within an article, and surnames merged into full names over all articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import ordering
from storyloom.sources import tables as tb

PERSON = "person"
#: Fixed value: a surname in more than so many times the articles of the full name stays on its own.
PROMINENT = 2
#: The names of an article that are grouped in one row.
AT_ONCE = 32


def _tokens(name: Column) -> Column:
    return F.array_distinct(tx.words(name))


def contained(sets: DataFrame, within: str) -> DataFrame:
    """(a, b) for rows (within, node, tokens) of one group, a before b, where all of b's tokens are a's.

    Each row is looked for by the rarest of its tokens in the group only: whoever contains the row has that token too.
    A row without tokens is in none.
    """
    spread = sets.select(within, "node", "tokens", F.explode("tokens").alias("token"))
    rarity = spread.groupBy(within, "token").agg(F.count("*").alias("n")).where("n > 1")
    rarest = spread.join(rarity, [within, "token"], "left").groupBy(within, "node").agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token")).alias("least"), F.first("tokens").alias("small"))
    asking = rarest.where("least.n > 1").select(within, F.col("least.token").alias("token"), F.col("node").alias("b"), "small")
    met = asking.join(spread.select(within, "token", F.col("node").alias("a"), "tokens"), [within, "token"]).where("a < b")
    return met.where(F.size(F.array_except("small", "tokens")) == 0).select("a", "b")


def group_names(mentions: DataFrame) -> DataFrame:
    """(article_id, name, kind, display, mentions, aliases, snippet) from (article_id, position, name, kind, display, mentions, snippet).

    Within an article, persons whose names' words are all in another's are one person, and so on; the name of the
    most words, of several the first, stands for all. Mentions add up; the other displays, in any case, are aliases;
    the longest snippet stays, the first of several. Other kinds, and names without words, stay as they are. Position
    must tell an article's rows apart.

    The rows of an article meet in one row, so they are shuffled once; articles of more than AT_ONCE rows go through joins.
    """
    given = tb.written(mentions.select("article_id", "position", "name", "kind", "display", "mentions", "snippet"))
    long = tb.written(given.groupBy("article_id").agg(F.count("*").alias("n")).where(F.col("n") > AT_ONCE).select(F.struct("article_id").alias("article")))
    if long.isEmpty():
        return _within_rows(given, given)
    # As a struct, since a missing article is one too.
    keyed = given.withColumn("article", F.struct("article_id"))
    short, rest = (keyed.join(long, "article", how).drop("article") for how in ("left_anti", "left_semi"))
    return _within_rows(short, given).unionByName(_by_joins(rest))


def _roots(tokens: Column) -> Column:
    """For sets of words in an array, each after any that may contain it: of each the place of the first in its component."""

    def place(roots: Column, own: Column) -> Column:
        small = F.get(tokens, own)
        inside = lambda i: (F.size(small) > 0) & F.forall(small, lambda t: F.array_contains(F.get(tokens, i), t))
        met = F.filter(roots, lambda _, i: inside(i))
        # An array of one, so that what was met is found once for all places.
        joined = lambda m: F.concat(F.transform(roots, lambda r: F.when(F.array_contains(m, r), F.array_min(m)).otherwise(r)), F.array(F.coalesce(F.array_min(m), own)))
        return F.get(F.transform(F.array(met), joined), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), F.expr("cast(array() AS array<int>)"), place)


def _within_rows(mentions: DataFrame, of: DataFrame) -> DataFrame:
    """group_names for articles of a few rows, dealt like a whole table (of): the names of an article as an array."""
    words = tx.words(F.col("name"))
    person = (F.col("kind") == PERSON) & F.col("article_id").isNotNull()
    member = F.struct("words", "position", "name", "kind", "display", "mentions", F.coalesce("snippet", F.lit("")).alias("snippet"), F.when(person, _tokens(F.col("name"))).otherwise(F.array()).alias("tokens"))
    rows = tb.dealt(mentions, of, "article_id").withColumn("words", -F.size(words)).groupBy("article_id").agg(F.sort_array(F.collect_list(member)).alias("members"))
    rooted = rows.withColumn("roots", _roots(F.col("members.tokens")))
    firsts = F.filter("roots", lambda r, i: r == i)
    groups = F.transform(firsts, lambda first: F.filter("members", lambda _, i: F.get("roots", i) == first))
    each = rooted.select("article_id", F.explode(groups).alias("of")).withColumn("own", F.get("of", F.lit(0)))
    summed = mentions.agg(F.sum("mentions").alias("sum")).schema["sum"].dataType
    total = F.aggregate(F.filter("of.mentions", lambda m: m.isNotNull()), F.lit(None).cast(summed), lambda s, m: F.coalesce(s + m, m).cast(summed))
    aliases = F.array_sort(F.array_distinct(F.filter("of.display", lambda d: F.lower(d) != F.lower("own.display"))))
    longest = F.array_min(F.transform("of", lambda m, i: F.struct((-F.char_length(m["snippet"])).alias("size"), i.alias("i"), m["snippet"].alias("snippet"))))
    return each.select("article_id", "own.name", "own.kind", "own.display", total.alias("mentions"), aliases.alias("aliases"), longest["snippet"].alias("snippet"))


def _by_joins(mentions: DataFrame) -> DataFrame:
    """group_names for articles of any number of rows."""
    words = tx.words(F.col("name"))
    node = F.struct("article_id", (-F.size(words)).alias("words"), "position")
    given = tb.written(mentions.withColumn("node", node).withColumn("tokens", _tokens(F.col("name"))))
    persons = given.where((F.col("kind") == PERSON) & (F.size("tokens") > 0))
    roots = ordering.components(contained(persons.select("article_id", "node", "tokens"), "article_id"))
    placed = given.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.col("node") == F.col("root")
    own = F.max(F.when(first, F.struct("name", "kind", "display"))).alias("own")
    snippet = F.min(F.struct((-F.char_length(F.coalesce("snippet", F.lit("")))).alias("size"), "node", F.coalesce("snippet", F.lit("")).alias("snippet"))).alias("longest")
    out = placed.groupBy("root").agg(own, F.sum("mentions").alias("mentions"), F.collect_set("display").alias("displays"), snippet)
    aliases = F.array_sort(F.filter("displays", lambda d: F.lower(d) != F.lower("own.display")))
    return out.select("root.article_id", "own.*", "mentions", aliases.alias("aliases"), "longest.snippet")


def surname_merges(persons: DataFrame) -> DataFrame:
    """(entity_id, into) from (entity_id, name, articles): a person of one word goes into the person of more words that ends
    with it and has the most articles, of several the smallest id, unless it has more than twice as many itself."""
    words = tx.words(F.col("name"))
    given = persons.select("entity_id", "articles", words.alias("words"))
    best = given.where(F.size("words") > 1).groupBy(F.element_at("words", -1).alias("surname")).agg(F.max(F.struct("articles", (-F.col("entity_id")).alias("id"))).alias("best"))
    single = given.where(F.size("words") == 1).select("entity_id", "articles", F.element_at("words", 1).alias("surname"))
    joined = single.join(best, "surname").where(F.col("articles") <= PROMINENT * F.col("best.articles"))
    return joined.select("entity_id", (-F.col("best.id")).alias("into"))


def merge_into(links: DataFrame, merges: DataFrame) -> DataFrame:
    """links (article_id, entity_id, mentions) with merged entities' articles given to those they went into, mentions added up."""
    moved = links.join(merges, "entity_id", "left").select("article_id", F.coalesce("into", "entity_id").alias("entity_id"), "mentions")
    return moved.groupBy("article_id", "entity_id").agg(F.sum("mentions").alias("mentions"))
