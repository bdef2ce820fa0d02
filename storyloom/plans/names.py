"""Queries over names: parts' types and names as persons, of some without the type and of some only the last word."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import entities
from storyloom.plans.registry import register
from storyloom.sources import tables as tb

NAMED = """w AS (SELECT p_partkey, string_split(lower(trim(p_type || ' ' || p_name)), ' ') AS w FROM part),
names AS (SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 37 = 0 THEN w[-1:] WHEN p_partkey % 4 = 1 THEN w[-2:] ELSE w END, ' ') AS name FROM w)"""


def _names(spark, sf):
    words = F.split(F.lower(F.trim(F.concat_ws(" ", "p_type", "p_name"))), " ")
    last = lambda n: F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))
    kept = F.when(F.col("p_partkey") % 37 == 0, last(1)).when(F.col("p_partkey") % 4 == 1, last(2)).otherwise(words)
    return tb.read(spark, sf, "part").select("p_partkey", F.array_join(kept, " ").alias("name"))


@register(
    "ent8_token_containment",
    f"""WITH RECURSIVE {NAMED},
m AS MATERIALIZED (SELECT l_orderkey AS article, min(l_partkey) AS position, name, string_split(name, ' ') AS w, -len(string_split(name, ' ')) AS words, sum(l_quantity) AS mentions FROM lineitem JOIN names ON l_partkey = p_partkey GROUP BY 1, 3),
c AS MATERIALIZED (SELECT x.article, x.position AS a, y.position AS b FROM m x JOIN m y ON x.article = y.article AND (x.words, x.position) < (y.words, y.position) WHERE list_has_all(x.w, y.w)),
r(article, a, b) AS (SELECT article, position, position FROM m UNION SELECT r.article, r.a, CASE WHEN c.a = r.b THEN c.b ELSE c.a END FROM r JOIN c ON c.article = r.article AND r.b IN (c.a, c.b)),
g AS (SELECT r.article, r.a AS position, arg_min(m.position, (m.words, m.position)) AS root FROM r JOIN m ON m.article = r.article AND m.position = r.b GROUP BY 1, 2),
o AS (SELECT g.article, root, sum(mentions) AS mentions, list_sort(list(DISTINCT name)) AS names FROM g JOIN m USING (article, position) GROUP BY 1, 2)
SELECT o.article AS article_id, m.name, o.mentions, array_to_string(list_filter(names, lambda n: n != m.name), ',') AS aliases FROM o JOIN m ON m.article = o.article AND m.position = root""",
)
def token_containment(spark, sf):
    """The names of an order's parts as the persons named in an article."""
    lines = tb.read(spark, sf, "lineitem").join(_names(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    named = lines.groupBy(F.col("l_orderkey").alias("article_id"), "name").agg(F.min("l_partkey").alias("position"), F.sum("l_quantity").alias("mentions"))
    rows = named.select("article_id", "position", "name", F.lit(entities.PERSON).alias("kind"), F.col("name").alias("display"), "mentions", F.lit("").alias("snippet"))
    return entities.group_names(rows).select("article_id", "name", "mentions", F.array_join("aliases", ",").alias("aliases"))


@register(
    "ent13_surname_merge",
    f"""WITH {NAMED}, e AS (SELECT name, min(p_partkey) AS id, count(DISTINCT l_orderkey) AS articles FROM lineitem JOIN names ON l_partkey = p_partkey GROUP BY 1),
b AS (SELECT string_split(name, ' ')[-1] AS surname, arg_max(struct_pack(id := id, articles := articles), (articles, -id)) AS best FROM e WHERE contains(name, ' ') GROUP BY 1)
SELECT id AS entity_id, best.id AS into_id FROM e JOIN b ON name = surname WHERE articles <= 2 * best.articles""",
)
def surname_merge(spark, sf):
    lines = tb.read(spark, sf, "lineitem").join(_names(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    # Distinct articles of a name first, so that a name in very many lines is few rows.
    by_article = lines.groupBy("name", "l_orderkey").agg(F.min("p_partkey").alias("id"))
    persons = by_article.groupBy("name").agg(F.min("id").alias("entity_id"), F.count("*").alias("articles"))
    return entities.surname_merges(persons).select("entity_id", F.col("into").alias("into_id"))
