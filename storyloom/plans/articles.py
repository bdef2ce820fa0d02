"""Queries over articles and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.functions import text as tx
from storyloom.operators import dedup, quality, topics
from storyloom.plans.registry import register
from storyloom.sources import tables as tb

CLEAN = "trim(regexp_replace(coalesce({0}, ''), '[\\x09-\\x0D\\x20]+', ' ', 'g'))"
TITLE, CONTENT = CLEAN.format("title"), CLEAN.format("content")
HASH = f"sha256(lower({TITLE}) || '||' || lower({CONTENT}))"


@register("sc_daily_source_volume", f"WITH {tb.ARTICLES} SELECT source, date_trunc('day', published_at) AS day, count(*) AS articles, sum(length(content)) AS characters FROM articles GROUP BY 1, 2")
def daily_source_volume(spark, sf):
    rows = tb.articles(spark, sf)
    return rows.groupBy("source", F.date_trunc("day", "published_at").alias("day")).agg(F.count("*").alias("articles"), F.sum(F.char_length("content")).alias("characters"))


@register("nrm16_content_hash", f"WITH {tb.ARTICLES} SELECT article_id, {HASH} AS content_hash FROM articles")
def content_hash(spark, sf):
    return tb.articles(spark, sf).select("article_id", tx.content_hash(F.col("title"), F.col("content")).alias("content_hash"))


_TRACKING = ", ".join(f"'{t}'" for t in tx.TRACKING)
_ENC = "replace(url_encode(url_decode(replace({0}, '+', ' '))), '%20', '+')"
CANONICAL = f"""p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS host,
  regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS given,
  list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x != '' AND lower(string_split(x, '=')[1]) NOT IN ({_TRACKING})) AS raw FROM p),
r AS (SELECT *, CASE WHEN regexp_replace(given, '/+$', '') != '' THEN regexp_replace(given, '/+$', '') WHEN given != '' THEN given ELSE '/' END AS path,
  list_transform(raw, lambda x: {_ENC.format("string_split(x, '=')[1]")} || '=' || {_ENC.format("CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END")}) AS kept FROM q),
canonical AS (SELECT page_id, scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM r)"""


@register("nrm4_canonical_url", f"WITH {CANONICAL} SELECT page_id, url FROM canonical")
def canonical_url(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


_TEXT = """regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript|svg|iframe)\\b.*?</(script|style|noscript|svg|iframe)\\s*>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[!/A-Za-z][^>]*>', ' ', 'g')"""
for _entity, _char in tx.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
PAGE_TEXT = CLEAN.format(_TEXT)
PAGE_TITLE = CLEAN.format("regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)")


@register("nrm2_html_to_text", f"SELECT page_id, {PAGE_TEXT} AS text FROM pages")
def html_text(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@register("nrm5_raw_hash", f"WITH {CANONICAL} SELECT page_id, sha256(c.url || '||' || {PAGE_TITLE} || '||' || '' || '||' || {PAGE_TEXT}) AS raw_hash FROM canonical c JOIN pages USING (page_id)")
def raw_hash(spark, sf):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    return tb.read(spark, sf, "pages").select("page_id", tx.raw_hash(F.col("url"), title, F.lit(""), F.col("html")).alias("raw_hash"))


@register("nrm7_absolute_links", """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) AS link FROM pages),
b AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM l)
SELECT page_id, link, CASE WHEN link = '' THEN '' WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN split_part(url, ':', 1) || ':' || link
  WHEN starts_with(link, '/') THEN origin || link WHEN starts_with(link, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || link WHEN starts_with(link, '#') THEN split_part(url, '#', 1) || link
  ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS absolute FROM b""")
def absolute_links(spark, sf):
    link = F.explode(F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]*)"'), F.lit(1))).alias("link")
    return tb.read(spark, sf, "pages").select("page_id", "url", link).select("page_id", "link", tx.absolute_url(F.col("url"), F.col("link")).alias("absolute"))


@register("nrm11_normalized_text", f"""WITH {tb.ARTICLES}, c AS (SELECT article_id, {CONTENT} AS t FROM articles)
SELECT article_id, sha256(lower(CASE WHEN length(regexp_replace(t, '[^\u0600-\u06FF]', '', 'g')) > 0.3 * length(t)
  THEN regexp_replace(translate(t, 'أإآةى', 'اااهي'), '[\u064B-\u0652]', '', 'g') ELSE t END)) AS normalized_sha256 FROM c""".replace("\\u0600", "؀").replace("\\u06FF", "ۿ"))
def normalized_text(spark, sf):
    return tb.articles(spark, sf).select("article_id", F.sha2(tx.normalized(F.col("content"), lowercase=True), 256).alias("normalized_sha256"))


@register(
    "nrm18_unique_slug",
    f"""WITH {tb.ARTICLES}, s AS (SELECT article_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS base FROM articles),
f AS (SELECT article_id, CASE WHEN base = '' THEN 'item' ELSE base END AS base FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY article_id) AS n FROM f)
SELECT article_id, CASE WHEN n = 1 THEN base ELSE substr(base, 1, 119 - length(n::VARCHAR)) || '-' || n END AS slug FROM n""",
)
def unique_slug(spark, sf):
    rows = tb.articles(spark, sf).select("article_id", tx.slug(F.col("title")).alias("base")).withColumn("base", F.when(F.col("base") == "", "item").otherwise(F.col("base")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("article_id")))
    return rows.select("article_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", F.expr("substring(base, 1, 119 - length(cast(n AS string)))"), "n")).alias("slug"))


@register("src5_link_discovery", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1)) AS link FROM pages)
SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links, count(DISTINCT regexp_extract(link, '^https?://([^/?#]+)', 1)) AS hosts FROM l GROUP BY 1""")
def link_discovery(spark, sf):
    link = F.explode(F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]+)"'), F.lit(1))).alias("link")
    links = tb.read(spark, sf, "pages").select("page_id", link)
    host = F.regexp_extract("link", "^https?://([^/?#]+)", 1)
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("distinct_links"), F.count_distinct(host).alias("hosts"))


@register("nrm9_page_titles", "SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)) AS title, length(html) AS characters FROM pages")
def page_titles(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)).alias("title"), F.char_length("html").alias("characters"))


_WORDS = f"list_filter(string_split(lower({CONTENT}), ' '), lambda w: w != '')"
_LETTERS, _CAPITALS = "length(regexp_replace(content, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(content, '[^\\p{Lu}]', '', 'g'))"
_HITS = {k: " + ".join(f"regexp_matches(content, '(?i){p}')::INT" for p in own) for k, own in ((0, scores.BOILERPLATE), (1, scores.BOILERPLATE_ARABIC))}
_ARABIC = "starts_with(coalesce(language, ''), 'ar')"
QUALITY = f"""{tb.ARTICLES}, w AS (SELECT *, {_WORDS} AS words FROM articles),
s AS (SELECT *, CASE WHEN length(trim(title)) < 5 THEN 0 WHEN length(title) > 300 THEN 0.4 ELSE 1 END::DOUBLE AS title_score,
  CASE WHEN length(content) < 50 THEN 0 WHEN length(content) < 100 THEN 0.2 WHEN length(content) < 300 THEN 0.5 WHEN length(content) < 800 THEN 0.8 ELSE 1 END::DOUBLE AS length_score,
  CASE WHEN len(words) < 5 THEN 0 WHEN len(list_distinct(words)) / len(words) < 0.2 THEN 0.1 WHEN len(list_distinct(words)) / len(words) < 0.4 THEN 0.5 ELSE 1 END::DOUBLE AS unique_score,
  CASE WHEN {_LETTERS} = 0 THEN 0.5 WHEN {_CAPITALS} / {_LETTERS} > 0.6 THEN 0.1 ELSE 1 END::DOUBLE AS caps_score,
  CASE CASE WHEN {_ARABIC} THEN {_HITS[1]} ELSE {_HITS[0]} END WHEN 0 THEN 1 WHEN 1 THEN 0.6 ELSE 0.2 END::DOUBLE AS boilerplate_score FROM w),
scored AS (SELECT *, {scores.half_even_sql(f"CASE WHEN {_ARABIC} THEN (title_score + length_score + unique_score + boilerplate_score) / 4 ELSE (title_score + length_score + unique_score + boilerplate_score + caps_score) / 5 END")} AS quality FROM s)"""


@register("sco1_quality", f"WITH {QUALITY} SELECT article_id, title_score, length_score, unique_score, caps_score, boilerplate_score, quality, quality >= 0.3 AND length(content) >= 100 AS passed FROM scored")
def article_quality(spark, sf):
    return quality.quality(tb.articles(spark, sf)).select("article_id", "title_score", "length_score", "unique_score", "caps_score", "boilerplate_score", "quality", "passed")


EXACT = f"""h AS (SELECT article_id, published_at, {HASH} AS key FROM articles),
exact AS (SELECT article_id, duplicate_of FROM (SELECT article_id, first_value(article_id) OVER (PARTITION BY key ORDER BY published_at, article_id) AS duplicate_of FROM h) WHERE article_id != duplicate_of)"""
PARAGRAPH = f"""o AS (SELECT article_id, published_at, md5(substr(lower({CONTENT}), 1, 500)) AS key FROM articles WHERE length(content) >= 200),
paragraph AS (SELECT article_id, duplicate_of FROM (SELECT article_id, first_value(article_id) OVER (PARTITION BY key ORDER BY published_at, article_id) AS duplicate_of FROM o) WHERE article_id != duplicate_of)"""


@register("dup2_exact_hash", f"WITH {tb.ARTICLES}, {EXACT} SELECT article_id, duplicate_of FROM exact")
def exact_duplicates(spark, sf):
    return dedup.exact(tb.articles(spark, sf))


@register("dup4_paragraph_hash", f"WITH {tb.ARTICLES}, {PARAGRAPH} SELECT article_id, duplicate_of FROM paragraph")
def paragraph_duplicates(spark, sf):
    return dedup.paragraph(tb.articles(spark, sf))


@register(
    "dup3_url",
    f"""WITH {CANONICAL}, k AS (SELECT page_id, lower(regexp_replace(replace(regexp_replace(string_split(url, '?')[1], '^[a-z]+://', ''), 'www.', ''), '/+$', '')) AS key FROM canonical)
SELECT article_id, duplicate_of FROM (SELECT page_id AS article_id, min(page_id) OVER (PARTITION BY key) AS duplicate_of FROM k WHERE contains(key, '/')) WHERE article_id != duplicate_of""",
)
def url_duplicates(spark, sf):
    return dedup.by_url(tb.read(spark, sf, "pages").select(F.col("page_id").alias("article_id"), F.lit(0).alias("published_at"), "url"))


@register(
    "dup1_cascade",
    f"""WITH {tb.ARTICLES}, {EXACT}, {PARAGRAPH}
SELECT coalesce(e.article_id, p.article_id) AS article_id, coalesce(e.duplicate_of, p.duplicate_of) AS duplicate_of, CASE WHEN e.article_id IS NULL THEN 2 ELSE 1 END AS stage
FROM exact e FULL JOIN paragraph p USING (article_id)""",
)
def cascade(spark, sf):
    rows = tb.articles(spark, sf)
    return dedup.cascade([dedup.exact(rows), dedup.paragraph(rows)])


@register("dup1_cascade_shingles")
def cascade_shingles(spark, sf):
    """dup1_cascade with the shingle classes as a further stage."""
    rows = tb.articles(spark, sf)
    return dedup.cascade([dedup.exact(rows), dedup.paragraph(rows), dedup.shingles(rows)])


@register("dup5_near_title")
def near_titles(spark, sf):
    return dedup.titles(tb.articles(spark, sf))


@register("dup6_near_duplicate")
def near_duplicates(spark, sf):
    return dedup.near(tb.articles(spark, sf))


@register("dup1_cascade_titles")
def cascade_titles(spark, sf):
    """The stages that articles without a url, a story or shingles can show: 1, 3, 4 and 5."""
    rows = tb.articles(spark, sf)
    return dedup.cascade([dedup.exact(rows), dedup.paragraph(rows), dedup.titles(rows), dedup.near(rows)], [1, 3, 4, 5])


@register(
    "dup8_shingle_jaccard",
    f"""WITH RECURSIVE {tb.ARTICLES}, bodies AS (SELECT article_id, substr(lower({CONTENT}), 1, 2000) AS body FROM articles WHERE length(content) >= 300),
x AS (SELECT body, min(article_id) AS id, list(article_id) AS copies FROM bodies WHERE length(body) >= 5 GROUP BY 1),
s AS MATERIALIZED (SELECT id, list_distinct(list_transform(range(1, length(body) - 3), lambda i: hash(substr(body, i, 5)))) AS grams FROM x),
p AS MATERIALIZED (SELECT a, b, common / (both_sizes - common) AS similarity FROM (
  SELECT l.id AS a, r.id AS b, len(list_intersect(l.grams, r.grams)) AS common, len(l.grams) + len(r.grams) AS both_sizes
  FROM s l JOIN s r ON l.id < r.id AND least(len(l.grams), len(r.grams)) >= 0.75 * greatest(len(l.grams), len(r.grams))) WHERE common >= 0.75 * (both_sizes - common)),
reach(a, b) AS (SELECT id, id FROM x UNION SELECT reach.a, CASE WHEN p.a = reach.b THEN p.b ELSE p.a END FROM reach JOIN p ON reach.b IN (p.a, p.b)),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1)
SELECT p.a, p.b, similarity, class_id FROM p JOIN classes ON p.a = classes.a
UNION ALL SELECT id, copy, 1.0, class_id FROM (SELECT id, unnest(copies) AS copy FROM x) JOIN classes ON id = a WHERE copy != id""",
)
def shingle_jaccard(spark, sf):
    return dedup.shingle_links(tb.articles(spark, sf))


@register("dup8_shingle_classes")
def shingle_classes(spark, sf):
    return dedup.shingle_members(tb.articles(spark, sf))[0]


@register(
    "clu24_source_reliability",
    f"""WITH {QUALITY}, {EXACT}, r AS (SELECT source, count(*) AS articles, count(e.article_id) AS duplicates, count(*) FILTER (quality < 0.3) AS low_quality, avg(quality) AS mean_quality
  FROM scored LEFT JOIN exact e USING (article_id) GROUP BY 1)
SELECT source, articles, duplicates, low_quality, round(mean_quality, 6) AS mean_quality,
  CASE WHEN articles >= 10 THEN round(greatest(0.05, least(1.0, 0.4 * mean_quality + 0.3 * (1 - duplicates / articles) + 0.3)), 4) END AS trust FROM r""",
)
def reliability(spark, sf):
    rows = tb.articles(spark, sf)
    out = quality.source_reliability(quality.quality(rows), dedup.exact(rows))
    return out.withColumn("mean_quality", F.round("mean_quality", 6))


#: Topic, label, kind, pattern and target of each rule.
RULES = [
    ("licences", "mit", "phrase", "mit license", "any"),
    ("licences", "apache", "keyword", "apache", "body"),
    ("licences", "free", "boolean", "cc and by or gnu", "any"),
    ("secrets", "assigned", "regex", "(password|token) ?= ?", "body"),
    ("secrets", "example", "exclusion", "token", "body"),
    ("articles", "der", "keyword", "der ", "title"),
]


@register(
    "sco12_topic_rules",
    f"""WITH {tb.ARTICLES}, rules(topic, label, kind, pattern, target) AS (VALUES {", ".join(str(r) for r in RULES)}),
a AS (SELECT article_id, lower(title) AS title, lower(content) AS body FROM articles),
m AS (SELECT article_id, topic, label, kind FROM (SELECT *, CASE target WHEN 'title' THEN title WHEN 'body' THEN body ELSE title || chr(10) || body END AS t FROM a, rules)
  WHERE CASE kind WHEN 'regex' THEN regexp_matches(t, pattern)
    WHEN 'boolean' THEN len(list_filter(string_split(pattern, ' or '), lambda g: len(list_filter(string_split(g, ' and '), lambda x: NOT contains(t, trim(x)))) = 0)) > 0
    ELSE contains(t, lower(pattern)) END)
SELECT article_id, topic, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind != 'exclusion') AS labels FROM m GROUP BY 1, 2
HAVING count(*) FILTER (kind = 'exclusion') = 0""",
)
def topic_rules(spark, sf):
    return topics.match_rules(tb.articles(spark, sf), RULES)


@register(
    "sco19_chunks",
    f"""WITH {tb.ARTICLES}, c AS (SELECT article_id, content, unnest(range(greatest(1, ceil(length(content) / 4500)::BIGINT))) AS chunk FROM articles)
SELECT article_id, chunk::INTEGER AS chunk, md5(substr(content, chunk * 4500 + 1, 4500)) AS digest, length(substr(content, chunk * 4500 + 1, 4500)) AS characters FROM c""",
)
def text_chunks(spark, sf):
    return topics.chunks(tb.articles(spark, sf)).select("article_id", "chunk", F.md5("text").alias("digest"), F.char_length("text").alias("characters"))


@register(
    "nrm12_scripts",
    f"WITH {tb.ARTICLES}, n AS (SELECT article_id, language, length(regexp_replace(content, '[^\u0600-\u06FF]', '', 'g')) AS arabic, length(content) AS n FROM articles) SELECT article_id, language, arabic, arabic > 0.3 * n AS looks_arabic FROM n",
)
def scripts(spark, sf):
    arabic = F.char_length(F.regexp_replace("content", "[^\\u0600-\\u06FF]", ""))
    return tb.articles(spark, sf).select("article_id", "language", arabic.alias("arabic"), (arabic > 0.3 * F.char_length("content")).alias("looks_arabic"))


@register(
    "qry3_articles_list",
    f"""WITH {QUALITY}, {EXACT} SELECT article_id, source, published_at, quality FROM scored ANTI JOIN exact USING (article_id)
WHERE quality >= 0.9 AND source LIKE '%src1%' ORDER BY published_at DESC, article_id LIMIT 50""",
)
def articles_list(spark, sf):
    rows = tb.articles(spark, sf)
    # Written, since a filter on the quality would score every article once for itself and once for what it keeps.
    scored = tb.written(quality.quality(rows.where(F.contains("source", F.lit("src1")))).select("article_id", "source", "published_at", "quality"))
    kept = scored.where("quality >= 0.9").join(dedup.exact(rows), "article_id", "left_anti")
    return kept.select("article_id", "source", "published_at", "quality").orderBy(F.desc("published_at"), "article_id").limit(50)


@register(
    "qry31_text_search",
    f"""WITH {tb.ARTICLES}, q AS (SELECT unnest(['license', 'the', 'version']) AS term),
t AS (SELECT article_id, source, term, count(*) AS n FROM (SELECT article_id, source, unnest(list_filter(string_split(lower({CONTENT}), ' '), lambda w: w != '')) AS term FROM articles) SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n_docs FROM articles)
SELECT article_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2)), 6) AS score FROM t JOIN df USING (term), n GROUP BY 1 ORDER BY score DESC, article_id LIMIT 100""",
)
def text_search(spark, sf):
    """Term matches ranked by saturated counts and inverse document frequency, the top hundred."""
    rows = tb.articles(spark, sf)
    terms = rows.select("article_id", F.explode(tx.words(F.col("content"))).alias("term")).where(F.col("term").isin("license", "the", "version"))
    counts = terms.groupBy("article_id", "term").agg(F.count("*").alias("n"))
    weights = counts.groupBy("term").agg(F.count("*").alias("df"))
    score = F.log(1 + (F.lit(rows.count()) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("n") * 2.2 / (F.col("n") + 1.2)
    out = counts.join(weights, "term").groupBy("article_id").agg(F.round(F.sum(score), 6).alias("score"))
    return out.orderBy(F.desc("score"), "article_id").limit(100)
