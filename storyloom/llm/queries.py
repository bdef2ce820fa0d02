"""The registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import collocations, decontamination, langid, lattice, licenses, multi_index, packing, secrets, sharding, simhash, sql, token_files, url_rules, whitening
from storyloom.llm._common import fold, shared_folder, slim, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- op4


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        sharding.shuffle_key(F.col("doc_id"), F.md5(text)).alias("shuffled"),
    )
    out = sharding.interleave(rows, "source", "shuffled", n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op4_interleaved_shards"] = op4_interleaved_shards
ORACLES["op4_interleaved_shards"] = f"""
WITH {sql.CRC},
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
k AS (SELECT *, md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(text)) AS h FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h) - 0.5::DOUBLE)
        / (count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source, h) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, ((place * 16) // total)::INTEGER AS shard FROM p)
SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size, {sql.crc32("text")}::BIGINT AS text_crc32, 'rows' AS law,
  shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s, crc_table"""

# ---------------------------------------------------------------- op8

#: Host, path and action of each rule.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = slim(table(spark, sf_dir, "pages"), page_id="page_id", url="url")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES["op8_url_rules"] = op8_url_rules
ORACLES["op8_url_rules"] = f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
p AS (SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT p.row, max_by(struct_pack(rule := rule_host || rule_path, action := action), length(rule_host || rule_path)) AS best
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (row)"""

# ---------------------------------------------------------------- op5


def op5_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, most=3)
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES["op5_simhash_classes"] = op5_simhash_classes

# ---------------------------------------------------------------- op3


def op3_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES["op3_complement_packing"] = op3_complement_packing

# ---------------------------------------------------------------- op1


def op1_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lattice.score(docs, fold("doc_id") % 10 == 0, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op1_lattice_scores"] = op1_lattice_scores

# ---------------------------------------------------------------- op7


def op7_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, slop=1)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_near",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES["op7_phrase_index"] = op7_phrase_index
#: Words of a text, for DuckDB: the same classes of bytes.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op7_phrase_index"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i + 1 : i + 10], ' ') AS phrase, least(len(w), 10) AS k
  FROM b, LATERAL (SELECT unnest(range(greatest(len(w) - 9, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i)),
sizes AS (SELECT DISTINCT k FROM win),
g AS (SELECT row, i, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase
  FROM d, sizes, LATERAL (SELECT unnest(range(greatest(len(w) - k + 1, 0))) AS i)),
m AS (SELECT row, i, win.k, item FROM g JOIN win USING (phrase, k)),
e AS MATERIALIZED (SELECT DISTINCT row, i, phrase FROM g JOIN win USING (phrase, k)),
h AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT row, i, k FROM m)) GROUP BY 1),
i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM m) GROUP BY 1),
pos AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
cnt AS (SELECT word, count(*) AS n FROM pos GROUP BY 1),
pw AS (SELECT phrase, string_split(phrase, ' ') AS ws FROM (SELECT DISTINCT phrase FROM win)),
pt AS (SELECT phrase, unnest(ws) AS word, unnest(range(len(ws))) AS o FROM pw),
rare AS (SELECT phrase, arg_min(struct_pack(word := word, o := o), coalesce(n, 0)) AS r FROM pt LEFT JOIN cnt USING (word) GROUP BY 1),
near AS (SELECT DISTINCT row, phrase, p - r.o + unnest([-1, 0, 1]) AS s FROM rare JOIN pos ON pos.word = r.word),
n AS (SELECT row, count(DISTINCT s) AS n_near FROM near JOIN d USING (row) JOIN pw USING (phrase)
  WHERE s >= 0 AND len(list_filter(range(len(ws)), lambda o: list_contains(w[greatest(s + o, 1) : s + o + 2], ws[o + 1]))) = len(ws)
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.row = near.row AND e.phrase = near.phrase AND abs(e.i - near.s) <= 1) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row) LEFT JOIN n USING (row)"""

# ---------------------------------------------------------------- op9


def op9_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id") % 3 == 1)
    model = langid.train(docs.where("NOT held_out"), sample=2000, landmarks=256)
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES["op9_string_kernel_language"] = op9_string_kernel_language

# ---------------------------------------------------------------- op10


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"), threshold=0.8)
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


QUERIES["op10_license_join"] = op10_license_join
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"({k}, {unit}, '{label}', '{body}')" for k, (unit, (label, body)) in enumerate([(0, t) for t in licenses.STATEMENTS] + [(1, t) for t in licenses.NOTICES]))
ORACLES["op10_license_join"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text, {WORDS} AS w FROM documents),
phrases(phrase, label) AS (VALUES {_PHRASES}),
p AS (SELECT string_split(phrase, ' ') AS parts, label FROM phrases),
hits AS (SELECT row, i, label FROM d, p, LATERAL (SELECT unnest(range(greatest(len(w) - len(parts) + 1, 0))) AS i)
  WHERE w[i + 1] = parts[1] AND w[i + 1 : i + len(parts)] = parts),
b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own FROM hits GROUP BY 1),
templates(id, unit, label, text) AS (VALUES {_TEMPLATES}),
t AS (SELECT id, unit, label, list_distinct({WORDS}) AS tw FROM templates),
plain AS (SELECT row, regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g') AS text FROM d),
blocks AS (SELECT DISTINCT row, unit, list_distinct({WORDS}) AS bw FROM (
  SELECT row, 0 AS unit, unnest(string_split(text, chr(10))) AS text FROM plain UNION ALL
  SELECT row, 1 AS unit, unnest(string_split_regex(text, '\n *\n[ \n]*')) AS text FROM plain)),
m AS (SELECT row, label, len(list_intersect(bw, tw)) / len(tw)::DOUBLE AS share FROM blocks JOIN t USING (unit)
  WHERE len(list_intersect(bw, tw)) >= greatest(1, ceil(0.8 * len(tw) - 1e-9))),
s AS (SELECT row, list(DISTINCT label) AS found, max(share) AS share FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN s USING (row)"""

# ---------------------------------------------------------------- op2


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.OWNED)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k, *_ in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest("spans").alias("spans"), secrets.judged("spans").alias("judged"))


QUERIES["op2_secret_ownership"] = op2_secret_ownership
#: As the operator's kinds, written out: RE2 folds more letters than A-Z when told to ignore case.
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = "(" + _ANY_CASE + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, rank: int, pattern: str, value: str, least: int) -> str:
    return f"""
  SELECT row, owner, repository, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, v FROM (
    SELECT row, owner, repository, ms[i] AS m, {value} AS v,
      list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT row, owner, repository, text, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS ms,
        regexp_extract_all(text, '{pattern}', {2 if kind == "assign" else 0}) AS vs FROM d)))
  WHERE length(v) >= {least}"""


ORACLES["op2_secret_ownership"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS ({" UNION ALL ".join([_spans_sql("assign", 0, _ASSIGN, "vs[i]", 6), _spans_sql("access", 1, "AKIA[A-Z0-9]+", "ms[i]", 20), _spans_sql("hex", 2, "[0-9a-f]+", "ms[i]", 24)])}),
bare AS (SELECT * FROM ({_spans_sql("owned", 3, "[A-Za-z0-9_-]{20,}", "ms[i]", 20)}) b
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.row = b.row AND base.start < b.stop AND b.start < base.stop)),
own AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories,
    CASE WHEN owners >= 3 OR (owners > 1 AND repositories >= 3) THEN 'copied' WHEN owners = 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
      AND len(list_distinct(string_split(v, ''))) >= 10 THEN 'live' ELSE 'shared' END AS verdict
  FROM (SELECT v, owner, repository FROM base UNION ALL SELECT v, owner, repository FROM bare) GROUP BY 1),
spans AS (SELECT row, rank, kind, start, stop, owners, repositories, verdict FROM (FROM base UNION ALL BY NAME FROM bare) JOIN own USING (v)
  WHERE kind != 'owned' OR verdict = 'live'),
s AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) FILTER (kind != 'owned') AS own,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans,
    string_agg(concat_ws(':', kind, start, stop, owners, repositories, verdict), ',' ORDER BY start, rank) AS judged FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(judged, '') AS judged
FROM d LEFT JOIN s USING (row)"""

# ---------------------------------------------------------------- op6


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, share=0.35)


QUERIES["op6_inverted_multi_index"] = op6_inverted_multi_index

# ---------------------------------------------------------------- op12


def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4)


QUERIES["op12_polarised_whitening"] = op12_polarised_whitening

# ---------------------------------------------------------------- op13


def op13_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    back = token_files.write_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES["op13_simple8b_files"] = op13_simple8b_files

# ---------------------------------------------------------------- op11


def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), support=30, top=2000, contained=80, shards=4)


QUERIES["op11_son_collocations"] = op11_son_collocations
ORACLES["op11_son_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i + 1 : i + k], ' ') AS phrase
  FROM w, (SELECT unnest(range(1, 5)) AS k), LATERAL (SELECT unnest(range(greatest(len(ws) - k + 1, 0))) AS i)),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
cuts AS (SELECT lang, k, phrase, a, i, array_to_string(ws[1 : i], ' ') AS head, array_to_string(ws[i + 1 : k], ' ') AS rest
  FROM f, LATERAL (SELECT unnest(range(1, k)) AS i)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, i, l.a AS l, r.a AS r, ((2000000::HUGEINT * cuts.a) // (l.a + r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = rest),
least AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), (score, i)) AS m FROM s GROUP BY ALL),
inner_parts AS (SELECT lang, a, unnest(list_concat([array_to_string(ws[i : i + 1], ' ') FOR i IN range(1, k)],
    CASE WHEN k > 3 THEN [array_to_string(ws[i : i + 2], ' ') FOR i IN range(1, k - 1)] ELSE [] END)) AS phrase FROM f WHERE k > 2),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN longest USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, m.l AS l, m.r AS r, n, m.score AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
