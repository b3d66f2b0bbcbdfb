"""Registered queries of the text operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark.llm import (
    collocations, cross_polytope, decontaminate, lexical_search, pairwise_quality, risk_rules, secret_scan,
    sentencepiece_codec, simhash, token_shards, toxicity, url_trees, warc_zst,
)
from flowspark.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


@query("op2_pairwise_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_risk_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = risk_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "failed_rules")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_decontaminate", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
            FROM items, LATERAL unnest(generate_series(1, len(w) - k + 1)) AS s(i)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
           FROM d, sizes, LATERAL unnest(generate_series(1, len(w) - k + 1)) AS s(i) WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, i, k FROM places JOIN windows USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT doc_id, i, k FROM found) f, LATERAL unnest(generate_series(i, i + k - 1)) AS s(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


@query("op8_token_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_shards.token_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


# text between matches and matches take turns, so their lengths give the positions
_ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
           "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")


def _secret_sql() -> str:
    ctes, unions = [], []
    for place, r in enumerate(secret_scan.RULES):
        pattern = _ASSIGN if r.kind == "assign" else r.pattern
        ctes.append(f"""k{place} AS (
  SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'s': CAST(
             list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)
             AS BIGINT), 'h': hits[i], 'c': checked[i]}})) AS x
  FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
               regexp_extract_all(t, '{pattern}', {r.group}) AS checked FROM d))""")
        unions.append(f"SELECT doc_id, {place} AS place, '{r.kind}' AS kind, x.s AS s, x.s + length(x.h) AS e "
                      f"FROM k{place} WHERE length(x.c) >= {r.least}")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(ctes)},
spans AS ({" UNION ALL ".join(unions)}),
own AS (SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS k, count(*) FILTER (place = 2) AS h,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS base FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN own USING (doc_id)"""


@query("op6_secret_scan", _secret_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["place"] < len(secret_scan.BASE))
    count = [F.expr(f"size(filter(spans, s -> s.kind = '{r.kind}'))").cast("long").alias(f"n_{r.kind}")
             for r in secret_scan.BASE]
    return found.select("doc_id", *count, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


@query("op5_warc_zst", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p),
r AS (SELECT *, CASE WHEN strlen(body) >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zst.archived(table(spark, sf_dir, "pages")).drop("url")


@query("op7_url_trees")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(table(spark, sf_dir, "pages"))


@query("op12_collocations", """
WITH p AS (
  SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM p, (VALUES (1), (2), (3), (4)) AS sizes(k), LATERAL unnest(generate_series(1, len(w) - k + 1)) AS s(i)
        WHERE len(w) >= k) GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r,
                CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
         FROM c, LATERAL unnest(generate_series(1, k - 1)) AS s(cut)
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS cover
           FROM c, (VALUES (2), (3)) AS sizes(m), LATERAL unnest(generate_series(1, k - m + 1)) AS s(i)
           WHERE m < k GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
         WHERE cover IS NULL OR CAST(100 AS HUGEINT) * cover < CAST(80 AS HUGEINT) * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n,
       score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_TERMS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""


@query("op11_lexical_search", f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score
           FROM q JOIN weights USING (t) JOIN tf USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_cross_polytope")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_polytope.nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"),
                        F.col("distance").alias("score"))
