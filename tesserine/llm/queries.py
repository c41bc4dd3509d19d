"""The opN_ queries: each applies one operator to its whole table. SQL holds what DuckDB can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import bpe, embeddup, langid, linededup, mixing, pages, partenum, quality, sharding, toxicity
from tesserine.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_spec(vocabulary()))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digest(sharding.shuffled_shards(docs, 24))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_groups(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The tree that op8_mixing and the pipeline mix by, and its weights.
MIX_WEIGHTS = [{"web": 5.0, "reference": 3.0, "forum": 2.0}, {"en": 6.0, "de": 1.5, "fr": 1.5, "es": 1.0, None: 0.5}, None]


def mix_levels() -> dict[str, Column]:
    n = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    n = F.try_to_number(F.when(n == "", None).otherwise(F.substring(n, -9, 9)), F.lit("999999999")).cast("int")
    domain = F.when(n < 10, "web").when(n < 15, "reference").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, share=0.8, epochs=3, keep=[])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def identify_documents(docs: DataFrame) -> DataFrame:
    return langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    plain = table(spark, sf_dir, "pages").withColumn("plain", F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1>|<[^>]*>", " "))
    return langid.identify(plain, model, key="page_id", text="plain", **langid.page_evidence())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "langid_pages": langid_pages,
}

_REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), parts AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

_LADDER = ", ".join(f"({n + 1}, {', '.join(str(cuts[n]) for cuts in quality.LADDER.values())})" for n in range(quality.LEVELS))

SQL: dict[str, str] = {
    "op6_quality": f"""WITH words AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM words),
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
  again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
  covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY doc_id),
  base AS (SELECT doc_id, stratum, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM lines LEFT JOIN covered USING (doc_id)),
  measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / nullif(n_words, 0) AS m1, n_repeat_words / nullif(n_words, 0) AS m2, n_dup_lines / nullif(n_lines, 0) AS m3,
    len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) / nullif(n_words, 0) AS m4, word_chars / nullif(n_words, 0) AS m5 FROM base),
  ladder(n, c1, c2, c3, c4, c5) AS (VALUES {_LADDER}),
  placed AS (SELECT doc_id, coalesce(min(n), {quality.LEVELS + 1}) AS level FROM measured LEFT JOIN ladder ON m1 > c1 OR m2 > c2 OR m3 > c3 OR m4 > c4 OR m5 > c5 GROUP BY doc_id),
  good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
  held AS (SELECT stratum, good, level FROM measured JOIN placed USING (doc_id) JOIN good USING (doc_id) WHERE NOT base_failed),
  counts AS (SELECT stratum, ladder.n AS step, count(*) FILTER (good) AS n, count(*) FILTER (good AND level <= ladder.n) AS k FROM held, ladder GROUP BY stratum, ladder.n),
  tests AS (SELECT stratum, step, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK})))) <= {quality.DELTA} / (SELECT count(DISTINCT stratum) FROM held) AS fine FROM counts),
  certified AS (SELECT stratum, coalesce(min(step) FILTER (NOT fine), {quality.LEVELS + 1}) - 1 AS last FROM tests GROUP BY stratum)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(last, 0) AS kept FROM measured JOIN placed USING (doc_id) LEFT JOIN certified USING (stratum)""",
    "op4_embedding_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
  fine AS (SELECT id, e FROM nodes WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
  links AS (SELECT a.id AS a, b.id AS b FROM fine a JOIN fine b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.95), {_REACH}
  SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM parts LEFT JOIN (SELECT a AS id, count(*) AS n FROM links GROUP BY a) USING (id)""",
    "op5_jaccard_join": f"""WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
  items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM nodes),
  pairs AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM items a JOIN items b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs WHERE 100 * m >= 85 * (na + nb - m)), {_REACH}
  SELECT nodes.id AS doc_id, len(s)::BIGINT AS n_shingles, component_id FROM nodes JOIN parts USING (id)""",
}
