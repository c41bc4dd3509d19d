"""The named queries over the driver's tables, with the SQL that states each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine import schema
from tesserine.functions import text as tx
from tesserine.functions import vectors as vx
from tesserine.operators import chunking, embedding, extract, generate, hnsw, search
from tesserine.plans.engine import changes
from tesserine.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def _literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


# --- vectors ------------------------------------------------------------------------------------------------------

_FIRST = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_FIRST}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "vec_id", "embedding")
    dots = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.round(vx.dot(F.col("embedding"), _literal(first_vector(spark, sf_dir))), 6).alias("score"))
    return hits.select("vec_id").join(dots, "vec_id")


@query("""SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INTEGER AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def vec_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.batch_top_k(v, q, 5, "vec_id", "query_id", "embedding", decimals=6)


@query(f"""SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  round(list_cosine_similarity(embedding::DOUBLE[], {_FIRST}), 6) AS cosine, round(1 - list_inner_product(embedding::DOUBLE[], {_FIRST}), 6) AS distance FROM embeddings""")
def vec_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = F.col("embedding"), _literal(first_vector(spark, sf_dir))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm(v), 6).alias("norm"), F.round(vx.cosine(v, q), 6).alias("cosine"), F.round(vx.distance(v, q), 6).alias("distance"))


@query("""SELECT vec_id, round(sqrt(list_inner_product(x, x)), 5) AS norm, round(x[1], 5) AS head FROM (SELECT vec_id,
  list_transform(embedding::DOUBLE[], lambda e: (e * 3.0) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * 9.0)) AS x FROM embeddings)""")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vx.normalize(F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))).alias("x"))
    return unit.select("vec_id", F.round(vx.norm(F.col("x")), 5).alias("norm"), F.round(F.get("x", F.lit(0)).cast("double"), 5).alias("head"))


@query("""SELECT q.vec_id AS query_id, v.vec_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY
  round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id))::INTEGER AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""")
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    graphs = hnsw.build(v, max(1, -(-v.count() // hnsw.SHARD)), key="vec_id", vec="embedding")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return hnsw.search(graphs, q, 5, "vec_id", decimals=6).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


_RANKED = """SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product({a}, {b}), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"""
_HALF = [f"{x}.embedding[1:32]::DOUBLE[]" for x in "qv"]
_FULL = [f"{x}.embedding::DOUBLE[]" for x in "qv"]


@query(f"""WITH found AS (SELECT query_id, vec_id FROM ({_RANKED.format(a=_HALF[0], b=_HALF[1])}) WHERE rank <= 5), truth AS (SELECT query_id, vec_id FROM ({_RANKED.format(a=_FULL[0], b=_FULL[1])}) WHERE rank <= 5),
  each AS (SELECT query_id, count(found.vec_id) / count(*) AS share FROM truth LEFT JOIN found USING (query_id, vec_id) GROUP BY query_id) SELECT count(*) AS queries, round(avg(share), 6) AS share FROM each""")
def hit_share_of_half_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of the true five that search by the first half of each vector finds."""
    v = table(spark, sf_dir, "embeddings")
    h = v.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    q = h.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    each = search.hit_share(search.batch_top_k(h, q, 5, "vec_id", "query_id", "embedding", decimals=6), vec_topk_batch(spark, sf_dir), "query_id", "vec_id")
    return each.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("share"), 6).alias("share"))


@query(f"SELECT count(*) AS queries, avg(CASE WHEN query_id = vec_id THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1_rate FROM ({_RANKED.format(a=_HALF[0], b=_HALF[1])}) WHERE rank = 1")
def top1_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the best hit by the first half of each vector is the query itself."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    q = h.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = search.batch_top_k(h, q, 5, "vec_id", "query_id", "embedding", decimals=6).filter("rank = 1")
    return best.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("query_id") == F.col("vec_id"), 1.0).otherwise(0.0)).alias("top1_rate"))


def _parsed(spark: SparkSession, sf_dir: str, shapes: list[str], parser: str) -> DataFrame:
    """(vec_id, dims, head, total) of vectors written in one of the shapes by turns, and read by the embedders' parser."""
    numbers = F.transform("embedding", lambda x: F.format_string("%.7f", x.cast("double")))
    flat = F.concat(F.lit("["), F.array_join(numbers, ", "), F.lit("]"))
    made = {
        "list": F.concat(F.lit('{"data": [{"embedding": '), flat, F.lit("}]}")), "object": F.concat(F.lit('{"embedding": '), flat, F.lit("}")),
        "objects": F.concat(F.lit('[{"index": 0, "embedding": '), flat, F.lit("}]")), "inner": F.concat(F.lit('[{"index": 0, "embedding": ['), flat, F.lit("]}]")),
        "nested": F.concat(F.lit("["), flat, F.lit("]")), "flat": flat, "rows": F.concat(F.lit("a line of words\n"), F.array_join(numbers, " "), F.lit("\n")),
    }
    raw = F.get(F.array(*[made[x] for x in shapes]), (F.col("vec_id") % len(shapes)).cast("int"))

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            got = [getattr(embedding, parser)(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in got], pa.int32()), pa.array([x[0] for x in got], pa.list_(pa.float64()))], names=["vec_id", "n", "v"])

    out = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("raw")).mapInArrow(run, "vec_id long, n int, v array<double>")
    return out.select("vec_id", "n", F.size("v").alias("dims"), F.round(F.get("v", F.lit(0)), 5).alias("head"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_PARSED = "SELECT vec_id, 1::INTEGER AS n, len(embedding)::INTEGER AS dims, round(round(embedding[1]::DOUBLE, 7), 5) AS head, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: round(x, 7))), 4) AS total FROM embeddings"


@query(_PARSED)
def program_output_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, ["list", "object", "nested", "flat", "rows"], "parse_program_output")


@query(_PARSED)
def server_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, ["objects", "object", "list", "inner"], "parse_server_response")


# --- bag of words --------------------------------------------------------------------------------------------------

_FNV = """list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), (2 * i - 1)::INTEGER, 2))::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)"""
_BAG = """SELECT {key}, b AS bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, b, sum(n)::DOUBLE AS n FROM
  (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {table}) WHERE w <> '' GROUP BY ALL) JOIN {words} USING (w) GROUP BY ALL)"""
_WORDS = f"""words AS (SELECT w, {_FNV} % 256 AS b FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {{table}}) WHERE w <> '')"""


@query(f"WITH {_WORDS.format(table='benchmark')} SELECT item_id, bucket, round(w, 6) AS w FROM ({_BAG.format(key='item_id', table='benchmark', words='words')})")
def bow_token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.buckets(table(spark, sf_dir, "benchmark"), "item_id", tx.words(F.col("text"))).select("item_id", "bucket", F.round("w", 6).alias("w"))


@query(f"""WITH {_WORDS.format(table='(SELECT text FROM documents UNION ALL SELECT text FROM benchmark)')},
  d AS ({_BAG.format(key='doc_id', table='documents', words='words')}), q AS ({_BAG.format(key='item_id', table='benchmark', words='words')})
  SELECT doc_id, round(sum(d.w * q.w), 6) AS score FROM d JOIN q USING (bucket) WHERE item_id = 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bow_topk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = embedding.bags(table(spark, sf_dir, "documents"), "doc_id")
    item = embedding.bags(table(spark, sf_dir, "benchmark").filter("item_id = 0"), "item_id").select("bucket", F.col("w").alias("q"))
    return search.sparse_top_k(docs, item, 10, "doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents most like the first benchmark item, with where they come from."""
    return bow_topk_docs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", tx.snippet(F.col("text"), 80).alias("snippet")), "doc_id")


# --- text ----------------------------------------------------------------------------------------------------------

_TURNS = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts, turns apart by a blank line."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("body"))


@query(f"""SELECT conv_id, len(p) AS paragraphs, list_sum(list_transform(p, lambda x: strlen(x)))::BIGINT AS bytes FROM (SELECT conv_id,
  list_filter(list_transform(regexp_split_to_array(body, '\\n[\\r \\t]*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM {_TURNS})""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversations(spark, sf_dir).select("conv_id", tx.paragraphs(F.col("body")).alias("p"))
    return p.select("conv_id", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)).alias("bytes"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.?!][ \\n]')) AS boundaries FROM documents")
def sentence_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.sentence_breaks(F.col("text")).alias("boundaries"))


@query("""SELECT doc_id, k, (k * 448)::BIGINT AS "start", least(k * 448 + 512, strlen(text))::BIGINT AS "end", hex(unhex(substr(hex(text), (k * 896 + 1)::INTEGER, 16))) AS head FROM
  (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((strlen(text) - 512) / 448.0) AS BIGINT)) + 1)) AS k FROM documents) WHERE strlen(text) > 0""")
def hard_split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    docs = table(spark, sf_dir, "documents").filter(size > 0)
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((size - 512) / 448.0)))).alias("k"))
    begin = F.col("k") * 448
    return rows.select("doc_id", "k", begin.alias("start"), F.least(begin + 512, F.octet_length("text")).cast("long").alias("end"), F.hex(tx.byte_slice(F.col("text"), (begin + 1).cast("int"), F.lit(8))).alias("head"))


_TRIMMED = "(SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)"


@query(f"""SELECT 'doc/' || doc_id AS source, left(sha256(unhex(left(hex(t), 128)) || '\\x00'::BLOB || encode('doc/' || doc_id)), 32) AS id, 0::BIGINT AS ord, strlen(t)::BIGINT AS bytes, t AS text
  FROM {_TRIMMED} WHERE strlen(t) BETWEEN 50 AND 512""")
def chunk_short_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(tx.trim(F.col("text")))
    docs = table(spark, sf_dir, "documents").filter(size.between(50, 512)).select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return chunking.chunk(docs).select("source", "id", F.col("ord").cast("long").alias("ord"), F.octet_length("text").cast("long").alias("bytes"), "text")


@query(f"SELECT doc_id, left(sha256(unhex(left(hex(t), 128)) || '\\x00'::BLOB || encode('doc/' || doc_id)), 32) AS id FROM {_TRIMMED}")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.chunk_id(tx.trim(F.col("text")), F.concat(F.lit("doc/"), "doc_id")).alias("id"))


_PIECE = "list_filter(range(s, e), lambda i: x[i + 1] NOT IN ('09', '0A', '0B', '0C', '0D', '20'))"


@query(f"""WITH RECURSIVE raw AS (SELECT doc_id, x, len(x) AS n, list_filter(range(1, len(x) + 1), lambda i: x[i] = '0A') AS nl FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS x FROM documents)),
  breaks AS (SELECT *, list_filter(range(1, len(nl)), lambda k: len(list_filter(x[nl[k] + 1:nl[k + 1] - 1], lambda v: v NOT IN ('0D', '20', '09'))) = 0) AS br FROM raw),
  split AS (SELECT doc_id, unnest(list_zip(list_concat([0], list_transform(br, lambda k: nl[k + 1])), list_concat(list_transform(br, lambda k: nl[k] - 1), [n]))) AS z FROM breaks),
  inner_ AS (SELECT doc_id, {_PIECE} AS own FROM (SELECT doc_id, x, z[1] AS s, z[2] AS e FROM split JOIN raw USING (doc_id))),
  paragraphs AS (SELECT doc_id, own[1] AS s, own[-1] + 1 AS e FROM inner_ WHERE len(own) > 0),
  cuts AS (SELECT doc_id, s, e, list_filter(range(s + 2, e + 1), lambda i: x[i - 1] IN ('2E', '3F', '21') AND x[i] IN ('20', '0A')) AS c FROM paragraphs JOIN raw USING (doc_id) WHERE e - s > 512),
  steps AS (SELECT doc_id, s, e, s AS go, (SELECT c FROM cuts k WHERE k.doc_id = p.doc_id AND k.s = p.s) AS d FROM paragraphs p WHERE e - s > 512
    UNION ALL SELECT doc_id, s, e, d[j - 1], d[j:] FROM (SELECT *, list_filter(range(2, len(d) + 1), lambda j: d[j] - go > 512)[1] AS j FROM steps) WHERE j IS NOT NULL),
  runs AS (SELECT doc_id, s AS para, go AS s, coalesce(lead(go) OVER (PARTITION BY doc_id, s ORDER BY go), e) AS e FROM steps),
  trimmed AS (SELECT doc_id, {_PIECE} AS own FROM runs JOIN raw USING (doc_id)),
  fitting AS (SELECT doc_id, s, e FROM paragraphs WHERE e - s <= 512 UNION ALL SELECT doc_id, own[1], own[-1] + 1 FROM trimmed WHERE len(own) > 0),
  pieces AS (SELECT doc_id, s AS s, e AS e FROM fitting WHERE e - s <= 512 UNION ALL SELECT doc_id, s + 448 * k, least(s + 448 * k + 512, e) FROM (SELECT *, unnest(range(0, greatest(0, ceil((e - s - 512) / 448.0))::BIGINT + 1)) AS k FROM fitting WHERE e - s > 512)),
  listed AS (SELECT *, row_number() OVER own AS i, sum(e - s + 2) OVER own AS upto FROM pieces WINDOW own AS (PARTITION BY doc_id ORDER BY s)),
  nexts AS (SELECT a.doc_id, a.i, a.upto - (a.e - a.s + 2) AS before, coalesce(min(b.i), max(a.i) OVER (PARTITION BY a.doc_id) + 1) AS next FROM listed a LEFT JOIN listed b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + 600 AND b.upto - (a.upto - (a.e - a.s + 2)) - 2 > 512 GROUP BY a.doc_id, a.i, a.upto, a.e, a.s),
  groups AS (SELECT doc_id, i, next FROM nexts WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, n.next FROM groups g JOIN nexts n ON n.doc_id = g.doc_id AND n.i = g.next),
  bodies AS (SELECT g.doc_id, g.i, min(l.s) AS s, arg_max(l.e, l.i) AS e, string_agg(array_to_string(x[l.s + 1:l.e], ''), '0A0A' ORDER BY l.i) AS h FROM groups g JOIN listed l ON l.doc_id = g.doc_id AND l.i >= g.i AND l.i < g.next JOIN raw r ON r.doc_id = g.doc_id GROUP BY g.doc_id, g.i),
  kept AS (SELECT *, row_number() OVER own - 1 AS ord, lag(right(h, 128)) OVER own AS tail FROM bodies WHERE strlen(h) >= 100 WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
  whole AS (SELECT *, coalesce(tail || '0A0A', '') || h AS w FROM kept)
  SELECT 'doc/' || doc_id AS source, ord::INTEGER AS ord, substr(sha256(unhex(substr(w, 1, 128) || '00' || hex(encode('doc/' || doc_id)))), 1, 32) AS id, s::BIGINT AS "start", e::BIGINT AS "end" FROM whole""")
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every document, by its id, which is made of its first bytes, and its place."""
    return chunk_documents(spark, sf_dir).select("source", "ord", "id", "start", "end")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return chunking.chunk(docs)


@query("""SELECT conv_id, turn, CASE WHEN p IS NULL THEN text ELSE right(p, 64) || chr(10) || chr(10) || text END AS carried
  FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)""")
def overlap_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlap_carry(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "carried")


@query("""SELECT doc_id, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS snippet FROM
  (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), 60).alias("snippet"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\r\\n|\\n|\\r', ' ', 'g')) AS line FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.sanitize(F.col("text")).alias("line"))


@query("""SELECT conv_id, turn, regexp_replace(split_part(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || CASE turn % 3 WHEN 0 THEN ' <|end|> x' WHEN 1 THEN '</s></s>' ELSE ' ' END, '<|end|>', 1), '</s>', 1), '^\\s+|\\s+$', '', 'g') AS answer FROM conversations""")
def clean_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("turn") % 3 == 0, " <|end|> x").when(F.col("turn") % 3 == 1, "</s></s>").otherwise(" ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_answer(F.concat(tx.trim(F.col("text")), tail)).alias("answer"))


@query("""SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size
  FROM (SELECT doc_id, n_chars * (1 + doc_id % 7) * 512 AS n FROM documents)""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.human_bytes(F.col("n_chars") * (1 + F.col("doc_id") % 7) * 512).alias("size"))


_PROMPT_SQL = generate.HEAD.replace("'", "''")


@query(f"""SELECT conv_id, prompt, (strlen(prompt) // 4)::BIGINT AS approx_tokens FROM (SELECT conv_id, '{_PROMPT_SQL}' || string_agg(CASE WHEN turn > 0 THEN '[Source: conv/' || conv_id || ', Page ' || turn || ']' ELSE '[Source: conv/' || conv_id || ']' END
  || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) || '---' || chr(10) || chr(10) || 'Question: Which roles speak in ' || conv_id || '?' || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations GROUP BY conv_id)""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "conversations").select("conv_id", F.format_string("Which roles speak in %d?", "conv_id").alias("question"), F.col("turn").alias("rank"), F.format_string("conv/%d", "conv_id").alias("source"), F.col("turn").alias("page_num"), "text")
    return generate.prompts(hits, "conv_id", "question")


# --- markup and code -----------------------------------------------------------------------------------------------

_LINES = "(SELECT doc_id, (unnest(range(1, len(string_split(text, chr(10))) + 1)) - 1)::INTEGER AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"""SELECT doc_id, pos, translate(regexp_replace('*' || line || '* [' || line || '](http://x/' || doc_id || ') `c_d`', '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '*_`', '') AS plain FROM {_LINES}""")
def md_inline_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("*"), F.col("line"), F.lit("* ["), F.col("line"), F.lit("](http://x/"), F.col("doc_id"), F.lit(") `c_d`"))
    return lines(spark, sf_dir).select("doc_id", "pos", tx.strip_inline(marked).alias("plain"))


@query(f"""SELECT doc_id, pos, CASE WHEN l IN ('---', '***', '___') THEN '' WHEN l[1] = '#' THEN regexp_replace(ltrim(l, '#'), '^\\s+|\\s+$', '', 'g')
    WHEN l[1] = '>' OR regexp_matches(q, '^[-*+] ') THEN regexp_replace(regexp_replace(q, '^[-*+] ', ''), '^\\s+|\\s+$', '', 'g') ELSE q END AS plain
  FROM (SELECT doc_id, pos, l, regexp_replace(l, '^(>\\s*)+', '') AS q FROM (SELECT doc_id, pos, trim(['## ' || line, '> ' || line, '  - ' || line, '---', line][1 + pos % 5], ' ' || chr(9)) AS l FROM {_LINES}))""")
def md_block_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    kinds = F.array(F.concat(F.lit("## "), line), F.concat(F.lit("> "), line), F.concat(F.lit("  - "), line), F.lit("---"), line)
    return lines(spark, sf_dir).select("doc_id", "pos", tx.strip_block(F.get(kinds, (F.col("pos") % 5).cast("int"))).alias("plain"))


@query(f"""SELECT doc_id, pos, coalesce(starts_with(line, 'func ') AND before IS NOT NULL AND regexp_matches(before, '\\S'), false) AS breaks FROM (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before
  FROM (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'func ' || line ELSE line END AS line FROM {_LINES}))""")
def code_unit_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lines(spark, sf_dir).withColumn("line", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("func "), F.col("line"))).otherwise(F.col("line")))
    return extract.unit_breaks(code, ["doc_id"], "pos", "line", ".go").select("doc_id", "pos", F.coalesce("breaks", F.lit(False)).alias("breaks"))


# --- files ---------------------------------------------------------------------------------------------------------

#: Endings of the made-up paths, by doc_id.
ENDINGS = ["a.go", "b.PY", "c.md", "d.markdown", "e.txt", "f", "g.pdf", "h.bin", "i.log", "j.rs", "k.tar.gz", ".DS_Store", "l.html", "m.rst"]
FOLDERS = ["src", "node_modules", "docs", ".git", "build/x", "lib"]
_PATH_SQL = f"('/r/' || {FOLDERS!r}[(doc_id // 3) % 6 + 1] || '/' || doc_id || '/' || {ENDINGS!r}[doc_id % 14 + 1])".replace("['src'", "(['src'").replace("'lib']", "'lib'])").replace("['a.go'", "(['a.go'").replace("'m.rst']", "'m.rst'])")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    path = F.concat(F.lit("/r/"), pick(FOLDERS, F.floor(F.col("doc_id") / 3) % 6), F.lit("/"), F.col("doc_id"), F.lit("/"), pick(ENDINGS, F.col("doc_id") % 14))
    return table(spark, sf_dir, "documents").withColumn("path", path)


_PATHS = f"(SELECT *, {_PATH_SQL} AS path FROM documents)"
_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_FORMAT = f"CASE WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} IN {schema.MARKDOWN!r} THEN 'markdown' WHEN {_EXT} IN {schema.CODE!r} THEN 'code' WHEN {_EXT} IN {schema.TEXT!r} THEN 'text' ELSE '' END"


@query(f"SELECT doc_id, path, {_FORMAT} AS format FROM {_PATHS}")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("doc_id", "path", extract.format_of(F.col("path")).alias("format"))


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE {_FORMAT} <> '' AND NOT ends_with(path, '/.DS_Store')")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).filter(files.wanted_extension(F.col("path"))).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE {_EXT} IN ('.md', '.go')")
def ext_filter_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).filter(files.wanted_extension(F.col("path"), [" MD", "go"])).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE NOT list_has_any(string_split(path, '/')[1:-2], {list(schema.SKIPPED_FOLDERS)!r})")
def dir_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).filter(~files.pruned(F.col("path"), "/r")).select("doc_id", "path")


@query("SELECT doc_id, (doc_id % 5 = 0 AND least(strlen(text), doc_id % 900) < 512) AS is_binary FROM documents")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.least(F.octet_length("text").cast("long"), F.col("doc_id") % 900).cast("int")
    raw = F.col("text").cast("binary")
    data = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring(raw, F.lit(1), size), F.lit(b"\x00"))).otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", extract.is_binary(data).alias("is_binary"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(~tx.is_blank(F.col("text"))).select("doc_id")


@query("SELECT source AS path, count(*) AS chunks, max(n_chars) AS modified_ns FROM documents GROUP BY source ORDER BY path")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("chunks"), F.max("n_chars").alias("modified_ns")).orderBy("path")


@query("SELECT m.source AS path, count(d.doc_id) AS chunks FROM (SELECT DISTINCT source FROM documents) m LEFT JOIN (SELECT * FROM documents WHERE n_chars >= 3000) d ON m.source = d.source GROUP BY 1")
def files_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = docs.filter("n_chars >= 3000").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("source").distinct().join(counts, "source", "left").select(F.col("source").alias("path"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query("SELECT count(DISTINCT source) AS files, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes FROM documents")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("files"), F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


# Two states of the files: what is listed now, and what the manifest knows.
_NOW = "(SELECT 'f/' || doc_id AS path, n_chars AS modified_ns FROM documents WHERE doc_id % 11 <> 0)"
_WAS = "(SELECT 'f/' || doc_id AS path, n_chars + (doc_id % 5 = 0)::INTEGER AS modified_ns FROM documents WHERE doc_id % 7 <> 0)"
_PLAN = f"""(SELECT coalesce(n.path, w.path) AS path, coalesce(n.modified_ns, w.modified_ns) AS modified_ns, CASE WHEN w.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.modified_ns <> w.modified_ns THEN 'changed' ELSE 'unchanged' END AS action
  FROM {_NOW} n FULL JOIN {_WAS} w ON n.path = w.path)"""


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("f/"), "doc_id"))
    now = docs.filter("doc_id % 11 <> 0").select("path", F.col("n_chars").alias("modified_ns"))
    return now, docs.filter("doc_id % 7 <> 0").select("path", (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int")).alias("modified_ns"))


@query(f"SELECT * FROM {_PLAN}")
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(*states(spark, sf_dir))


@query(f"SELECT action, count(*) AS files FROM {_PLAN} GROUP BY action")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(*states(spark, sf_dir)).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT n.* FROM {_NOW} n ANTI JOIN {_WAS} w ON n.path = w.path AND n.modified_ns = w.modified_ns")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = states(spark, sf_dir)
    return now.join(was, ["path", "modified_ns"], "left_anti")


@query(f"SELECT n.* FROM {_NOW} n SEMI JOIN {_WAS} w ON n.path = w.path AND n.modified_ns = w.modified_ns")
def unchanged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = states(spark, sf_dir)
    return now.join(was, ["path", "modified_ns"], "left_semi")


@query(f"SELECT w.path FROM {_WAS} w ANTI JOIN {_NOW} n ON n.path = w.path")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = states(spark, sf_dir)
    return was.select("path").join(now, "path", "left_anti")


@query("SELECT source AS path, min(doc_id) AS first_seen FROM documents GROUP BY source")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("first_seen"))
    return rows.groupBy("path").agg(F.min("first_seen").alias("first_seen"))


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE NOT (path = '/r/src' OR starts_with(path, '/r/src/'))")
def remove_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).filter(~files.under(F.col("path"), "/r/src/")).select("doc_id", "path")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src3')")
def remove_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src3",)], "source string")
    return table(spark, sf_dir, "documents").join(F.broadcast(gone), "source", "left_anti").select("doc_id", "source")


@query("""SELECT d.doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS position FROM documents d""")
def store_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by source and id: counts of the sources before, then ranks within one, so no task sees all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select("source", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumn("r", rank).join(begins, "source").select("doc_id", (F.col("b") + F.col("r") - 1).alias("position"))


@query(f"""SELECT vec_id, h.score, d.source FROM (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_FIRST}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10) h JOIN documents d ON d.doc_id = h.vec_id""")
def hit_chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), "source")
    hits = vec_topk_exact(spark, sf_dir).select(F.col("vec_id").alias("chunk_idx"), "score")
    return search.with_chunks(hits, chunks).select(F.col("chunk_idx").alias("vec_id"), "score", "source")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))
