"""Queries of text, vector and training-set jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import text as x
from caseloom.plans import projection as p
from caseloom.plans.projection import SQL, table
from caseloom.plans.registry import register


@register("x1_chunks", """WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
cut AS (SELECT doc_id, text, n, 0::BIGINT AS start, 0::BIGINT AS k FROM d
UNION ALL SELECT doc_id, text, n, start + CASE WHEN mark > 251 THEN mark ELSE 500 END - 50, k + 1 FROM (SELECT *, length(regexp_extract(substr(text, start + 1, 500), '(?s)^.*[.\n]')) AS mark FROM cut WHERE start + 500 < n)),
piece AS (SELECT doc_id, k, CASE WHEN start + 500 < n AND mark > 251 THEN substr(text, start + 1, mark) ELSE substr(text, start + 1, 500) END AS piece FROM (SELECT *, length(regexp_extract(substr(text, start + 1, 500), '(?s)^.*[.\n]')) AS mark FROM cut)),
trimmed AS (SELECT doc_id, k, trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS piece FROM piece)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, piece AS text FROM trimmed WHERE piece <> ''""")
def chunks(spark, d):
    """Chunks cut at sentence ends."""
    return x.chunks(table(spark, d, "documents"))


@register("x1_fixed_chunks", """WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 51) + 1, 450)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, (start // 450)::INT AS chunk_index, md5(substr(text, start + 1, 500)) AS digest FROM d""")
def fixed_chunks(spark, d):
    """Chunks of fixed width."""
    return x.fixed_chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@register("x2_chunk_ids", "SELECT conv_id, turn, left(md5('conv-' || conv_id::VARCHAR), 8) || '_' || turn::VARCHAR AS chunk_id FROM conversations")
def chunk_ids(spark, d):
    """Ids of chunks."""
    return table(spark, d, "conversations").select("conv_id", "turn", x.chunk_id(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.col("turn")).alias("chunk_id"))


@register("x3_entity_documents", "SELECT 'vt_bacnt:' || s_suppkey::VARCHAR AS v_id, '[vt_bacnt], actno: ' || s_suppkey::VARCHAR || ', dpstr: ' || s_name AS text FROM supplier UNION ALL SELECT 'vt_psn:' || c_custkey::VARCHAR, '[vt_psn], name: ' || c_name FROM customer")
def entity_documents(spark, d):
    """Text of each vertex."""
    v = p.vertices(spark, d, "vt_bacnt", "vt_psn")
    return v.select("v_id", x.entity_text(F.col("label"), F.col("props"), ["actno", "dpstr", "name"]).alias("text"))


@register("x4_nearest_vectors", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(e, embedding::DOUBLE[]) AS score FROM q JOIN embeddings ON query_id <> vec_id)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def nearest_vectors(spark, d):
    """The five nearest vectors of every hundredth one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return x.nearest(e, e.filter("vec_id % 100 = 0"), 5).select("query_id", "vec_id", "rank")


@register("x7_context_blocks", "SELECT conv_id, md5(string_agg('[' || role || '] ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, role, text)) AS context_md5 FROM conversations GROUP BY conv_id")
def context_blocks(spark, d):
    """Context of each conversation: tagged snippets with separators."""
    snippet = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", F.concat(F.lit("["), F.col("role"), F.lit("] "), snippet).alias("s")))).alias("a"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("a", lambda s: s["s"]), "\n\n---\n\n")).alias("context_md5"))


@register("x8_training_mix", """SELECT part, conv_id, turn, copy FROM ((SELECT 'a' AS part, conv_id, turn, 0 AS copy FROM conversations WHERE role = 'user' ORDER BY md5('s1' || conv_id::VARCHAR || '-' || turn::VARCHAR), conv_id, turn LIMIT 100)
UNION ALL SELECT 'b', conv_id, turn, c::INT FROM conversations, range(10) r(c) WHERE role <> 'user')""")
def training_mix(spark, d):
    """A sample of one part and the other ten times over."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    key = F.md5(F.concat(F.lit("s1"), F.concat_ws("-", "conv_id", "turn")))
    a = c.filter("role = 'user'").orderBy(key, "conv_id", "turn").limit(100).select(F.lit("a").alias("part"), "conv_id", "turn", F.lit(0).alias("copy"))
    return a.unionAll(x.oversampled(c.filter("role <> 'user'"), 10).select(F.lit("b").alias("part"), "conv_id", "turn", "copy"))


@register("x9_template_expansion", """SELECT DISTINCT CASE t WHEN 0 THEN c_name || '의 계좌를 찾아줘' WHEN 1 THEN c_name || '와 통화한 사람은?' ELSE c_mktsegment || ' 사건 목록' END AS instruction FROM customer, range(3) r(t)""")
def template_expansion(spark, d):
    """Distinct instructions from templates and persons."""
    t = [F.concat("c_name", F.lit("의 계좌를 찾아줘")), F.concat("c_name", F.lit("와 통화한 사람은?")), F.concat("c_mktsegment", F.lit(" 사건 목록"))]
    return table(spark, d, "customer").select(F.explode(F.array(*t)).alias("instruction")).distinct()


@register("x10_log_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(upper(text), 'TH') AND length(text) > 10")
def log_filter(spark, d):
    """Logged queries that are usable for training."""
    return table(spark, d, "conversations").filter((F.col("role") == "user") & F.contains(F.upper("text"), F.lit("TH")) & (F.length("text") > 10)).select("conv_id", "turn")


@register("x12_mentions", r"SELECT doc_id, number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{10,20}\b')) AS number FROM documents) GROUP BY ALL")
def mentions(spark, d):
    """Account-like numbers that texts mention."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{10,20}\b"), 0)).alias("number"))
    return t.groupBy("doc_id", "number").agg(F.count("*").alias("n"))


@register("x13_latency_summary", "SELECT event_type, count(*) AS n, min(round(value * 100)::BIGINT) AS least, max(round(value * 100)::BIGINT) AS most, sum(round(value * 100)::BIGINT)::BIGINT AS total, count(*) FILTER (value > 1) AS ok FROM events GROUP BY event_type")
def latency_summary(spark, d):
    """Counts, bounds and successes of measured values."""
    v = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.count(F.when(F.col("value") > 1, 1)).alias("ok"))


@register("s15_page_texts", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS text_sha256 FROM conversations GROUP BY conv_id")
def page_texts(spark, d):
    """Parts of a document joined in order."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("a"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("a", lambda s: s["text"]), "\n"), 256).alias("text_sha256"))
