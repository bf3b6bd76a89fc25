"""Queries of mapped loads, endpoint resolution, case contexts and query expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import cases as c
from caseloom.operators import mapped_load as m
from caseloom.operators import text as x
from caseloom.operators.paths import shared_path
from caseloom.plans import projection as p
from caseloom.plans.dims import dim, dim_sql
from caseloom.plans.projection import table
from caseloom.plans.registry import register
from caseloom.plans.rules import CASE_EDGES_SQL, SCORES_SQL, case_edges, scores


@register("g14_mapped_load", "SELECT 'vt_psn:' || o_custkey::VARCHAR AS v_id, 'vt_psn' AS label, count(*) AS edges, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey")
def mapped_load(spark, d):
    """Orders loaded as person-case pairs; each person with its edges and its last row's property."""
    v, e = m.pairs_load(table(spark, d, "orders"), ["o_orderkey"], ("vt_psn", "o_custkey"), ("vt_case", "o_orderkey"), "involves", source_props=["o_orderpriority"], edge_props=["o_orderstatus"])
    n = e.groupBy(F.col("src").alias("v_id")).agg(F.count("*").alias("edges"))
    return v.filter("label = 'vt_psn'").join(n, "v_id").select("v_id", "label", "edges", F.col("props")["o_orderpriority"].alias("last_priority"))


@register("g15_action_vertices", "SELECT 'Access_' || event_id::VARCHAR AS v_id, event_type AS kind FROM events")
def action_vertices(spark, d):
    """An action vertex for each event."""
    return m.action_vertices(table(spark, d, "events"), "Access", "event_id", ["event_type", "value"]).select("v_id", F.col("props")["event_type"].alias("kind"))


@register("g16_entity_vertices", "SELECT DISTINCT 'vt_psn:' || user_id::VARCHAR AS v_id, 'vt_psn' AS label, user_id::VARCHAR AS key FROM events UNION SELECT DISTINCT 'vt_site:' || event_type, 'vt_site', event_type FROM events")
def entity_vertices(spark, d):
    """Distinct entities of two columns."""
    return m.entity_vertices(table(spark, d, "events"), {"user_id": "vt_psn", "event_type": "vt_site"})


@register("g17_row_edges", "SELECT label, count(*) AS n, min(src) AS least, max(dst) AS most FROM (SELECT 'accessed' AS label, 'vt_psn:' || user_id::VARCHAR AS src, 'Access_' || event_id::VARCHAR AS dst FROM events UNION ALL SELECT 'on_site', 'Access_' || event_id::VARCHAR, 'vt_site:' || event_type FROM events) GROUP BY label")
def row_edges(spark, d):
    """Edges from actors to actions and on to evidence."""
    e = m.row_edges(table(spark, d, "events"), "Access", "event_id", [("user_id", "vt_psn", "accessed", True), ("event_type", "vt_site", "on_site", False)])
    return e.groupBy("label").agg(F.count("*").alias("n"), F.min("src").alias("least"), F.max("dst").alias("most"))


@register("j12_any_label_endpoints", f"WITH {p.vertices_sql('vt_psn', 'vt_org', 'vt_telno')}, w AS (SELECT DISTINCT 'name' AS name, c_name AS value FROM customer UNION SELECT DISTINCT 'org_nm', n_name FROM nation), h AS (SELECT v_id, split_part(x, '=', 1) AS name, split_part(x, '=', 2) AS value FROM (SELECT v_id, unnest(string_split(props, ';')) AS x FROM vertices)) SELECT name, value, min(v_id) AS v_id FROM w LEFT JOIN h USING (name, value) GROUP BY ALL")
def any_label_endpoints(spark, d):
    """Vertices found by a property, whatever their label."""
    w = table(spark, d, "customer").select(F.lit("name").alias("name"), F.col("c_name").alias("value")).union(table(spark, d, "nation").select(F.lit("org_nm"), "n_name")).distinct()
    return m.resolve_any_label(p.vertices(spark, d, "vt_psn", "vt_org", "vt_telno"), w)


@register("r15_case_context", f"""WITH {SCORES_SQL}, {dim_sql('evidence_laws')}, laws AS (SELECT case_id, count(DISTINCT law) AS n_laws FROM (SELECT case_id, unnest(string_split(laws, ',')) AS law FROM case_edges JOIN evidence_laws USING (label)) GROUP BY case_id),
done AS (SELECT case_id, count(*) FILTER (done) AS done, count(*) FILTER (NOT done) AS open FROM checklist GROUP BY case_id)
SELECT b.case_id, b.pattern, b.score, n_laws, done, open, name || ' ' || done::VARCHAR || '/' || (done + open)::VARCHAR AS summary FROM best b JOIN patterns USING (pattern) JOIN laws USING (case_id) JOIN done USING (case_id) WHERE place = 1""")
def case_context(spark, d):
    """Primary pattern, evidence and laws of each case in one row."""
    best = c.best_patterns(scores(spark, d)).filter("primary").select("case_id", "pattern", "score", "labels")
    laws = F.broadcast(dim(spark, "evidence_laws").select("label", F.split("laws", ",").alias("l")))
    laws = best.select("case_id", F.explode("labels").alias("label")).join(laws, "label").groupBy("case_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("l")))).cast("long").alias("n_laws"))
    done = c.checklist(best, dim(spark, "pattern_edges"), dim(spark, "pattern_optional")).groupBy("case_id").agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open"))
    names = F.broadcast(dim(spark, "patterns").select("pattern", "name"))
    x = best.join(names, "pattern").join(laws, "case_id").join(done, "case_id")
    summary = F.concat_ws(" ", "name", F.concat_ws("/", F.col("done").cast("string"), (F.col("done") + F.col("open")).cast("string")))
    return x.select("case_id", "pattern", "score", "n_laws", "done", "open", summary.alias("summary"))


@register("x6_query_expansion", f"""WITH {CASE_EDGES_SQL}, {dim_sql('evidence_laws')}, l AS (SELECT DISTINCT case_id, label, laws FROM case_edges JOIN evidence_laws USING (label)),
w AS (SELECT case_id, list_sort(list(DISTINCT law))[1:3] AS laws FROM (SELECT case_id, unnest(string_split(laws, ',')) AS law FROM l) GROUP BY case_id), n AS (SELECT case_id, list_sort(list(DISTINCT label)) AS labels FROM l GROUP BY case_id)
SELECT case_id, array_to_string(labels, ' ') || ' ' || array_to_string(laws, ' ') AS query FROM n JOIN w USING (case_id)""")
def query_expansion(spark, d):
    """Evidence kinds and the first three laws of each case, as a retrieval query."""
    x = case_edges(spark, d).select("case_id", "label").distinct().join(F.broadcast(dim(spark, "evidence_laws")), "label")
    x = x.groupBy("case_id").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split("laws", ","))))), 1, 3).alias("laws"))
    return x.select("case_id", F.concat_ws(" ", F.array_join("labels", " "), F.array_join("laws", " ")).alias("query"))


@register("x5_delete_chunks", """WITH big AS (SELECT min(source) AS s FROM (SELECT source, rank() OVER (ORDER BY count(*) DESC) AS r FROM documents GROUP BY source) WHERE r = 1),
d AS (SELECT doc_id, source, unnest(range(0, greatest(0, length(text) - 51) + 1, 450)) AS start FROM documents WHERE length(text) > 0)
SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM d WHERE source <> (SELECT s FROM big) GROUP BY source""")
def delete_chunks(spark, d):
    """What is left of a stored chunk table after the source with most documents is deleted from it."""
    docs = table(spark, d, "documents")
    most = docs.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()["source"]
    chunks = x.fixed_chunks(docs).join(docs.select("doc_id", "source"), "doc_id")
    store = x.ChunkStore(spark, shared_path(spark)).write(chunks)
    store.delete(most)
    return store.read().groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


@register("f29_edge_sentences", "SELECT o_orderkey AS case_id, 'vt_case:' || o_orderkey::VARCHAR || ' -[involves: priority=' || o_orderpriority || ', status=' || o_orderstatus || ']-> vt_psn:' || o_custkey::VARCHAR AS sentence FROM orders")
def edge_sentences(spark, d):
    """edges as sentences."""
    from caseloom.functions import ontology

    o = table(spark, d, "orders")
    props = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("source"), F.lit("csv"))
    s = ontology.sentence(F.concat(F.lit("vt_case:"), F.col("o_orderkey").cast("string")), F.lit("involves"), props, F.concat(F.lit("vt_psn:"), F.col("o_custkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("case_id"), s.alias("sentence"))


@register("f7_node_labels", f"WITH {p.vertices_sql()} SELECT label AS stored, CASE label WHEN 'vt_case' THEN 'vt_flnm' WHEN 'vt_psn' THEN 'vt_psn' WHEN 'vt_bacnt' THEN 'vt_bacnt' WHEN 'vt_telno' THEN 'vt_telno' ELSE 'vt_psn' END AS derived, count(*) AS n FROM vertices GROUP BY ALL")
def node_labels(spark, d):
    """labels derived from property names against the stored ones."""
    from caseloom.functions import ontology

    return p.vertices(spark, d).groupBy(F.col("label").alias("stored"), ontology.node_label(F.col("props")).alias("derived")).agg(F.count("*").alias("n"))
