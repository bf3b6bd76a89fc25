"""Queries of rules, inference, alerts, pattern scores and evidence, for all cases at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.operators import cases as c
from caseloom.operators import grid
from caseloom.operators.pairs import linked
from caseloom.plans import projection as p
from caseloom.plans.dims import dim, dim_sql
from caseloom.plans.projection import SQL, table
from caseloom.plans.registry import register
from caseloom.plans.relational import cte

# A case's evidence: accounts of its returned or accepted lines, phones of its finished lines, addresses by the customer's events, sites and files by the host of
# a page with the case's number, a file being a page that is one.
EVIDENCE_SQL = """ev_account AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS account FROM lineitem WHERE l_returnflag <> 'N'),
ev_phone AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS phone FROM lineitem WHERE l_linestatus = 'F')"""
CASE_EDGES_SQL = f"""{EVIDENCE_SQL}, {SQL['used_ip']}, case_edges AS (
SELECT case_id, 'eg_used_account' AS edge, 'vt_bacnt' AS label, 'vt_bacnt:' || account::VARCHAR AS node FROM ev_account
UNION ALL SELECT case_id, 'eg_used_phone', 'vt_telno', 'vt_telno:' || phone::VARCHAR FROM ev_phone
UNION ALL SELECT DISTINCT o_orderkey, 'used_ip', 'vt_ip', 'vt_ip:' || ip FROM orders JOIN used_ip ON o_custkey = person
UNION ALL SELECT page_id, 'digital_trace', 'vt_site', 'vt_site:' || split_part(url, '/', 3) FROM pages
UNION ALL SELECT page_id, 'related_to', 'vt_file', 'vt_file:' || page_id::VARCHAR FROM pages WHERE contains(url, '.html'))"""


def case_edges(spark, d):
    """(case_id, edge, label, node) of every case."""
    def some(df, edge, label, key):
        return df.select("case_id", F.lit(edge).alias("edge"), F.lit(label).alias("label"), F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("node"))

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("person"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("case_id"), F.get(F.split("url", "/"), 2).alias("site"), F.contains("url", F.lit(".html")).alias("is_file"))
    lines = table(spark, d, "lineitem")
    accounts = lines.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("account")).distinct()
    phones = lines.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("phone")).distinct()
    out = some(accounts, "eg_used_account", "vt_bacnt", "account").unionAll(some(phones, "eg_used_phone", "vt_telno", "phone"))
    out = out.unionAll(some(o.join(p.used_ip(spark, d), "person"), "used_ip", "vt_ip", "ip"))
    out = out.unionAll(some(pages, "digital_trace", "vt_site", "site"))
    return out.unionAll(some(pages.filter("is_file"), "related_to", "vt_file", "case_id"))


SCORES_SQL = f"""{CASE_EDGES_SQL}, {dim_sql('patterns')}, {dim_sql('pattern_edges')}, {dim_sql('pattern_optional')},
node AS (SELECT case_id, label, min(node) AS node FROM case_edges GROUP BY case_id, label),
bound AS (SELECT DISTINCT e.case_id, e.label, e.edge FROM case_edges e JOIN node n ON e.case_id = n.case_id AND e.label = n.label AND e.node = n.node),
need AS (SELECT pattern, count(DISTINCT label) AS labels, count(*) AS edges FROM pattern_edges GROUP BY pattern),
present AS (SELECT case_id, pattern, count(*) AS present FROM node JOIN (SELECT DISTINCT pattern, label FROM pattern_edges) USING (label) GROUP BY ALL),
matched AS (SELECT case_id, pattern, count(*) AS matched FROM bound JOIN pattern_edges USING (edge, label) GROUP BY ALL),
extra AS (SELECT case_id, pattern, count(*) AS found FROM node JOIN pattern_optional USING (label) GROUP BY ALL),
options AS (SELECT pattern, count(*) AS options FROM pattern_optional GROUP BY pattern),
scores AS (SELECT case_id, pattern, coalesce(matched, 0) AS matched, coalesce(found, 0) AS found_optional, round(coalesce(matched, 0)::DOUBLE / edges * w_required::DOUBLE + coalesce(found, 0)::DOUBLE / options * w_optional::DOUBLE, 3) AS score, least
  FROM present JOIN need USING (pattern) LEFT JOIN matched USING (case_id, pattern) LEFT JOIN extra USING (case_id, pattern) JOIN patterns USING (pattern) LEFT JOIN options USING (pattern) WHERE present = labels),
best AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pattern) AS place FROM scores WHERE score >= least),
items AS (SELECT DISTINCT pattern, 'required' AS kind, label, 1.0 AS weight FROM pattern_edges UNION ALL SELECT pattern, 'optional', label, weight FROM pattern_optional),
checklist AS (SELECT s.case_id, s.pattern, kind, label, weight, n.node IS NOT NULL AS done FROM best s JOIN items USING (pattern) LEFT JOIN node n USING (case_id, label) WHERE place = 1)"""


def case_slots(spark, d):
    """(case_id, edge, label, node) of every case, with the smallest vertex of each kind only: all that patterns are matched with.

    The smallest address is that of the person, found before persons meet their cases.
    """
    def some(df, edge, label, key):
        return df.select("case_id", F.lit(edge).alias("edge"), F.lit(label).alias("label"), F.concat(F.lit(label + ":"), key).alias("node"))

    lines = table(spark, d, "lineitem")
    least = lambda condition, key: lines.filter(condition).groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min(F.col(key).cast("string")).alias("x"))
    ips = table(spark, d, "events").select(F.col("user_id").alias("person"), F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("ip")).groupBy("person").agg(F.min("ip").alias("ip"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("case_id"), F.get(F.split("url", "/"), 2).alias("site"), F.contains("url", F.lit(".html")).alias("is_file"))
    out = some(least("l_returnflag <> 'N'", "l_suppkey"), "eg_used_account", "vt_bacnt", F.col("x")).unionAll(some(least("l_linestatus = 'F'", "l_partkey"), "eg_used_phone", "vt_telno", F.col("x")))
    out = out.unionAll(some(p.involves(spark, d).join(ips, "person"), "used_ip", "vt_ip", F.col("ip")))
    return out.unionAll(some(pages, "digital_trace", "vt_site", F.col("site"))).unionAll(some(pages.filter("is_file"), "related_to", "vt_file", F.col("case_id").cast("string")))


def scores(spark, d):
    return c.pattern_scores(case_slots(spark, d), dim(spark, "patterns"), dim(spark, "pattern_edges"), dim(spark, "pattern_optional"))


def _checklist(spark, d):
    return c.checklist(c.best_patterns(scores(spark, d)).filter("primary"), dim(spark, "pattern_edges"), dim(spark, "pattern_optional"))


@register("r10_pattern_scores", f"WITH {SCORES_SQL} SELECT case_id, pattern, matched, found_optional, score FROM scores WHERE score >= least")
def pattern_scores(spark, d):
    """Template scores that reach their threshold."""
    return scores(spark, d).filter("score >= least").drop("least", "labels")


@register("r9_pattern_lookup", f"""WITH {SCORES_SQL}, n AS (SELECT pattern, count(*) AS cases FROM best WHERE place = 1 GROUP BY pattern), req AS (SELECT pattern, array_to_string(list_sort(list(DISTINCT label)), ',') AS required FROM pattern_edges GROUP BY pattern)
SELECT p.pattern, p.name, required, p.least, coalesce(cases, 0) AS cases FROM patterns p JOIN req USING (pattern) LEFT JOIN n USING (pattern) WHERE contains(p.name, '사기') OR pattern IN (SELECT pattern FROM pattern_edges WHERE label = 'vt_site')""")
def pattern_lookup(spark, d):
    """Patterns found by a part of their name or by a label that they need, with what they need and the cases whose primary pattern they are."""
    edges = dim(spark, "pattern_edges")
    found = dim(spark, "patterns").join(F.broadcast(edges.filter("label = 'vt_site'").select("pattern", F.lit(True).alias("by_label")).distinct()), "pattern", "left").filter(F.contains("name", F.lit("사기")) | F.col("by_label"))
    required = edges.groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("required"))  # a fixed table
    n = c.best_patterns(scores(spark, d)).filter("primary").groupBy("pattern").agg(F.count("*").alias("cases"))
    return found.join(required, "pattern").join(n, "pattern", "left").select("pattern", "name", "required", "least", F.coalesce("cases", F.lit(0)).alias("cases"))


@register("w7_primary_pattern", f"WITH {SCORES_SQL} SELECT case_id, pattern, score FROM best WHERE place = 1")
def primary_pattern(spark, d):
    """The primary pattern of each case."""
    return c.best_patterns(scores(spark, d)).filter("primary").select("case_id", "pattern", "score")


@register("r11_evidence_checklist", f"WITH {SCORES_SQL} SELECT case_id, pattern, kind, label, done FROM checklist")
def evidence_checklist(spark, d):
    """Checklist of the primary pattern's evidence."""
    return _checklist(spark, d).drop("weight")


@register("a21_evidence_completeness", f"""WITH {SCORES_SQL}, x AS (SELECT case_id, pattern, round(coalesce(avg(CASE WHEN kind = 'required' THEN done::INT::DOUBLE END), 0) * 0.7::DOUBLE + coalesce(avg(CASE WHEN kind = 'optional' THEN done::INT::DOUBLE END), 0) * 0.3::DOUBLE, 3) AS completeness FROM checklist GROUP BY ALL)
SELECT *, CASE WHEN completeness >= 0.9 THEN 'excellent' WHEN completeness >= 0.75 THEN 'good' WHEN completeness >= 0.6 THEN 'fair' ELSE 'poor' END AS band FROM x""")
def evidence_completeness(spark, d):
    """Completeness and its band."""
    return c.evidence_completeness(_checklist(spark, d))


@register("t4_recommendations", f"""WITH {SCORES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY case_id, pattern ORDER BY CASE kind WHEN 'required' THEN 0 ELSE 1 END, weight DESC, label) AS place FROM checklist WHERE NOT done AND (kind = 'required' OR weight >= 0.15))
SELECT case_id, pattern, place, CASE kind WHEN 'required' THEN '[필수] ' || label || ' 확보 필요' ELSE '[권장] ' || label || ' 확보 권장' END AS advice FROM m WHERE place <= 5""")
def recommendations(spark, d):
    """The five most important missing items."""
    return c.recommendations(_checklist(spark, d))


@register("r12_evidence_classes", f"WITH {CASE_EDGES_SQL}, {dim_sql('evidence_laws')} SELECT case_id, label, importance, count(*) AS n FROM case_edges JOIN evidence_laws USING (label) GROUP BY ALL")
def evidence_classes(spark, d):
    """Evidence of each case by kind and importance."""
    return case_edges(spark, d).join(F.broadcast(dim(spark, "evidence_laws")), "label").groupBy("case_id", "label", "importance").agg(F.count("*").alias("n"))


@register("r13_applicable_laws", f"WITH {CASE_EDGES_SQL}, {dim_sql('evidence_laws')} SELECT case_id, array_to_string(list_sort(list(DISTINCT law)), ',') AS laws FROM (SELECT case_id, unnest(string_split(laws, ',')) AS law FROM (SELECT DISTINCT case_id, laws FROM case_edges JOIN evidence_laws USING (label))) GROUP BY case_id")
def applicable_laws(spark, d):
    """Laws that a case's evidence touches."""
    x = case_edges(spark, d).select("case_id", "label").distinct().join(F.broadcast(dim(spark, "evidence_laws")), "label")
    return x.groupBy("case_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split("laws", ","))))), ",").alias("laws"))


@register("r14_readiness", f"""WITH {CASE_EDGES_SQL}, {dim_sql('crime_evidence')}, h AS (SELECT case_id, list(DISTINCT label) AS have FROM case_edges GROUP BY case_id),
x AS (SELECT case_id, crime, have, string_split(required, ',') AS req, string_split(optional, ',') AS opt FROM h, crime_evidence),
y AS (SELECT case_id, crime, round(len(list_intersect(req, have))::DOUBLE / len(req) * 0.7::DOUBLE + len(list_intersect(opt, have))::DOUBLE / len(opt) * 0.3::DOUBLE, 2) AS score,
 array_to_string(list_sort(list_filter(req, lambda v: NOT list_contains(have, v))), ',') AS missing_required, array_to_string(list_sort(list_filter(opt, lambda v: NOT list_contains(have, v))), ',') AS missing_optional FROM x)
SELECT *, CASE WHEN score >= 0.85 THEN 'ready' WHEN score >= 0.6 THEN 'partial' ELSE 'weak' END AS band FROM y""")
def readiness(spark, d):
    """Readiness of every case for every crime type."""
    return c.readiness(case_edges(spark, d), dim(spark, "crime_evidence"))


@register("r2_voice_phishing", f"WITH {EVIDENCE_SQL}, a AS (SELECT case_id, 'vt_bacnt:' || account::VARCHAR AS node FROM ev_account), t AS (SELECT case_id, 'vt_telno:' || phone::VARCHAR AS node FROM ev_phone) SELECT a.case_id, a.node AS account, t.node AS phone FROM a JOIN t USING (case_id)")
def voice_phishing(spark, d):
    """Cases with a phone and an account, one row per pair."""
    e = case_edges(spark, d)
    return e.filter("edge = 'eg_used_account'").select("case_id", F.col("node").alias("account")).join(e.filter("edge = 'eg_used_phone'").select("case_id", F.col("node").alias("phone")), "case_id")


@register("r3_two_accounts", f"WITH {EVIDENCE_SQL}, a AS (SELECT case_id, 'vt_bacnt:' || account::VARCHAR AS node FROM ev_account), t AS (SELECT case_id, 'vt_telno:' || phone::VARCHAR AS node FROM ev_phone) SELECT a.case_id, a.node AS account, b.node AS other FROM a JOIN a b USING (case_id) WHERE a.node < b.node AND a.case_id IN (SELECT case_id FROM t)")
def two_accounts(spark, d):
    """Cases with a phone and two different accounts."""
    e = case_edges(spark, d)
    a = e.filter("edge = 'eg_used_account'").select("case_id", F.col("node").alias("account"))
    x = a.join(a.withColumnRenamed("account", "other"), "case_id").filter("account < other")
    return x.join(e.filter("edge = 'eg_used_phone'").select("case_id").distinct(), "case_id", "left_semi")


@register("r1_bodycam", f"WITH {CASE_EDGES_SQL} SELECT DISTINCT s.case_id, s.node AS site, f.node AS file FROM case_edges s JOIN case_edges f USING (case_id) JOIN case_edges a USING (case_id) WHERE s.edge = 'digital_trace' AND f.edge = 'related_to' AND a.edge = 'eg_used_account' AND regexp_matches(s.node, '(th|er)')")
def bodycam(spark, d):
    """Cases with a site whose name matches, a file and an account."""
    e = case_edges(spark, d)
    s = e.filter(F.col("edge") == "digital_trace").filter(F.col("node").rlike("(th|er)")).select("case_id", F.col("node").alias("site"))
    f = e.filter("edge = 'related_to'").select("case_id", F.col("node").alias("file"))
    return s.join(f, "case_id").join(e.filter("edge = 'eg_used_account'").select("case_id").distinct(), "case_id", "left_semi").distinct()


@register("r4_site_and_account", f"WITH {CASE_EDGES_SQL} SELECT DISTINCT s.case_id, s.node AS site FROM case_edges s JOIN case_edges a USING (case_id) WHERE s.edge = 'digital_trace' AND a.edge = 'eg_used_account' AND (contains(s.node, 'on') OR contains(s.node, 'in'))")
def site_and_account(spark, d):
    """Cases with an account and a site whose name has one of some words."""
    e = case_edges(spark, d)
    s = e.filter((F.col("edge") == "digital_trace") & (F.col("node").contains("on") | F.col("node").contains("in"))).select("case_id", F.col("node").alias("site")).distinct()
    return s.join(e.filter("edge = 'eg_used_account'").select("case_id").distinct(), "case_id", "left_semi")


@register("r5_smishing", f"WITH {CASE_EDGES_SQL} SELECT case_id FROM case_edges WHERE edge IN ('eg_used_phone', 'digital_trace', 'eg_used_account') GROUP BY case_id HAVING count(DISTINCT edge) = 3")
def smishing(spark, d):
    """Cases with a phone, a site and an account."""
    e = case_edges(spark, d).filter(F.col("edge").isin("eg_used_phone", "digital_trace", "eg_used_account"))
    return e.groupBy("case_id").agg(F.countDistinct("edge").alias("n")).filter("n = 3").select("case_id")


ALERTS_SQL = f"""{SQL['used_account']}, {SQL['used_phone']}, {SQL['transfers']}, {SQL['calls']}, alerts AS (
SELECT 'phone_in_cases' AS rule, 30 AS score, phone::BIGINT AS id, count(*) AS n FROM used_phone GROUP BY phone HAVING count(*) >= 3
UNION ALL SELECT 'account_in_cases', 30, account, count(*) FROM used_account GROUP BY account HAVING count(*) >= 3
UNION ALL SELECT 'chain_of_three', 20, case_id, count(*) FROM transfers GROUP BY case_id HAVING count(*) >= 3
UNION ALL SELECT 'busy_phone', 15, dst, count(*) FROM calls GROUP BY dst HAVING count(*) >= 50)"""


def alerts(spark, d):
    """Alert rows of four rules, each a grouped count over its own relation."""
    def rule(name, score, df, key, least):
        return df.groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.lit(name).alias("rule"), F.lit(score).alias("score"), "id", "n")

    out = rule("phone_in_cases", 30, p.used_phone(spark, d), "phone", 3).unionAll(rule("account_in_cases", 30, p.used_account(spark, d), "account", 3))
    return out.unionAll(rule("chain_of_three", 20, p.transfers(spark, d), "case_id", 3)).unionAll(rule("busy_phone", 15, p.calls(spark, d), "dst", 50))


@register("r16_alerts", f"WITH {ALERTS_SQL} SELECT * FROM alerts")
def r16_alerts(spark, d):
    """Alerts of all rules."""
    return alerts(spark, d)


@register("a10_alert_summary", f"WITH {ALERTS_SQL} SELECT rule, count(*) AS alerts, sum(score)::BIGINT AS total, CASE WHEN sum(score) >= 80 THEN 'high' WHEN sum(score) >= 50 THEN 'caution' ELSE 'normal' END AS band FROM alerts GROUP BY rule")
def alert_summary(spark, d):
    """A10: alerts by rule with their total score and risk band."""
    x = alerts(spark, d).groupBy("rule").agg(F.count("*").alias("alerts"), F.sum("score").alias("total"))
    return x.withColumn("band", F.when(F.col("total") >= 80, "high").when(F.col("total") >= 50, "caution").otherwise("normal"))


@register("r17_organized_crime", cte("used_phone", body="SELECT phone, case_id, count(*) OVER (PARTITION BY phone) AS cases, 0.8::DOUBLE AS confidence FROM used_phone QUALIFY count(*) OVER (PARTITION BY phone) >= 3"))
def organized_crime(spark, d):
    """Phones of three or more cases, with the cases as rows, so that no phone's cases are gathered in one place."""
    u = p.used_phone(spark, d)
    hot = u.groupBy("phone").agg(F.count("*").alias("cases")).filter("cases >= 3")
    return u.join(hot, "phone").select("phone", "case_id", "cases", F.lit(0.8).alias("confidence"))


@register("r18_money_laundering", cte("transfers", body="""SELECT account, ins * outs AS pairs, 0.75::DOUBLE AS confidence FROM (SELECT account, sum(i)::BIGINT AS ins, sum(o)::BIGINT AS outs FROM (SELECT dst AS account, 1 AS i, 0 AS o FROM transfers UNION ALL SELECT src, 0, 1 FROM transfers) GROUP BY account) WHERE ins * outs >= 3"""))
def money_laundering(spark, d):
    """Accounts with three or more (in, out) pairs, from the product of their counts; no pair is ever made."""
    t = p.transfers(spark, d)
    ends = t.select(F.col("dst").alias("account"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(t.select(F.col("src").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    x = ends.groupBy("account").agg((F.sum("i") * F.sum("o")).alias("pairs"))
    return x.filter("pairs >= 3").withColumn("confidence", F.lit(0.75))


@register("r19_accomplices", cte("calls", body=""", n AS (SELECT src, dst, count(*) AS n FROM calls GROUP BY src, dst), x AS (SELECT a.src AS a, b.src AS b, count(*) AS phones, sum(a.n + b.n)::BIGINT AS calls FROM n a JOIN n b USING (dst) WHERE a.src < b.src GROUP BY ALL)
SELECT a, b, phones, calls, 0.7::DOUBLE AS confidence FROM x WHERE phones >= 5"""))
def accomplices(spark, d):
    """Pairs of callers of the same phones; calls are counted per pair of ends before the self-join."""
    n = p.calls(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    x = linked(n, ["dst"], "src", 5, ("n",))
    return x.groupBy("a", "b").agg(F.count("*").alias("phones"), F.sum(F.col("n_a") + F.col("n_b")).alias("calls")).filter("phones >= 5").withColumn("confidence", F.lit(0.7))


@register("r20_night_activity", "SELECT user_id, count(*) AS n, 0.65::DOUBLE AS confidence FROM events WHERE extract(hour FROM ts) < 6 GROUP BY user_id HAVING count(*) >= 3")
def night_activity(spark, d):
    """Users with three or more events between 0 and 6 o'clock."""
    return table(spark, d, "events").filter(F.hour("ts") < 6).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3").withColumn("confidence", F.lit(0.65))


#: The person that a phone was first used by: who it is registered for.
OWNED_SQL = "owned_phone AS (SELECT l_partkey AS phone, arg_min(o_custkey, (o_orderdate, o_orderkey, o_custkey)) AS person FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey)"


def owned_phone(spark, d):
    li, o = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("phone")), table(spark, d, "orders")
    first = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("phone").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_custkey")).alias("x"))
    return first.select("phone", F.col("x.o_custkey").alias("person"))


@register("r21_cross_domain", cte("used_ip", "has_account", body=f""", {OWNED_SQL}, r AS (SELECT ip, 'a' AS kind, account AS id FROM used_ip JOIN has_account USING (person) UNION SELECT ip, 'p', phone FROM used_ip JOIN owned_phone USING (person))
SELECT ip, count(*) FILTER (kind = 'a') AS accounts, count(*) FILTER (kind = 'p') AS phones, 0.8::DOUBLE AS confidence FROM r GROUP BY ip HAVING count(*) >= 2"""))
def cross_domain(spark, d):
    """Addresses from which two or more accounts and phones are reached."""
    kind = lambda df, name, key: df.select("ip", F.lit(name).alias("kind"), F.col(key).alias("id"))
    phones = p.used_ip(spark, d).join(owned_phone(spark, d), "person").select("ip", "phone").distinct()
    r = kind(p.accounts_of_ip(spark, d), "a", "account").unionAll(kind(phones, "p", "phone"))
    count = lambda k: F.count_if(F.col("kind") == k)
    return r.groupBy("ip").agg(count("a").alias("accounts"), count("p").alias("phones")).filter("accounts + phones >= 2").withColumn("confidence", F.lit(0.8))


@register("r22_same_location", cte("used_ip", body="SELECT a.person AS src, b.person AS dst, 'same_location' AS label, true AS is_virtual, min(ip) AS reason, count(*) AS weight FROM used_ip a JOIN used_ip b USING (ip) WHERE a.person > b.person GROUP BY ALL"))
def same_location(spark, d):
    """Virtual edges between persons that share an address, with the count of shared ones."""
    x = grid.common(p.used_ip(spark, d), "ip", "person")
    return x.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit("same_location").alias("label"), F.lit(True).alias("is_virtual"), F.col("least").alias("reason"), F.col("shared").alias("weight"))


@register("r22_strongest_links", cte("used_ip", body=""", x AS (SELECT a.person AS a, b.person AS b, count(*) AS weight FROM used_ip a JOIN used_ip b USING (ip) WHERE a.person <> b.person GROUP BY ALL)
SELECT a, b, weight, (row_number() OVER (PARTITION BY a ORDER BY weight DESC, b))::INT AS place FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) <= 5"""))
def strongest_links(spark, d):
    """For each person the five others with most shared addresses."""
    both = grid.strongest(p.used_ip(spark, d), "ip", "person", 5).withColumnRenamed("shared", "weight")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    return both.withColumn("place", place).filter("place <= 5")


@register("r23_indirect_transfer", cte("transfers", body="SELECT DISTINCT a.src AS src, b.dst AS dst, a.dst AS via FROM transfers a JOIN transfers b ON a.case_id = b.case_id AND a.dst = b.src AND a.qty = b.qty WHERE a.src <> b.dst"))
def indirect_transfer(spark, d):
    """Hidden transfers through an account that passes the same quantity on."""
    t = p.transfers(spark, d)
    x = t.select("case_id", "qty", F.col("src").alias("src"), F.col("dst").alias("via")).join(t.select("case_id", "qty", F.col("src").alias("via"), F.col("dst").alias("dst")), ["case_id", "qty", "via"])
    return x.filter("src <> dst").select("src", "dst", "via").distinct()


@register("r24_role_labels", cte("transfers", body="""SELECT account, CASE WHEN outs = 0 THEN 'sink' WHEN ins = 0 THEN 'source' WHEN in_sum >= 2 * out_sum THEN 'headquarters' WHEN abs(in_sum - out_sum) * 10 <= in_sum THEN 'cash_mule' ELSE 'member' END AS role FROM
(SELECT account, sum(i)::BIGINT AS ins, sum(o)::BIGINT AS outs, sum(i * amount)::BIGINT AS in_sum, sum(o * amount)::BIGINT AS out_sum FROM (SELECT dst AS account, 1 AS i, 0 AS o, amount FROM transfers UNION ALL SELECT src, 0, 1, amount FROM transfers) GROUP BY account)"""))
def role_labels(spark, d):
    """Role of each account from what comes in and goes out."""
    t = p.transfers(spark, d)
    ends = t.select(F.col("dst").alias("account"), F.lit(1).alias("i"), F.lit(0).alias("o"), "amount").unionAll(t.select(F.col("src").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o"), "amount"))
    x = ends.groupBy("account").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.sum(F.col("i") * F.col("amount")).alias("in_sum"), F.sum(F.col("o") * F.col("amount")).alias("out_sum"))
    role = F.when(F.col("outs") == 0, "sink").when(F.col("ins") == 0, "source").when(F.col("in_sum") >= 2 * F.col("out_sum"), "headquarters").when(F.abs(F.col("in_sum") - F.col("out_sum")) * 10 <= F.col("in_sum"), "cash_mule").otherwise("member")
    return x.select("account", role.alias("role"))


@register("r24_shared_device", """WITH u AS (SELECT DISTINCT l_partkey AS phone, o_orderdate AS day, o_custkey AS person FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.person AS a, b.person AS b, count(*) AS times FROM u a JOIN u b USING (phone, day) WHERE a.person < b.person GROUP BY ALL""")
def shared_device(spark, d):
    """Pairs of persons that used one phone on one day."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("phone")), table(spark, d, "orders")
    u = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("phone", F.col("o_orderdate").alias("day"), F.col("o_custkey").alias("person")).distinct()
    return linked(u, ["phone", "day"], "person").groupBy("a", "b").agg(F.count("*").alias("times"))


@register("r24_timed_transfer", cte("transfers", body="""SELECT DISTINCT a.src AS src, b.dst AS dst, a.dst AS via FROM transfers a JOIN transfers b ON a.case_id = b.case_id AND a.dst = b.src AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 90 DAY
WHERE a.src <> b.dst AND a.seq <> b.seq AND abs(a.amount - b.amount) * 10 <= a.amount"""))
def timed_transfer(spark, d):
    """Hidden transfers through an account that passes nearly the same amount on within a time."""
    t = p.transfers(spark, d)
    x = t.select("case_id", F.col("seq").alias("s1"), "src", F.col("dst").alias("via"), F.col("amount").alias("a1"), F.col("ts").alias("t1"))
    y = t.select("case_id", F.col("seq").alias("s2"), F.col("src").alias("via"), "dst", F.col("amount").alias("a2"), F.col("ts").alias("t2"))
    both = x.join(y, ["case_id", "via"]).filter("src <> dst and s1 <> s2 and abs(a1 - a2) * 10 <= a1 and t2 >= t1 and t2 <= t1 + interval 90 days")
    return both.select("src", "dst", "via").distinct()


#: Two persons use an address together if their uses lie at most so many seconds apart.
TOGETHER = 6 * 3600
_USES = "SELECT user_id, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS ip, epoch(date_trunc('second', ts))::BIGINT AS s FROM events"


@register("r28_co_use", f"WITH u AS ({_USES}) SELECT a.user_id AS a, b.user_id AS b, count(*) AS weight FROM u a JOIN u b USING (ip) WHERE a.user_id < b.user_id AND abs(a.s - b.s) <= {TOGETHER} GROUP BY ALL HAVING count(*) >= 2")
def co_use(spark, d):
    """Pairs of persons that often use an address within six hours of each other, with the count as weight."""
    u = table(spark, d, "events").select("user_id", F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("ip"), F.unix_timestamp("ts").alias("s"))
    return grid.together(u, "ip", "user_id", "s", TOGETHER, 2)


@register("r29_mismatch_owner", """WITH u AS (SELECT l_partkey AS phone, o_custkey AS person, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), m AS (SELECT phone, person AS user, row_number() OVER (PARTITION BY phone ORDER BY n DESC, person) AS r FROM u)
SELECT phone, user, phone % 1500 AS owner FROM m WHERE r = 1 AND user <> phone % 1500""")
def mismatch_owner(spark, d):
    """Phones whose owner is not their most frequent user."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("phone")), table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    u = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("phone", "person").agg(F.count("*").alias("n"))
    m = u.groupBy("phone").agg(F.max_by("person", F.struct("n", -F.col("person"))).alias("user"))
    return m.withColumn("owner", F.col("phone") % 1500).filter("user <> owner")


@register("r30_role_edges", "SELECT o_orderkey AS case_id, o_custkey AS person, CASE o_orderstatus WHEN 'F' THEN 'investigates' WHEN 'O' THEN 'targets' ELSE 'witnesses' END AS label FROM orders")
def role_edges(spark, d):
    """Case edges named by role."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "F", "investigates").when(F.col("o_orderstatus") == "O", "targets").otherwise("witnesses").alias("label"))


@register("r31_merged_identities", """WITH same AS (SELECT c_custkey AS person, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal)) AS into_person FROM customer)
SELECT into_person AS person, count(*) AS cases FROM orders JOIN same ON o_custkey = person GROUP BY 1""")
def merged_identities(spark, d):
    """Persons that agree in nation, segment and whole balance are merged into the smallest of them and their edges moved."""
    same = ["c_nationkey", "c_mktsegment", F.floor("c_acctbal").alias("balance")]
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), *same)
    low = c.groupBy("c_nationkey", "c_mktsegment", "balance").agg(F.min("person").alias("into"))
    into = c.join(low, ["c_nationkey", "c_mktsegment", "balance"]).select("person", "into")
    return p.involves(spark, d).join(into, "person").groupBy(F.col("into").alias("person")).agg(F.count("*").alias("cases"))


@register("r26_semantic_summary", f"WITH {p.edges_sql()}, {dim_sql('relations')} SELECT label, domain, \"range\", count(*) AS n, count(DISTINCT dst) AS resources FROM edges JOIN relations ON label = relation GROUP BY ALL")
def semantic_summary(spark, d):
    """Relations with the concepts they link."""
    r = dim(spark, "relations").select(F.col("relation").alias("label"), "domain", "range")
    c, s = p.account_sides(spark, d)
    own = p.edge_totals(spark, d).filter("label = 'has_account'").crossJoin(s.join(c, p.SAME, "left_semi").agg(F.countDistinct("account").alias("resources")))  # one row each
    x = p.edges(spark, d, *p.OTHERS).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("resources")).unionAll(own)
    return x.join(F.broadcast(r), "label").select("label", "domain", "range", "n", "resources")


@register("a11_concept_counts", f"WITH {p.vertices_sql()}, {dim_sql('concepts')} SELECT concept, label_ko, layer, count(*) AS n FROM vertices JOIN concepts USING (label) GROUP BY ALL")
def concept_counts(spark, d):
    """Vertices by concept, layer and Korean name."""
    return p.vertices(spark, d).join(F.broadcast(dim(spark, "concepts")), "label").groupBy("concept", "label_ko", "layer").agg(F.count("*").alias("n"))


@register("g22_hubs", cte("involves", "has_account", "used_account", body=""", x AS (SELECT 'person' AS kind, person::BIGINT AS id, 1 AS n FROM involves UNION ALL SELECT 'person', person, 1 FROM has_account UNION ALL SELECT 'account', account, 1 FROM used_account UNION ALL SELECT 'account', account, 1 FROM has_account)
SELECT kind, id, count(*) AS total FROM x GROUP BY kind, id ORDER BY total DESC, kind, id LIMIT 20"""))
def hubs(spark, d):
    """Persons and accounts with most edges."""
    def ends(df, key):
        return df.select(F.lit(key).alias("kind"), F.col(key).cast("long").alias("id"), "n")

    one = lambda df: df.withColumn("n", F.lit(1).cast("long"))
    x = ends(one(p.involves(spark, d)), "person").unionAll(ends(one(p.used_account(spark, d)), "account"))
    for side in ("person", "account"):
        x = x.unionAll(ends(p.account_degrees(spark, d, side), side))
    return x.groupBy("kind", "id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "kind", "id").limit(20)
