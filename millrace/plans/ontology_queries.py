"""Graphs, triples, questions and requirement checks over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.operators import ontology as o
from millrace.operators import survey as v
from millrace.plans.tables import read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _tables(spark, sf):
    return {"Customer": read(spark, sf, "customer"), "Nation": read(spark, sf, "nation"), "Region": read(spark, sf, "region"), "Supplier": read(spark, sf, "supplier")}


KEYS = {"Customer": "c_custkey", "Nation": "n_nationkey", "Region": "r_regionkey", "Supplier": "s_suppkey"}
RELATIONS = (("Customer", "c_nationkey", "Nation", "in_nation"), ("Nation", "n_regionkey", "Region", "in_region"), ("Supplier", "s_nationkey", "Nation", "in_nation"))
EDGES = """ed AS (SELECT DISTINCT 'Customer:' || c_custkey AS "from", 'Nation:' || n_nationkey AS "to", 'in_nation' AS rel FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT DISTINCT 'Nation:' || n_nationkey, 'Region:' || r_regionkey, 'in_region' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT DISTINCT 'Supplier:' || s_suppkey, 'Nation:' || n_nationkey, 'in_nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("build_graph", f'WITH {EDGES} SELECT * FROM ed')
def _(spark, sf):
    return o.build_graph(_tables(spark, sf), KEYS, RELATIONS)[1]


@query("graph_nodes", "SELECT 'Customer:' || c_custkey AS id, 'Customer' AS entity FROM customer UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'Region:' || r_regionkey, 'Region' FROM region UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier' FROM supplier")
def _(spark, sf):
    return o.build_graph(_tables(spark, sf), KEYS, RELATIONS)[0]


@query("traverse", f"""WITH {EDGES}, st AS (SELECT 'Nation:' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0)
 SELECT id AS start, "to" AS neighbour, rel, 'out' AS direction FROM ed JOIN st ON id = "from" UNION ALL SELECT id, "from", rel, 'in' FROM ed JOIN st ON id = "to\"""")
def _(spark, sf):
    starts = read(spark, sf, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return o.traverse(o.build_graph(_tables(spark, sf), KEYS, RELATIONS)[1], starts)


@query("link_entities", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
 SELECT c_custkey, c_name, o_orderkey, o_orderstatus, o_orderkey IS NOT NULL AS match FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON c_custkey = o_custkey""")
def _(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.link_entities(read(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_custkey", "o_orderkey").drop("o_custkey")


REL = {"c_nationkey": ("inNation", "Nation"), "c_mktsegment": ("inSegment", "Segment")}


def triples(spark, sf):
    return o.rows_to_triples(read(spark, sf, "customer"), "Customer", "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"], REL)


TR = """tr AS (SELECT 'Customer:' || c_custkey AS s, 'urn:millrace:c_name' AS p, c_name AS o FROM customer UNION ALL SELECT 'Customer:' || c_custkey, 'inNation', 'Nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'Customer:' || c_custkey, 'inSegment', 'Segment:' || c_mktsegment FROM customer UNION ALL SELECT 'Customer:' || c_custkey, 'rdf:type', 'Customer' FROM customer)"""


@query("rows_to_triples", f"WITH {TR} SELECT * FROM tr")
def _(spark, sf):
    return triples(spark, sf)


@query("reference_classes", "SELECT DISTINCT 'Nation' AS class, c_nationkey::VARCHAR AS value FROM customer UNION ALL SELECT DISTINCT 'Segment', c_mktsegment FROM customer")
def _(spark, sf):
    return o.reference_classes(read(spark, sf, "customer"), REL)


@query("triple_query", f"WITH {TR} SELECT s, p, o FROM tr WHERE s IN (SELECT 'Customer:' || o_custkey FROM orders WHERE o_totalprice > 300000) AND contains(p, 'inNation')")
def _(spark, sf):
    rich = read(spark, sf, "orders").where("o_totalprice > 300000").select(F.concat(F.lit("Customer:"), F.col("o_custkey").cast("string")).alias("s"))
    return o.triple_query(triples(spark, sf), rich, "inNation")


@query("triple_neighbors", f"WITH {TR} SELECT DISTINCT s, o FROM tr WHERE contains(o, ':')")
def _(spark, sf):
    return o.triple_neighbors(triples(spark, sf))


@query("triple_search", f"WITH {TR} SELECT s, p, o FROM tr WHERE contains(lower(s), 'mach') OR contains(lower(p), 'mach') OR contains(lower(o), 'mach') ORDER BY s, p, o LIMIT 25")
def _(spark, sf):
    return o.triple_search(triples(spark, sf), "MACH", 25)


@query("relation_nav", f"""WITH {TR}, f AS (SELECT p.page_id AS qid, 'Customer' AS entity, 'segment' AS label, s, min(o) AS value FROM pages p, tr WHERE contains(p.url, '/en/1') AND tr.p = 'inSegment' GROUP BY ALL)
 SELECT qid, entity, label, s, value FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY s) AS rn FROM f) WHERE rn <= 10""")
def _(spark, sf):
    asked = read(spark, sf, "pages").where(F.col("url").contains("/en/1")).select(F.col("page_id").alias("qid"), F.concat(F.lit("which segment for "), "url").alias("text"))
    relations = spark.createDataFrame([("Customer", "inSegment", "segment"), ("Customer", "inNation", "nation of")], "entity string, p string, label string")
    return o.relation_nav(triples(spark, sf), asked, relations)


@query("write_ntriples", f"""WITH {TR}, u AS (SELECT '<urn:millrace:' || regexp_replace(replace(s, ':', '_'), '[^0-9A-Za-z_一-龥]', '_', 'g') || '>' AS s, p, o FROM tr)
 SELECT s || ' ' || CASE WHEN p = 'rdf:type' THEN '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' WHEN starts_with(p, 'urn:millrace:') THEN '<' || p || '>' ELSE '<urn:millrace:' || p || '>' END || ' '
 || CASE WHEN p IN ('rdf:type', 'inNation', 'inSegment') AND NOT contains(o, ' ') THEN '<urn:millrace:' || replace(o, ':', '_') || '>' ELSE '"' || o || '"' END || ' .' AS value FROM u""")
def _(spark, sf):
    return o.ntriples(triples(spark, sf))


@query("build_model", """SELECT 'Supplier' AS object_type, s_suppkey::VARCHAR AS instance, [s_name, s_nationkey::VARCHAR, s_acctbal::VARCHAR] AS "values" FROM supplier""")
def _(spark, sf):
    made = o.build_model(read(spark, sf, "supplier"), "Supplier", ["s_name", "s_nationkey", "s_acctbal"], "s_suppkey", "s_suppkey")
    return made.select("object_type", "instance", F.map_values("properties").alias("values"))


@query("validate_constraints", """SELECT 'Sale' AS entity, 'unique' AS type, 'l_partkey' AS "column", l_partkey::VARCHAR AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem) WHERE rn > 1
 UNION ALL SELECT 'Sale', 'required', 'note', l_partkey::VARCHAR FROM lineitem WHERE l_returnflag = 'A'""")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "A", "  ").otherwise("x").alias("note"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return o.validate_constraints(rows, "Sale", "l_partkey", ["note"], "seq")


@query("agg_count", "SELECT count(*) AS value FROM customer")
def _(spark, sf):
    return o.agg_count(read(spark, sf, "customer"))


@query("agg_extreme", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def _(spark, sf):
    return o.agg_extreme(read(spark, sf, "customer"), "c_acctbal", "c_custkey")


@query("agg_enum", "SELECT DISTINCT c_mktsegment AS value FROM customer")
def _(spark, sf):
    return o.agg_enum(read(spark, sf, "customer"), "c_mktsegment")


@query("agg_list", "SELECT DISTINCT c_name AS value FROM customer")
def _(spark, sf):
    return o.agg_list(read(spark, sf, "customer"))


@query("answer_aggregate", "SELECT c_mktsegment, count(c_acctbal) AS n, round(sum(c_acctbal), 3) AS sum, round(avg(c_acctbal), 3) AS avg, round(min(c_acctbal), 3) AS min, round(max(c_acctbal), 3) AS max FROM customer GROUP BY 1")
def _(spark, sf):
    return o.answer_aggregate(read(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")


@query("filter_equals", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    return o.filter_equals(read(spark, sf, "customer"), "c_mktsegment", "BUILDING")


@query("answer_batch", """WITH q AS (SELECT page_id AS qid, page_id % 8 AS k FROM pages), c AS (SELECT *, c_custkey AS place FROM customer),
 a AS (SELECT 0 AS k, 'count' AS kind, NULL AS "column", count(*)::VARCHAR AS answer, NULL AS who FROM c
  UNION ALL SELECT 1, 'max', 'c_acctbal', round(max(c_acctbal), 3)::VARCHAR, max_by(c_custkey, (c_acctbal, -place)) FROM c
  UNION ALL SELECT 2, 'min', 'c_acctbal', round(min(c_acctbal), 3)::VARCHAR, min_by(c_custkey, (c_acctbal, place)) FROM c
  UNION ALL SELECT DISTINCT 3, 'enum', 'c_mktsegment', c_mktsegment, NULL FROM c
  UNION ALL SELECT DISTINCT 4, 'list', 'c_name', c_name, NULL FROM c
  UNION ALL SELECT 5, 'filter', 'c_mktsegment', count(*)::VARCHAR, NULL FROM c WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 6, 'filter', 'c_mktsegment', '0', NULL)
 SELECT qid, kind, "column", answer, who::BIGINT AS who FROM q JOIN a USING (k)""")
def _(spark, sf):
    said = ("有多少个客户", "余额最高的客户", "余额最低的客户", "板块有哪些", "有哪些客户", "板块为BUILDING的客户", "板块为NONE的客户", "天气如何")
    asked = read(spark, sf, "pages").select(F.col("page_id").alias("qid"), F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("page_id") % 8 + 1).cast("int")).alias("text"))
    found = o.answer_batch(asked, read(spark, sf, "customer"), {"余额": "c_acctbal", "板块": "c_mktsegment"}, "c_custkey")
    return found.withColumn("who", F.get_json_object("instance", "$.c_custkey").cast("long")).drop("instance")


NAMES = "SELECT DISTINCT unnest([event_type || '_id', event_type || '_count', 'device_' || event_type, event_type || '_type', event_type || 'Status', event_type]) AS name FROM events"


def _names(spark, sf):
    e = F.col("event_type")
    return read(spark, sf, "events").select(F.explode(F.array(*[F.concat(*x) for x in ((e, F.lit("_id")), (e, F.lit("_count")), (F.lit("device_"), e), (e, F.lit("_type")), (e, F.lit("Status")), (e,))])).alias("name")).distinct()


@query("semantic_role", f"""SELECT name, CASE WHEN ends_with(lower(name), '_id') THEN 'id' WHEN contains(lower(name), 'status') THEN 'status' WHEN contains(lower(name), 'type') THEN 'type' WHEN contains(lower(name), 'count') THEN 'numeric'
 WHEN contains(lower(name), 'c') THEN 'measure' ELSE 'attribute' END AS role FROM ({NAMES})""")
def _(spark, sf):
    return _names(spark, sf).select("name", typed.semantic_role(F.col("name")).alias("role"))


@query("local_name", f"SELECT name, string_split(name, '_')[-1] AS local, name AS safe FROM ({NAMES})")
def _(spark, sf):
    return _names(spark, sf).select("name", typed.local_name(F.col("name")).alias("local"), typed.safe_name(F.col("name")).alias("safe"))


@query("semantic_role_domain", f"""WITH n AS ({NAMES}), r AS (SELECT name, CASE WHEN ends_with(lower(name), '_id') OR contains(name, 'device') THEN 'reference' WHEN contains(name, 'count') THEN 'measure'
 WHEN contains(name, 'type') OR contains(lower(name), 'status') THEN 'category' ELSE 'text' END AS role FROM n),
 d AS (SELECT name, role, CASE role WHEN 'reference' THEN CASE WHEN contains(name, 'device') THEN '设备/传感器' ELSE '引用/外键' END WHEN 'measure' THEN '度量/指标' WHEN 'category' THEN '分类/枚举' ELSE '文本/描述' END AS domain FROM r)
 SELECT name, role, domain, CASE WHEN domain = '设备/传感器' THEN 'Device' END AS linked_entity FROM d""")
def _(spark, sf):
    return _names(spark, sf).withColumn("x", o.semantic_role_domain(F.col("name"))).select("name", "x.role", "x.domain", "x.linked_entity")


ITEMS = "it AS (SELECT l_orderkey AS rid, CASE WHEN l_returnflag = 'R' THEN '未通过' WHEN l_linestatus = 'F' THEN '通过' ELSE '待验收' END AS result FROM lineitem WHERE l_quantity > 20 UNION ALL SELECT -p_partkey, '待验收' FROM part WHERE p_size = 1)"


def _items(spark, sf):
    result = F.when(F.col("l_returnflag") == "R", v.FAILED).when(F.col("l_linestatus") == "F", v.PASSED).otherwise(v.PENDING)
    return read(spark, sf, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("rid"), result.alias("result")).unionByName(
        read(spark, sf, "part").where("p_size = 1").select((-F.col("p_partkey")).alias("rid"), F.lit(v.PENDING).alias("result")))


def _requirements(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


@query("reconcile", f"WITH {ITEMS} SELECT DISTINCT 'missing' AS kind, o_orderkey AS rid FROM orders WHERE o_orderkey NOT IN (SELECT rid FROM it) UNION ALL SELECT DISTINCT 'orphan', rid FROM it WHERE rid NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    return v.reconcile(_requirements(spark, sf), _items(spark, sf))


@query("reconcile_counts", f"WITH {ITEMS} SELECT count(*) AS items, count(*) FILTER (result = '通过') AS passed, count(*) FILTER (result = '未通过') AS failed, count(*) FILTER (result = '待验收') AS pending FROM it")
def _(spark, sf):
    return v.reconcile_counts(_items(spark, sf))


@query("set_missing", f"WITH {ITEMS} SELECT DISTINCT o_orderkey AS rid FROM orders WHERE o_orderkey NOT IN (SELECT rid FROM it)")
def _(spark, sf):
    return v.set_missing(_requirements(spark, sf).withColumnRenamed("id", "rid"), _items(spark, sf), "rid")


@query("set_orphan", f"WITH {ITEMS} SELECT DISTINCT rid FROM it WHERE rid NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    return v.set_missing(_items(spark, sf), _requirements(spark, sf).withColumnRenamed("id", "rid"), "rid")


@query("acceptance_status", f"WITH {ITEMS} SELECT rid, coalesce(bool_and(result = '通过'), false) AS accept, count(*) FILTER (result = '通过') AS passed_n, count(*) AS total FROM it GROUP BY 1")
def _(spark, sf):
    return v.acceptance_status(_items(spark, sf), ["rid"])


@query("hit_rate", f"WITH {ITEMS} SELECT rid % 10 AS grp, count(*) AS questions, count(*) FILTER (result = '通过') AS hits, round(count(*) FILTER (result = '通过') / count(*) * 100, 1) AS rate FROM it GROUP BY 1")
def _(spark, sf):
    return v.hit_rate(_items(spark, sf).select((F.col("rid") % 10).alias("grp"), (F.col("result") == v.PASSED).alias("hit")), ["grp"])


@query("build_acceptance", """WITH f AS (SELECT n_nationkey AS rid, n_name AS title, unnest(['check ' || n_name, 'accept region ' || n_regionkey]) AS clause, unnest([0, 1]) AS at_ FROM nation)
 SELECT printf('A-%03d', row_number() OVER (ORDER BY rid, at_)) AS aid, rid, title, clause, '待验收' AS result FROM f""")
def _(spark, sf):
    clauses = F.array(F.concat(F.lit("check "), "n_name"), F.concat(F.lit("accept region "), F.col("n_regionkey").cast("string")))
    return v.build_acceptance(read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), clauses.alias("acceptance")))


PROJECT = "SELECT c_mktsegment AS project, count(*) AS n, count(DISTINCT c_nationkey) AS req, round(avg((c_acctbal > 0)::INT::DOUBLE), 3) AS q FROM customer GROUP BY 1"


def _projects(spark, sf):
    return read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("c_nationkey").alias("requirements"), F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 3).alias("quality")).withColumn("complexity", F.lit("medium"))


@query("estimate_effort", f"""SELECT project, n AS rows, req AS requirements, 'medium' AS complexity, q AS quality, CASE WHEN q >= 0.9 THEN '优' WHEN q >= 0.75 THEN '良' WHEN q >= 0.6 THEN '中' ELSE '差' END AS quality_level, 2.0 AS base_days,
 round(n / 1000 * 0.5, 2) AS scale_days, round(2.0 * (1 - q) * 1.2, 2) AS quality_days, round(req * 0.8, 2) AS requirement_days, round((2.0 + n / 1000 * 0.5 + 2.0 * (1 - q) * 1.2 + req * 0.8) * 1.6, 1) AS total_days FROM ({PROJECT})""")
def _(spark, sf):
    return v.estimate_effort(_projects(spark, sf))


@query("build_quote", f"""WITH ef AS ({ORACLES['estimate_effort']}), ln AS (SELECT project, unnest(['base', 'data', 'quality', 'requirements']) AS item, unnest([base_days, scale_days, quality_days, requirement_days]) AS days FROM ef),
 pr AS (SELECT *, round(days * {v.UNIT_PRICE}, 2) AS amount FROM ln WHERE days > 0 OR item = 'base'), su AS (SELECT project, round(sum(amount), 2) AS subtotal FROM pr GROUP BY 1)
 SELECT project, item, days, amount, subtotal, round(subtotal * {v.TAX}, 2) AS tax, round(subtotal + round(subtotal * {v.TAX}, 2), 2) AS total FROM pr JOIN su USING (project)""")
def _(spark, sf):
    return v.build_quote(v.estimate_effort(_projects(spark, sf)))
