"""Operators on names, columns and stories, fed with names and values of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.operators import decisions as d
from millrace.operators import drafts as x
from millrace.operators import ontology as o
from millrace.operators import profile as p
from millrace.operators import survey as v
from millrace.plans.ontology_queries import NAMES, _names
from millrace.plans.profile_queries import COLUMNS, FIRST, TYPE, L, cells
from millrace.plans.tables import read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


KNOWN = f"MAP({_texts(typed.FIELD_NAMES)}, {_texts(typed.FIELD_NAMES.values())})"


@query("field_cn", f"""WITH n AS (SELECT name, string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\s]+', ' ', 'g'), ' ') AS w FROM ({NAMES} UNION SELECT 'area_note')),
 j AS (SELECT name, array_to_string(list_transform(w, lambda x: coalesce({KNOWN}[lower(x)], '')), '') AS cn FROM n) SELECT name, CASE WHEN cn = '' THEN name ELSE cn END AS cn FROM j""")
def _(spark, sf):
    return _names(spark, sf).union(spark.sql("SELECT 'area_note'")).select("name", typed.field_cn(F.col("name")).alias("cn"))


MEASURED = " ".join(f"WHEN contains(lower(name), '{w}') THEN '{m}'" for w, m in p.MEASURES)


@query("field_measure", f"SELECT name, CASE {MEASURED} ELSE '数量(个)' END AS measure FROM ({NAMES})")
def _(spark, sf):
    return _names(spark, sf).select("name", p.field_measure(F.col("name"), F.lit("integer")).alias("measure"))


@query("prop_role", f"SELECT name, CASE WHEN ends_with(lower(name), '_id') THEN 'identifier' WHEN contains(name, 'count') THEN 'measure' WHEN contains(lower(name), 'type') OR contains(lower(name), 'status') THEN 'category' ELSE 'text' END AS role FROM ({NAMES})")
def _(spark, sf):
    kind = F.when(F.col("name").contains("count"), "integer").otherwise("string")
    return _names(spark, sf).select("name", o.prop_role(F.col("name"), kind).alias("role"))


@query("semantic_name_check", f"""WITH n AS (SELECT name || suffix AS field FROM ({NAMES}), (VALUES (''), ('_price_level')) AS s(suffix)), r AS (SELECT field, CASE WHEN ends_with(lower(field), '_id') OR contains(field, 'device') THEN 'reference'
 WHEN contains(field, 'count') OR contains(field, 'price') THEN 'measure' WHEN contains(field, 'type') OR contains(lower(field), 'status') THEN 'category' ELSE 'text' END AS role FROM n)
 SELECT field, role, NOT (role = 'measure' AND (contains(field, 'level') OR contains(field, 'type') OR contains(lower(field), 'status'))) AS ok FROM r""")
def _(spark, sf):
    fields = _names(spark, sf).select(F.explode(F.array(F.col("name"), F.concat("name", F.lit("_price_level")))).alias("field"))
    return o.semantic_name_check(fields)


@query("semantic_bridge", f"SELECT substr(name, 1, 1) AS block, count(*) AS fields, list_sort(list_distinct(list(CASE WHEN contains(name, 'device') THEN 'Device' END))) AS entities FROM ({NAMES}) GROUP BY 1")
def _(spark, sf):
    return o.semantic_bridge(_names(spark, sf).groupBy(F.substring("name", 1, 1).alias("block")).agg(F.collect_list("name").alias("fields")))


@query("type_hierarchy", """SELECT 'Enterprise' AS name, NULL AS super, []::VARCHAR[] AS children UNION ALL SELECT 'BusinessObject', 'Enterprise', [] UNION ALL
 SELECT r_name, 'BusinessObject', list(n_name ORDER BY n_name) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(spark, sf):
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.type_hierarchy(nations.select(F.col("n_name").alias("entity"), F.col("r_name").alias("domain")))


@query("entity_summary", "SELECT c_mktsegment AS entity, c_mktsegment || ' | instances: ' || count(*) || ' | columns: c_name, c_acctbal | relations: in_nation' AS summary FROM customer GROUP BY 1")
def _(spark, sf):
    counts = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("entity")).agg(F.count(F.lit(1)).alias("instances"))
    return o.entity_summary(counts.withColumns({"columns": F.array(F.lit("c_name"), F.lit("c_acctbal")), "relations": F.array(F.lit("in_nation"))}))


@query("infer_fk", """WITH e AS (SELECT DISTINCT event_type AS t FROM events), m AS (SELECT a.t || '_id' AS "column", b.t AS target, length(b.t) AS rank FROM e a JOIN e b ON contains(b.t, a.t) OR contains(a.t, b.t))
 SELECT 'log' AS "table", 'Log' AS entity, "column", min_by(target, rank) AS target FROM m GROUP BY 3""")
def _(spark, sf):
    e = read(spark, sf, "events").select("event_type").distinct()
    entities = e.select(F.col("event_type").alias("entity"), F.length("event_type").alias("rank"))
    columns = e.alias("a").select(F.lit("log").alias("table"), F.lit("Log").alias("entity"), F.concat("event_type", F.lit("_id")).alias("column"))
    return o.infer_fk(columns, entities, columns.limit(0).select("table", "column"))


@query("enum_en_suggest", "SELECT DISTINCT c_mktsegment AS value, c_mktsegment AS en, false AS needs_translation FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_mktsegment").alias("value")).distinct().withColumn("x", x.enum_en_suggest(F.col("value"))).select("value", "x.en", "x.needs_translation")


def _advice(mode: str, at: int) -> str:
    """The SQL of one field of the first entry whose name holds the mode or is held in it."""
    said = lambda e: str(e[at]) if at == 3 else _texts(e[at])
    cases = " ".join(f"WHEN contains({mode}, '{e[0]}') OR contains('{e[0]}', {mode}) THEN {said(e)}" for e in x.ADVICE)
    return f"CASE {cases} ELSE {said((None, *x.GENERAL))} END"


@query("fault_advice", f"""WITH m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '主轴轴承磨损严重' WHEN value > 90 THEN '温度过高' ELSE event_type END AS mode FROM events)
 SELECT event_id, {_advice('mode', 1)} AS actions, {_advice('mode', 2)} AS parts, {_advice('mode', 3)} AS estimated_cost FROM m""")
def _(spark, sf):
    mode = F.when(F.col("event_type") == "error", "主轴轴承磨损严重").when(F.col("value") > 90, "温度过高").otherwise(F.col("event_type"))
    return read(spark, sf, "events").select("event_id", x.fault_advice(mode).alias("a")).select("event_id", "a.*")


DICTIONARY = f"""{L}, {FIRST}, en AS (SELECT col, list(DISTINCT cell ORDER BY cell) AS en FROM l GROUP BY 1),
 dict AS (SELECT f.col, CASE f.col WHEN 'p_name' THEN '名称' ELSE f.col END AS cn, {TYPE.format(x='first')} AS type, CASE WHEN uniq <= 20 AND uniq < total THEN en ELSE [] END AS enum FROM f JOIN en USING (col))"""


@query("draft_questions", f"""WITH {DICTIONARY}, qs AS (SELECT '' AS col, '有多少个零件' AS question UNION ALL SELECT col, cn || unnest(['最大的零件', '最小的零件']) FROM dict WHERE type IN ('integer', 'float')
  UNION ALL SELECT col, cn || '有哪些' FROM dict WHERE type NOT IN ('integer', 'float') AND len(enum) BETWEEN 2 AND 8
  UNION ALL SELECT col, '有哪些零件' FROM dict WHERE type NOT IN ('integer', 'float') AND NOT len(enum) BETWEEN 2 AND 8 AND contains(col, 'name'))
 SELECT n, question FROM (SELECT row_number() OVER (ORDER BY col, question) AS n, question FROM qs) WHERE n <= 12""")
def _(spark, sf):
    return x.draft_questions(p.profile_dictionary(cells(spark, sf), COLUMNS, "id"), "零件")


@query("draft_lexicon", f"""WITH {DICTIONARY}, k AS (SELECT *, CASE WHEN type = 'text' AND len(enum) BETWEEN 2 AND 8 THEN enum END AS kinds FROM dict)
 SELECT col AS "column", cn, type, kinds AS enum, CASE WHEN kinds IS NOT NULL THEN '枚举值: ' || array_to_string(kinds[1:6], '、') WHEN type IN ('integer', 'float') THEN '数值列: ' || cn ELSE '文本列' END AS suggest FROM k""")
def _(spark, sf):
    return x.draft_lexicon(p.profile_dictionary(cells(spark, sf), COLUMNS, "id"))


@query("factory_lexicon", f"""WITH {DICTIONARY}, k AS (SELECT *, len(enum) BETWEEN 2 AND 8 AND type = 'text' AND NOT contains(col, 'name') AS kinds FROM dict),
 v AS (SELECT col, cn, unnest(enum) AS value FROM k WHERE kinds)
 SELECT 'attr_cn2en' AS section, cn AS key, string_split(col, '_')[-1] AS value FROM k WHERE NOT kinds UNION ALL SELECT 'attr_en2cn', string_split(col, '_')[-1], cn FROM k WHERE NOT kinds
  UNION ALL SELECT 'numeric_fields', cn, string_split(col, '_')[-1] FROM k WHERE NOT kinds AND type IN ('integer', 'float') UNION ALL SELECT 'value_fields', string_split(col, '_')[-1], cn FROM k WHERE kinds
  UNION ALL SELECT 'type_cn2en', value, value FROM v UNION ALL SELECT 'value_en_suggest', value, value FROM v UNION ALL SELECT 'entity_cn2en', '零件', 'part'""")
def _(spark, sf):
    return x.factory_lexicon(x.draft_lexicon(p.profile_dictionary(cells(spark, sf), COLUMNS, "id")), "part", "零件")


@query("review_items", f"""WITH {DICTIONARY}, k AS (SELECT *, len(enum) BETWEEN 2 AND 8 AND type = 'text' AND NOT contains(col, 'name') AS kinds FROM dict)
 SELECT 'type_enum' AS item_type, unnest(enum) AS key, cn AS value FROM k WHERE kinds UNION ALL SELECT 'attr_mapping', cn, string_split(col, '_')[-1] FROM k WHERE NOT kinds""")
def _(spark, sf):
    return x.review_items(x.draft_lexicon(p.profile_dictionary(cells(spark, sf), COLUMNS, "id")))


@query("evolution_recent", "SELECT o_orderkey, o_orderstatus = 'F' AS loop_closed FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def _(spark, sf):
    return d.evolution_recent(read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("loop_closed")), "o_orderkey")


@query("structure_requirement", """SELECT p_partkey AS id, substr('降低' || p_name, 1, 24) AS title, '降低' || p_name AS story, CASE WHEN p_size > 45 THEN '外星' ELSE '质量' END AS category, 'P' || (p_size % 5) AS priority,
 ['验证降低可按预期观测'] AS acceptance, p_size <= 45 AND p_size % 5 < 4 AS valid FROM part""")
def _(spark, sf):
    stories = read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit(" 降低"), "p_name").alias("story"), F.when(F.col("p_size") > 45, "外星").otherwise("质量").alias("category"),
        F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")).alias("priority"), F.lit(None).cast("array<string>").alias("acceptance"), F.lit(None).cast("string").alias("title"))
    return v.structure_requirement(stories)


@query("transfer_checklist", "SELECT p_partkey AS rid, p_name AS title, false AS trained, false AS handed_over, '' AS owner FROM part")
def _(spark, sf):
    return v.transfer_checklist(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


@query("evolution_counts", "SELECT count(*) AS loops, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders")
def _(spark, sf):
    return d.evolution_counts(read(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("loop_closed")))


@query("apply_industry", "SELECT b.module, b.key, coalesce(i.value, b.value) AS value FROM (SELECT r_name AS module, n_name AS key, n_nationkey::DOUBLE AS value FROM nation JOIN region ON n_regionkey = r_regionkey) b LEFT JOIN (SELECT r_name AS module, n_name AS key, avg(s_acctbal) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 GROUP BY ALL) i USING (module, key)")
def _(spark, sf):
    places = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = places.select(F.col("r_name").alias("module"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("double").alias("value"))
    means = read(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name", "n_nationkey").agg(F.avg("s_acctbal").alias("value"))
    industries = means.select(F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("industry"), F.col("r_name").alias("module"), F.col("n_name").alias("key"), "value")
    return d.apply_industry(base, industries, "even")
