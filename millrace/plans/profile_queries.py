"""Profiling and cleaning, over the part table as text cells with blanks, junk and repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.operators import clean as c
from millrace.operators import profile as p
from millrace.plans.tables import read

QUERIES, ORACLES = {}, {}
COLUMNS = ["p_name", "p_brand", "p_size", "p_retailprice"]
NUMERIC = ["p_size", "p_retailprice"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def cells(spark, sf):
    """Row order `id`; every 29th part comes twice."""
    part = read(spark, sf, "part").select(
        (F.col("p_partkey") * 2).alias("id"), "p_name",
        F.when(F.col("p_partkey") % 19 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit("")).when(F.col("p_partkey") % 31 == 0, F.lit("9000")).otherwise(F.col("p_size").cast("string")).alias("p_size"),
        F.when(F.col("p_partkey") % 23 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", F.col("p_retailprice"))).alias("p_retailprice"))
    return part.union(part.where("id % 58 = 0").withColumn("id", F.col("id") + 1))


C = """pt AS (SELECT p_partkey * 2 AS id, p_name, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE p_brand END AS p_brand,
 CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN '9000' ELSE p_size::VARCHAR END AS p_size,
 CASE WHEN p_partkey % 23 = 0 THEN 'n/a' ELSE printf('%.2f', p_retailprice) END AS p_retailprice FROM part),
 t AS (SELECT * FROM pt UNION ALL SELECT id + 1, p_name, p_brand, p_size, p_retailprice FROM pt WHERE id % 58 = 0)"""
TYPE = "CASE WHEN trim({x}) = '' THEN 'missing' WHEN regexp_full_match(trim({x}), '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(trim({x}), '-?[0-9]+\\.[0-9]+') THEN 'float' WHEN regexp_full_match(trim({x}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date' ELSE 'text' END"
L = C + ", l AS (SELECT id, col, trim(raw) AS cell, raw FROM t UNPIVOT (raw FOR col IN (p_name, p_brand, p_size, p_retailprice)))"
NUM = "TRY_CAST(CASE WHEN regexp_full_match(raw, '\\s*[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?\\s*') THEN raw END AS DOUBLE)"
DESC = """count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 3) AS mean, round(round(quantile_cont(v, 0.5), 9), 3) AS median,
 round(stddev_pop(v), 3) AS std, round(round(quantile_cont(v, 0.25), 9), 3) AS p25, round(round(quantile_cont(v, 0.75), 9), 3) AS p75"""
FIRST = f"""f AS (SELECT col, min_by(cell, id) FILTER (cell <> '') AS first, count(*) AS total, count(*) FILTER (cell <> '') AS non_empty, count(*) FILTER (cell = '') AS missing,
 count(DISTINCT cell) AS uniq FROM l GROUP BY 1)"""


@query("is_num", f"WITH {L} SELECT id, col AS \"column\", {NUM} IS NOT NULL AS is_num FROM l")
def _(spark, sf):
    return p.long_cells(cells(spark, sf), COLUMNS, "id").select(F.col("row").alias("id"), "column", typed.is_num(F.col("raw")).alias("is_num"))


@query("guess_type", f"WITH {L} SELECT id, col AS \"column\", {TYPE.format(x='raw')} AS type FROM l")
def _(spark, sf):
    return p.long_cells(cells(spark, sf), COLUMNS, "id").select(F.col("row").alias("id"), "column", typed.guess_type(F.col("raw")).alias("type"))


@query("profile_schema", f"""WITH {L}, {FIRST}, s AS (SELECT col, list(cell ORDER BY id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY id) AS rn FROM l WHERE cell <> '') WHERE rn <= 5 GROUP BY 1)
 SELECT f.col AS "column", CASE WHEN non_empty = 0 THEN 'empty' ELSE {TYPE.format(x='first')} END AS type, non_empty, missing, uniq AS "unique", sample FROM f JOIN s USING (col)""")
def _(spark, sf):
    return p.profile_schema(cells(spark, sf), COLUMNS, "id")


@query("profile_dictionary", f"""WITH {L}, {FIRST}, en AS (SELECT col, list(DISTINCT cell ORDER BY cell) AS en FROM l GROUP BY 1)
 SELECT f.col AS "column", CASE f.col WHEN 'p_name' THEN '名称' ELSE f.col END AS cn, CASE {TYPE.format(x='first')} WHEN 'integer' THEN '数量(个)' WHEN 'float' THEN '数值' ELSE '文本' END AS measure,
 {TYPE.format(x='first')} AS type, non_empty, uniq AS "unique", CASE WHEN uniq <= 20 AND uniq < total THEN en ELSE [] END AS enum FROM f JOIN en USING (col)""")
def _(spark, sf):
    return p.profile_dictionary(cells(spark, sf), COLUMNS, "id")


DRIFT = f"""ty AS (SELECT col, {TYPE.format(x='cell')} AS type, id FROM l WHERE cell <> ''), t0 AS (SELECT col, min_by(type, id) AS type0 FROM ty GROUP BY 1),
 drift AS (SELECT col, type0 AS type, count(*) AS n FROM ty JOIN t0 USING (col) WHERE type <> type0 AND type0 IN ('integer', 'float') GROUP BY ALL)"""
OUT = f"""nu AS (SELECT col, {NUM} AS v FROM l WHERE {NUM} IS NOT NULL), fe AS (SELECT col, round(round(quantile_cont(v, 0.25), 9), 3) AS q1, round(round(quantile_cont(v, 0.75), 9), 3) AS q3 FROM nu GROUP BY 1 HAVING count(*) >= 4),
 ou AS (SELECT col, count(*) AS n FROM nu JOIN fe USING (col) WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1)"""
DUP = "du AS (SELECT sum(n - 1)::BIGINT AS dup, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM t GROUP BY p_name, p_brand, p_size, p_retailprice))"


@query("type_drift", f"WITH {L}, {DRIFT} SELECT col AS \"column\", type, n AS count FROM drift")
def _(spark, sf):
    return p.type_drift(cells(spark, sf), COLUMNS, "id")


@query("profile_quality", f"""WITH {L}, {DRIFT}, {OUT}, {DUP}
 SELECT 'missing' AS issue, col AS "column", count(*) FILTER (cell = '') AS count, round(count(*) FILTER (cell = '') / count(*), 3) AS rate FROM l GROUP BY col HAVING count(*) FILTER (cell = '') > 0
 UNION ALL SELECT 'duplicate', NULL, dup, round(dup / n, 3) FROM du WHERE dup > 0 UNION ALL SELECT 'type_drift', col, n, NULL FROM drift UNION ALL SELECT 'outlier', NULL, sum(n)::BIGINT, NULL FROM ou HAVING sum(n) > 0""")
def _(spark, sf):
    return p.profile_quality(cells(spark, sf), COLUMNS, "id")


@query("profile_quality_giant", ORACLES["profile_quality"])
def _(spark, sf):
    """The fences by selection, of which the given tables take several rounds."""
    return p.profile_quality(cells(spark, sf), COLUMNS, "id", giant=True, keep=100)


@query("profile_col_stats", f"WITH {L}, {OUT} SELECT col AS \"column\", {DESC} FROM nu GROUP BY 1")
def _(spark, sf):
    return p.profile_col_stats(cells(spark, sf), COLUMNS, "id")


@query("quality_score", f"""WITH {L}, {OUT}, {DUP}, z AS (SELECT (SELECT count(*) FROM t) AS n_rows, (SELECT count(*) FROM l WHERE cell = '') AS miss, (SELECT dup FROM du) AS dup, coalesce((SELECT sum(n) FROM ou), 0) AS outl),
 sc AS (SELECT n_rows, round(0.5 * (1 - miss / (n_rows * 4)) + 0.3 * (1 - dup / n_rows) + 0.2 * (1 - least(outl, n_rows) / n_rows), 3) AS score FROM z)
 SELECT n_rows AS rows, score, CASE WHEN score >= 0.9 THEN '优' WHEN score >= 0.75 THEN '良' WHEN score >= 0.6 THEN '中' ELSE '差' END AS grade FROM sc""")
def _(spark, sf):
    return p.quality_score(cells(spark, sf), COLUMNS, "id")


@query("detect_numeric_col", f"WITH {L} SELECT min_by(col, (id * 10 + CASE col WHEN 'p_size' THEN 2 WHEN 'p_retailprice' THEN 3 ELSE 1 END)) AS \"column\" FROM l WHERE {NUM} IS NOT NULL")
def _(spark, sf):
    return p.detect_numeric_col(cells(spark, sf), COLUMNS, "id")


@query("profile_report", f"""WITH a AS ({ORACLES['profile_schema']}), b AS ({ORACLES['profile_dictionary']}), c AS ({ORACLES['profile_quality']}), d AS ({ORACLES['profile_col_stats']}),
 i AS (SELECT "column", list(issue ORDER BY issue) AS issues FROM c WHERE "column" IS NOT NULL GROUP BY 1)
 SELECT a.*, b.cn, b.measure, b.enum, coalesce(issues, []) AS issues, d.* EXCLUDE ("column") FROM a JOIN b USING ("column") LEFT JOIN i USING ("column") LEFT JOIN d USING ("column")""")
def _(spark, sf):
    return p.profile_report(cells(spark, sf), COLUMNS, "id")


U = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size, p_retailprice ORDER BY id) AS rn FROM t) WHERE rn = 1)"
WHOLE = "trim(p_name) <> '' AND trim(p_brand) <> '' AND trim(p_size) <> '' AND trim(p_retailprice) <> ''"
SIZE, PRICE = (NUM.replace("raw", x) for x in NUMERIC)
COLS = "id, p_name, p_brand, p_size, p_retailprice"


def _fences(source: str) -> str:
    q = "round(round(quantile_cont({x}, {q}), 9), 3)"
    return f"""fc AS (SELECT {q.format(x=SIZE, q=0.25)} AS s1, {q.format(x=SIZE, q=0.75)} AS s3, {q.format(x=PRICE, q=0.25)} AS r1, {q.format(x=PRICE, q=0.75)} AS r3 FROM {source}),
 kept AS (SELECT {COLS} FROM {source}, fc WHERE NOT (coalesce(NOT {SIZE} BETWEEN s1 - 1.5 * (s3 - s1) AND s3 + 1.5 * (s3 - s1), false) AND s3 <> s1) AND NOT (coalesce(NOT {PRICE} BETWEEN r1 - 1.5 * (r3 - r1) AND r3 + 1.5 * (r3 - r1), false) AND r3 <> r1))"""


@query("dedup_rows", f"WITH {C}, {U} SELECT {COLS} FROM u")
def _(spark, sf):
    return c.dedup_rows(cells(spark, sf), COLUMNS, "id")


@query("fill_drop", f"WITH {C} SELECT {COLS} FROM t WHERE {WHOLE}")
def _(spark, sf):
    return c.fill_drop(cells(spark, sf), COLUMNS)


@query("fill_zero", f"WITH {C} SELECT id, CASE WHEN trim(p_name) = '' THEN '0' ELSE p_name END AS p_name, CASE WHEN trim(p_brand) = '' THEN '0' ELSE p_brand END AS p_brand, CASE WHEN trim(p_size) = '' THEN '0' ELSE p_size END AS p_size, CASE WHEN trim(p_retailprice) = '' THEN '0' ELSE p_retailprice END AS p_retailprice FROM t")
def _(spark, sf):
    return c.fill_zero(cells(spark, sf), COLUMNS)


@query("fill_mean", f"WITH {C}, m AS (SELECT round(avg({SIZE}), 3) AS a FROM t) SELECT id, p_name, p_brand, TRY_CAST(CASE WHEN trim(p_size) = '' THEN a::VARCHAR ELSE p_size END AS DOUBLE) AS p_size, p_retailprice FROM t, m")
def _(spark, sf):
    return c.fill_mean(cells(spark, sf), NUMERIC).withColumn("p_size", F.col("p_size").try_cast("double"))


@query("outlier_iqr", f"WITH {C}, {_fences('t')} SELECT * FROM kept")
def _(spark, sf):
    return c.outlier_iqr(cells(spark, sf), NUMERIC)


@query("outlier_zscore", f"""WITH {C}, a AS (SELECT avg({SIZE}) AS m, stddev_pop({SIZE}) AS s FROM t), b AS (SELECT {COLS} FROM t, a WHERE NOT coalesce(abs({SIZE} - m) > 3 * s, false)),
 d AS (SELECT avg({PRICE}) AS m, stddev_pop({PRICE}) AS s FROM b) SELECT {COLS} FROM b, d WHERE NOT coalesce(abs({PRICE} - m) > 3 * s, false)""")
def _(spark, sf):
    return c.outlier_zscore(cells(spark, sf), NUMERIC)


@query("clean", f"WITH {C}, {U}, w AS (SELECT {COLS} FROM u WHERE {WHOLE}), {_fences('w')} SELECT * FROM kept")
def _(spark, sf):
    return c.clean(cells(spark, sf), COLUMNS, "id", NUMERIC)


@query("clean_report", f"""WITH {C}, {U}, w AS (SELECT {COLS} FROM u WHERE {WHOLE}), {_fences('w')}, n AS (SELECT (SELECT count(*) FROM t) AS a, (SELECT count(*) FROM u) AS b, (SELECT count(*) FROM w) AS c, (SELECT count(*) FROM kept) AS d)
 SELECT a AS rows_in, a - b AS dropped_dup, b - c AS dropped_missing, c - d AS dropped_outlier, d AS rows_out FROM n""")
def _(spark, sf):
    return c.clean_report(cells(spark, sf), COLUMNS, "id", NUMERIC)
