"""Retrieval over part descriptions, and text checks over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import retrieval as r
from millrace.operators import textqa as q
from millrace.operators.monitor import TIE
from millrace.plans.tables import read

QUERIES, ORACLES = {}, {}
K = 5


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def parts(spark, sf):
    """Texts: name, brand and type of each part."""
    return read(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


def asked(spark, sf):
    """Queries: the texts of all parts whose id is divisible by 50."""
    return parts(spark, sf).where("doc % 50 = 0").select(F.col("doc").alias("qid"), "text")


def documents(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


D = "d AS (SELECT p_partkey AS doc, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part)"
Q = "q AS (SELECT p_partkey AS qid, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part WHERE p_partkey % 50 = 0)"
TOKENS = "regexp_extract_all(lower(coalesce({x}, '')), '[a-zA-Z0-9_]+|[一-龥]')"
BIGRAMS = "list_distinct(list_transform(range(1, length({x})), lambda i: {x}[i:i + 1]))"
LEX = f"""{D}, {Q}, dx AS (SELECT doc, {BIGRAMS.format(x='text')} AS b, list_distinct({TOKENS.format(x='text')}) AS t FROM d), qx AS (SELECT qid, {BIGRAMS.format(x='text')} AS b, list_distinct({TOKENS.format(x='text')}) AS t FROM q),
 pr AS (SELECT qid, doc, len(list_intersect(qx.b, dx.b)) AS nb, len(list_intersect(qx.t, dx.t)) AS nt, len(qx.b) AS qb, len(dx.b) AS db, len(qx.t) AS qn, len(dx.t) AS dn FROM qx, dx),
 lex AS (SELECT qid, doc, round(0.7 * nb / db + 0.3 * nt / (qn + dn - nt), 4) AS score FROM pr WHERE nb > 0 OR nt > 0)"""
HEX = "(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1)"


def _embed(name: str, key: str) -> str:
    squeezed = "regexp_replace(lower(text), '\\s+', '', 'g')"
    grams = " UNION ".join(f"SELECT {key}, substr(s, i, {n}) AS term, 1.0 AS w FROM (SELECT {key}, {squeezed} AS s, unnest(range(1, greatest(length({squeezed}) - {n} + 1, 1) + 1)) AS i FROM {name})" for n in (1, 2, 3))
    h0, h7 = "sha256('0:' || term)", "sha256('7:' || term)"
    idx = f"(({HEX.format(h=h0, i=14)} * 256 + {HEX.format(h=h0, i=15)} * 16 + {HEX.format(h=h0, i=16)}) % 512)"
    return f"""{name}t AS ({grams} UNION ALL SELECT DISTINCT {key}, 'w:' || unnest({TOKENS.format(x='text')}), 1.5 FROM {name}),
 {name}s AS (SELECT {key}, {idx} AS idx, sum(CASE WHEN {HEX.format(h=h7, i=16)} % 2 = 0 THEN w ELSE -w END)::DOUBLE AS v FROM {name}t GROUP BY ALL HAVING sum(CASE WHEN {HEX.format(h=h7, i=16)} % 2 = 0 THEN w ELSE -w END) <> 0),
 {name}e AS (SELECT {key}, idx, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS w FROM {name}s)"""


VEC = f"{D}, {Q}, {_embed('d', 'doc')}, {_embed('q', 'qid')}, vec AS (SELECT qid, doc, round(sum(qe.w * de.w), 4) AS score FROM qe JOIN de USING (idx) GROUP BY 1, 2)"
TOP = "SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM {t}) WHERE rank <= 5"


@query("tokenize", f"SELECT conv_id, turn, {TOKENS.format(x='text')} AS tokens FROM conversations")
def _(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", r.tokenize(F.col("text")).alias("tokens"))


@query("char_ngrams", f"WITH {D}, s AS (SELECT doc, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM d) SELECT doc, list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3)) AS grams FROM s")
def _(spark, sf):
    return parts(spark, sf).select("doc", r.char_ngrams(F.col("text"), 3).alias("grams"))


PAIR = "pp AS (SELECT p_partkey, p_name AS a, p_name || ' ' || p_type AS b FROM part)"


@query("bigram_overlap", f"WITH {PAIR}, t AS (SELECT p_partkey, {BIGRAMS.format(x='a')} AS u, {BIGRAMS.format(x='b')} AS v FROM pp) SELECT p_partkey, round(len(list_intersect(u, v)) / len(v), 6) AS score FROM t")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(r.overlap(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")), 6).alias("score"))


@query("token_jaccard", f"WITH {PAIR}, t AS (SELECT p_partkey, list_distinct({TOKENS.format(x='a')}) AS x, list_distinct({TOKENS.format(x='b')}) AS y FROM pp) SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS score FROM t")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(r.token_jaccard(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")), 6).alias("score"))


@query("semantic_score", f"""WITH {PAIR}, t AS (SELECT p_partkey, list_distinct({TOKENS.format(x='a')}) AS x, list_distinct({TOKENS.format(x='b')}) AS y, {BIGRAMS.format(x='a')} AS u, {BIGRAMS.format(x='b')} AS v FROM pp)
 SELECT p_partkey, round(0.7 * len(list_intersect(u, v)) / len(v) + 0.3 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS score FROM t""")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", r.semantic_score(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")).alias("score"))


@query("cosine", """WITH c AS (SELECT label, list(embedding ORDER BY vec_id)[1] AS center FROM embeddings GROUP BY 1)
 SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, center), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(center, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS score FROM embeddings JOIN c USING (label)""")
def _(spark, sf):
    e = read(spark, sf, "embeddings")
    center = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center"))
    return e.join(center, "label").select("vec_id", F.round(r.cosine(F.col("embedding"), F.col("center")), 5).alias("score"))


@query("is_noise", """WITH s AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
 SELECT conv_id, turn, length(t) < 6 OR lower(t) IN ('hello', 'hi', 'test') OR (length(t) < 12 AND contains(lower(t), 'placeholder')) AS noise FROM s""")
def _(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", r.is_noise(F.col("text")).alias("noise"))


@query("hash_embed", f"WITH {D}, {_embed('d', 'doc')} SELECT doc AS key, idx, round(w, 9) AS w FROM de")
def _(spark, sf):
    return r.hash_embed(parts(spark, sf), "doc", "text").withColumn("w", F.round("w", 9))


@query("vector_rank", f"WITH {VEC} {TOP.format(t='vec')}")
def _(spark, sf):
    return r.ranked(asked(spark, sf), parts(spark, sf), K)


@query("lexical_rank", f"WITH {LEX} {TOP.format(t='lex')}")
def _(spark, sf):
    return r.ranked(asked(spark, sf), parts(spark, sf), K, "lexical")


@query("hybrid_rank", f"WITH {VEC}, {LEX.replace(D + ', ' + Q + ', ', '')}, hy AS (SELECT qid, doc, round(0.7 * coalesce(vec.score, 0) + 0.3 * coalesce(lex.score, 0) + 1e-9, 4) AS score FROM vec FULL JOIN lex USING (qid, doc)) {TOP.format(t='hy')}")
def _(spark, sf):
    return r.ranked(asked(spark, sf), parts(spark, sf), K, "hybrid")


@query("topk_rank", "SELECT qid, doc, score, rank FROM (SELECT l_suppkey AS qid, l_orderkey * 10 + l_linenumber AS doc, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 5")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("qid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), F.col("l_extendedprice").alias("score"))
    return r.topk_rank(rows, K)


@query("facts_search", f"WITH {LEX}, fs AS (SELECT qid, doc, round(nb / qb, 6) AS score FROM pr WHERE nb > 0) {TOP.format(t='fs')}")
def _(spark, sf):
    return r.facts_search(asked(spark, sf), parts(spark, sf), K)


# Candidates one after the other: `rec` walks them in order and keeps the list of those added so far.
DECIDE = f"""{LEX.replace('FROM part)', 'FROM part WHERE p_size > 25)', 1)}, sc AS (SELECT qid, doc, round(nb / db, 6) AS score FROM pr WHERE nb > 0 AND round(nb / db, 6) >= 0.3),
 b AS (SELECT qid, max(score) AS best, max_by(doc, (score, -doc)) AS fact FROM sc GROUP BY 1),
 cc AS (SELECT x.qid AS qid, y.qid AS doc, round(len(list_intersect(x.b, y.b)) / len(y.b), 6) AS score FROM qx x JOIN qx y ON y.qid < x.qid),
 al AS (SELECT qid, list(doc) FILTER (score >= 0.6) AS alike FROM cc GROUP BY 1),
 n AS (SELECT q.qid, row_number() OVER (ORDER BY q.qid) AS i, coalesce(b.best, 0) AS best, coalesce(alike, []) AS alike FROM q LEFT JOIN b USING (qid) LEFT JOIN al USING (qid)),
 rec AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS added UNION ALL SELECT n.i, CASE WHEN n.best >= 0.6 OR len(list_intersect(n.alike, rec.added)) > 0 THEN rec.added ELSE list_append(rec.added, n.qid) END FROM rec JOIN n ON n.i = rec.i + 1),
 ad AS (SELECT unnest(added) AS doc FROM (SELECT added FROM rec ORDER BY i DESC LIMIT 1)),
 nw AS (SELECT qid, max(score) AS best, max_by(doc, (score, -doc)) AS fact FROM cc JOIN ad USING (doc) WHERE score >= 0.3 GROUP BY 1),
 bt AS (SELECT q.qid, CASE WHEN nw.best > coalesce(b.best, 0) THEN nw.best ELSE b.best END AS best, CASE WHEN nw.best > coalesce(b.best, 0) THEN nw.fact ELSE b.fact END AS fact,
  CASE WHEN nw.best > coalesce(b.best, 0) THEN true WHEN b.best IS NOT NULL THEN false END AS fact_new FROM q LEFT JOIN b USING (qid) LEFT JOIN nw USING (qid)),
 wd AS (SELECT qid, best, fact, fact_new, CASE WHEN fact_new THEN q2.text ELSE d.text END AS fact_text, CASE WHEN best >= 0.9 THEN 'SKIP' WHEN best >= 0.6 THEN 'UPDATE' ELSE 'ADD' END AS action
  FROM bt LEFT JOIN d ON d.doc = bt.fact AND NOT fact_new LEFT JOIN (SELECT qid AS other, text FROM q) q2 ON q2.other = bt.fact AND fact_new)"""


@query("write_decision", f"WITH RECURSIVE {DECIDE} SELECT * FROM wd")
def _(spark, sf):
    facts = read(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return r.write_decision(asked(spark, sf), facts)


@query("facts_dedup_hash", "SELECT DISTINCT substr(sha256(text), 1, 16) AS h, text FROM (SELECT p_name || ' ' || p_type AS text FROM part)")
def _(spark, sf):
    return r.facts_dedup_hash(read(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")))


@query("facts_upsert", """WITH b AS (SELECT DISTINCT p_name AS h, p_name AS text, ['part'] AS tags, CASE WHEN starts_with(p_name, 'blue') THEN list_transform(range(20), lambda i: i::VARCHAR) ELSE [] END AS history FROM part WHERE p_size > 10),
 c AS (SELECT p_name AS h, min(p_type) AS text, ['new'] AS tags, CASE WHEN starts_with(p_name, 'red') THEN 'delete' ELSE 'update' END AS op FROM part WHERE p_size < 40 GROUP BY p_name)
 SELECT h, coalesce(c.text, b.text) AS text, list_sort(list_distinct(list_concat(coalesce(b.tags, []), coalesce(c.tags, [])))) AS tags,
 CASE WHEN b.text <> c.text AND len(b.history) < 20 THEN list_append(b.history, b.text) ELSE coalesce(b.history, []) END AS history FROM b FULL JOIN c USING (h) WHERE op IS NULL OR op <> 'delete'""")
def _(spark, sf):
    part = read(spark, sf, "part")
    full = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i.cast("string"))
    base = part.where("p_size > 10").select(F.col("p_name").alias("h"), F.col("p_name").alias("text")).distinct().withColumns(
        {"tags": F.array(F.lit("part")), "history": F.when(F.col("h").startswith("blue"), full).otherwise(F.array().cast("array<string>"))})
    changes = part.where("p_size < 40").groupBy(F.col("p_name").alias("h")).agg(F.min("p_type").alias("text")).withColumns({"tags": F.array(F.lit("new")), "op": F.when(F.col("h").startswith("red"), "delete").otherwise("update")})
    return r.facts_upsert(base, changes)


@query("facts_upsert_batch", """WITH b AS (SELECT DISTINCT p_name AS h, p_name AS text, ['part'] AS tags FROM part WHERE p_size > 25),
 c AS (SELECT p_name AS h, list({'o': p_partkey, 't': p_type, 'g': p_brand, 'd': p_size = 1} ORDER BY p_partkey) AS l FROM part WHERE p_size < 40 GROUP BY 1),
 k AS (SELECT h, l, coalesce(list_max(list_transform(list_filter(l, lambda x: x.d), lambda x: x.o)), -1) AS cut FROM c),
 v AS (SELECT h, cut >= 0 AS reset, list_filter(l, lambda x: x.o > cut) AS l FROM k),
 w AS (SELECT h, CASE WHEN NOT coalesce(reset, false) THEN b.tags END AS old_tags, coalesce(l, []) AS l, list_concat(CASE WHEN NOT coalesce(reset, false) AND b.text IS NOT NULL THEN [b.text] ELSE [] END, list_transform(coalesce(l, []), lambda x: x.t)) AS texts FROM b FULL JOIN v USING (h))
 SELECT h, texts[-1] AS text, list_sort(list_distinct(list_concat(coalesce(old_tags, []), list_transform(l, lambda x: x.g)))) AS tags,
  list_filter(list_transform(range(1, len(texts)), lambda i: CASE WHEN texts[i] <> texts[i + 1] THEN texts[i] END), lambda x: x IS NOT NULL)[1:20] AS history FROM w WHERE len(texts) > 0""")
def _(spark, sf):
    """Every part is a change of the fact of its name, in the order of the parts."""
    part = read(spark, sf, "part")
    base = part.where("p_size > 25").select(F.col("p_name").alias("h"), F.col("p_name").alias("text")).distinct().withColumns(
        {"tags": F.array(F.lit("part")), "history": F.array().cast("array<string>")})
    changes = part.where("p_size < 40").select(
        F.col("p_name").alias("h"), F.col("p_type").alias("text"), F.array("p_brand").alias("tags"), F.when(F.col("p_size") == 1, "delete").otherwise("update").alias("op"), "p_partkey")
    return r.facts_upsert_batch(base, changes, "p_partkey")


@query("kb_search", f"WITH {VEC}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM vec) WHERE rank <= 3 AND score >= 0.1) SELECT q.qid, tp.doc, tp.score FROM q LEFT JOIN tp USING (qid)")
def _(spark, sf):
    return r.kb_search(asked(spark, sf), parts(spark, sf))


@query("kb_train", "SELECT DISTINCT substr(sha256(p_name || ' → ' || p_type), 1, 16) AS h, p_name || ' → ' || p_type AS text FROM part")
def _(spark, sf):
    return r.kb_train(read(spark, sf, "part").select(F.col("p_name").alias("problem"), F.col("p_type").alias("solution")))


def _json(columns: list[str]) -> str:
    return " || ',' || ".join(f"""'"{c}":' || {f"'\"' || {c} || '\"'" if c.endswith("_name") else f"{c}::VARCHAR"}""" for c in sorted(columns))


SUPPLIER = f"d AS (SELECT s_suppkey AS doc, '{{' || {_json(['s_suppkey', 's_name', 's_nationkey'])} || '}}' AS text FROM supplier)"


@query("row_retrieve", f"WITH {VEC.replace(D, SUPPLIER)} {TOP.format(t='vec')}")
def _(spark, sf):
    return r.row_retrieve(asked(spark, sf), read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey", K)


@query("auto_sediment", f"""WITH RECURSIVE {DECIDE.replace(' WHERE p_size > 25', ' WHERE p_size < 2')} SELECT q.qid, q.text, ['part', 'auto', 'catalogue'] AS tags, best, fact, fact_new, fact_text, action FROM wd JOIN q USING (qid)""")
def _(spark, sf):
    said = asked(spark, sf).withColumn("tags", F.array(F.lit("part")))
    known = read(spark, sf, "part").where("p_size < 2").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return r.auto_sediment(said, known, "catalogue")


@query("vault_search", """WITH l AS (SELECT doc_id AS doc, contains(lower(source), 'license')::INT AS named, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(lower(x), 'license')) AS lines FROM documents)
 SELECT doc, 3 * named + len(lines) AS score, lines[1] AS snippet FROM l WHERE 3 * named + len(lines) > 0""")
def _(spark, sf):
    return r.vault_search(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("name"), "text"), "License")


@query("phrase_mine", r"""WITH k AS (SELECT doc_id AS doc, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10),
 s AS (SELECT doc, topic, i FROM (SELECT doc, unnest(p) AS topic, unnest(range(len(p))) AS i FROM (SELECT doc, string_split_regex(text, '[,，。；;：:!！?？\s、/()（）\[\]【】]+') AS p FROM k)) WHERE length(topic) BETWEEN 2 AND 12),
 h AS (SELECT topic, count(*) AS n, count(DISTINCT doc) AS docs, min((doc, i)) AS first FROM s GROUP BY 1 HAVING count(*) >= 2 ORDER BY first, topic LIMIT 8),
 st AS (SELECT * FROM (SELECT topic, doc, text, row_number() OVER (PARTITION BY topic ORDER BY doc) AS rn FROM h JOIN k ON contains(text, topic)) WHERE rn <= 8),
 bg AS (SELECT topic, pair, count(*) AS c FROM (SELECT topic, unnest(list_distinct(list_transform(range(1, length(text)), lambda i: text[i:i + 1]))) AS pair FROM st) WHERE regexp_matches(pair, '^[\p{L}\p{N}]{2}$') AND NOT regexp_matches(pair, '^[0-9]{2}$') GROUP BY ALL HAVING count(*) >= 2),
 tr AS (SELECT topic, list(pair ORDER BY c DESC, pair) AS pairs FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, pair) AS rn FROM bg) WHERE rn <= 4 GROUP BY 1),
 ls AS (SELECT topic, list(doc ORDER BY doc) AS steps FROM st GROUP BY 1)
 SELECT topic, n, docs, steps, list_concat([topic], coalesce(pairs, [])) AS triggers FROM h LEFT JOIN ls USING (topic) LEFT JOIN tr USING (topic)""")
def _(spark, sf):
    return r.phrase_mine(documents(spark, sf))


TRIGGERS = (("deploy", "LICENSE"), ("deploy", "apache"), ("contact", "@Mail"), ("contact", "http"))


@query("trigger_match", "SELECT doc_id AS doc, skill, count(*) AS hits FROM documents, (VALUES " + ", ".join(str(t) for t in TRIGGERS) + ") AS t(skill, trigger_) WHERE contains(lower(text), lower(trigger_)) GROUP BY 1, 2")
def _(spark, sf):
    return r.trigger_match(documents(spark, sf), spark.createDataFrame(TRIGGERS, "skill string, trigger string"))


#: The lexicon with terms of the documents' own languages.
TERMS = (*q.LEXICON, ("D1", "variant", "warn", ("Licensed", "Copyright")), ("D5", "banned", "fail", ("stupid", "trash", "idiot")))
SCAN = " UNION ALL ".join(
    f"SELECT doc, '{a}' AS layer, '{k}' AS kind, '{s}' AS severity, '{t}' AS term, (length(text) - length(replace(text, '{t}', ''))) // {len(t)} AS count FROM c WHERE contains(text, '{t}')" for a, k, s, ts in TERMS for t in ts)


SUGGESTED = ", ".join(f"('{a}', '{b}')" for a, b in q.SUGGESTIONS.items())


@query("scan_terms", f"WITH c AS (SELECT doc_id AS doc, regexp_replace(coalesce(text, ''), '```.*?```', '', 'gs') AS text FROM documents), g(term, suggestion) AS (VALUES {SUGGESTED}), s AS ({SCAN}) SELECT s.*, suggestion FROM s LEFT JOIN g USING (term)")
def _(spark, sf):
    return q.scan_terms(documents(spark, sf), TERMS)


PLAIN = tuple(p for p in q.PATTERNS if "(?" not in p[3]) + (("D2", "symbol_run", "fail", r"[*$%&#]{3}"), ("D4", "year", "warn", r"20[0-9]{2}"))
PATTERN_SQL = " UNION ALL ".join(
    f"SELECT doc, '{a}' AS layer, '{k}' AS kind, '{s}' AS severity, regexp_extract(text, '{p}', 0) AS term, len(regexp_extract_all(text, '{p}')) AS count FROM c WHERE regexp_matches(text, '{p}')" for a, k, s, p in PLAIN)


@query("scan_patterns", f"WITH c AS (SELECT doc_id AS doc, regexp_replace(coalesce(text, ''), '```.*?```', '', 'gs') AS text FROM documents) {PATTERN_SQL}")
def _(spark, sf):
    return q.scan_patterns(documents(spark, sf), PLAIN)


LINKS = " + ".join(f"(length(body) - length(replace(body, '{c}', ''))) // {len(c)}" for c in q.CONNECTIVES)
RHYTHM = f"""c AS (SELECT doc_id AS doc, coalesce(text, '') AS text FROM documents),
 s AS (SELECT doc, text, body, list_transform(list_filter(list_transform(string_split_regex(body, '[。！？!?；]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: length(x)) AS lens
  FROM (SELECT *, regexp_replace(text, '```.*?```', '', 'gs') AS body FROM c)),
 f AS (SELECT doc, 'long_paragraph' AS kind, 'warn' AS severity, len(list_filter(string_split(body, chr(10)), lambda p: length(p) > 400)) AS count FROM s
  UNION ALL SELECT doc, 'flat_rhythm', 'warn', (len(list_filter(range(1, greatest(len(lens) - 1, 1)), lambda i: greatest(lens[i], lens[i + 1], lens[i + 2]) - least(lens[i], lens[i + 1], lens[i + 2]) < 5 AND greatest(lens[i], lens[i + 1], lens[i + 2]) > 10)) > 0)::INT FROM s
  UNION ALL SELECT doc, 'dense_connectives', 'warn', CASE WHEN len(lens) > 0 AND ({LINKS}) / len(lens) > 0.3 THEN {LINKS} ELSE 0 END FROM s
  UNION ALL SELECT doc, 'late_conclusion', 'info', (length(text) > 150 AND NOT regexp_matches(substr(body, 1, 100), '[0-9]|结果|结论|是|%|倍|万|亿'))::INT FROM s),
 rh AS (SELECT doc, 'D6' AS layer, kind, severity, '' AS term, count FROM f WHERE count > 0)"""


@query("scan_rhythm", f"WITH {RHYTHM} SELECT * FROM rh")
def _(spark, sf):
    return q.scan_rhythm(documents(spark, sf))


@query("text_scan", f"""WITH {RHYTHM.replace('c AS (SELECT', 'c0 AS (SELECT', 1).replace('FROM c)', 'FROM c0)')}, c AS (SELECT doc_id AS doc, regexp_replace(coalesce(text, ''), '```.*?```', '', 'gs') AS text FROM documents),
 al AS (SELECT doc, layer, severity, count FROM ({SCAN}) UNION ALL SELECT doc, layer, severity, count FROM ({PATTERN_SQL}) UNION ALL SELECT doc, layer, severity, count FROM rh)
 SELECT doc, layer, sum(count)::BIGINT AS count, coalesce(sum(count) FILTER (severity = 'fail'), 0)::BIGINT AS fails, coalesce(sum(count) FILTER (severity = 'warn'), 0)::BIGINT AS warns, coalesce(sum(count) FILTER (severity = 'fail'), 0) = 0 AS passed FROM al GROUP BY 1, 2""")
def _(spark, sf):
    return q.text_scan(documents(spark, sf), TERMS, PLAIN)


#: Signs of words as Java's \\w has them under (?U): no `²`, but circled and squared letters and the joiners.
_WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}\\x{24B6}-\\x{24E9}\\x{1F130}-\\x{1F149}\\x{1F150}-\\x{1F169}\\x{1F170}-\\x{1F189}"
#: RE2 has no look-around, so bounds are written into the text: BEGIN where a match may begin, END where it may end.
BEGIN, END, ESCAPE = "chr(1)", "chr(2)", "chr(3)"
_N = "[\\x01\\x02]*"
_SPACE = "[ \\t\\n\\x0B\\f\\r]*"
#: Kinds in order with what bounds them and their pattern over a text with bounds. Numbers have a bound at each end of their
#: digits; words have an END before and a BEGIN behind each other sign, so bounds lie within what has such signs.
MASKS = (
    ("IP", "number", "\\x01(?:[0-9]{1,3}\\x02\\.\\x01){3}[0-9]{1,3}\\x02"), ("PHONE", "number", "\\x011[3-9][0-9]{9}\\x02"), ("TEL", "number", "\\x010[0-9]{2,3}(?:\\x02-\\x01)?[0-9]{7,8}\\x02"),
    ("EMAIL", "word", f"\\x01[{_WORD}.+-](?:{_N}[{_WORD}.+-])*{_N}@{_N}[{_WORD}-](?:{_N}[{_WORD}-])*{_N}\\.{_N}[{_WORD}.](?:{_N}[{_WORD}.])*\\x02"),
    ("AMOUNT", "", f"[¥￥]{_SPACE}[0-9][0-9,]*\\.?[0-9]*{_SPACE}(?:万|亿|元|万元|亿元)?"), ("ID", "number", "\\x01(?:[0-9]{18}\\x02|[0-9]{17}\\x02[Xx]([^\\x01]|$))"),
    ("DOMAIN", "word", f"\\x01(?:[a-z0-9-](?:{_N}[a-z0-9-])*{_N}\\.{_N})+[a-z]{{2,}}\\x02"), ("SERIAL", "number", "\\x01[0-9]{10,}\\x02"))
#: How the signs of bounds and their escape are written where a text has them itself.
_OWN = ((ESCAPE, "!"), (BEGIN, '"'), (END, "#"))


def _bound(text: str, by: str) -> str:
    if by == "number":
        text = f"regexp_replace(regexp_replace({text}, '([^0-9])([0-9])', '\\1' || {BEGIN} || '\\2', 'g'), '([0-9])([^0-9])', '\\1' || {END} || '\\2', 'g')"
        return f"{BEGIN} || {text} || {END}"
    # An END comes before a BEGIN at the same place, so that matches can follow each other.
    return f"replace({BEGIN} || regexp_replace({text}, '([^{_WORD}])', {END} || '\\1' || {BEGIN}, 'g') || {END}, {BEGIN} || {END}, {END} || {BEGIN})"


def _masked(text: str) -> str:
    for sign, as_ in _OWN:
        text = f"replace({text}, {sign}, {ESCAPE} || '{as_}')"
    now = ""
    for name, by, body in MASKS:
        if now not in ("", by) or by == "":
            text = f"replace(replace({text}, {BEGIN}, ''), {END}, '')"
        if by not in ("", now):
            text = _bound(text, by)
        # What stands behind an ID's X stays.
        text, now = f"regexp_replace({text}, '{body}', '{{{{{name}}}}}{'\\1' if name == 'ID' else ''}', 'g')", by
    text = f"replace(replace({text}, {BEGIN}, ''), {END}, '')"
    for sign, as_ in reversed(_OWN):
        text = f"replace({text}, {ESCAPE} || '{as_}', {sign})"
    return text


@query("mask_typed", f"SELECT doc_id AS doc, {_masked("coalesce(text, '')")} AS masked FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc", q.mask_typed(F.col("text")).alias("masked"))


@query("mask_pii", f"""WITH m AS (SELECT doc_id AS doc, coalesce(text, '') AS text, {_masked("coalesce(text, '')")} AS typed FROM documents)
 SELECT doc, typed, (length(typed) - length(replace(typed, '{{', '')) - length(text) + length(replace(text, '{{', ''))) // 2 AS n_placeholders, sha256(text) AS restored_sha256 FROM m""")
def _(spark, sf):
    """The numbered form: with its placeholders' numbers left out it is the typed one, it has a placeholder for each match, all different, and restores the text."""
    rows = documents(spark, sf).withColumn("x", q.mask_pii(F.col("text")))
    typed = q.unmask(F.col("x.masked"), F.transform_values("x.mapping", lambda mark, _: F.regexp_replace(mark, "_[0-9]+", "")))
    return rows.select("doc", typed.alias("typed"), F.size("x.mapping").cast("long").alias("n_placeholders"), F.sha2(q.unmask(F.col("x.masked"), F.col("x.mapping")), 256).alias("restored_sha256"))


@query("unmask", "SELECT doc_id AS doc, sha256(coalesce(text, '')) AS restored_sha256 FROM documents")
def _(spark, sf):
    rows = documents(spark, sf).withColumn("x", q.mask_pii(F.col("text")))
    return rows.select("doc", F.sha2(q.unmask(F.col("x.masked"), F.col("x.mapping")), 256).alias("restored_sha256"))


def reports(spark, sf):
    """A sentence with claims about each event series, true or not. Means are rounded half up, with `TIE` against the order of sums."""
    rows = read(spark, sf, "events").groupBy("user_id").agg(F.round(F.max("value") + TIE, 1).alias("hi"), F.round(F.avg("value") + TIE, 1).alias("mean"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("day"))
    return rows.select(F.col("user_id").alias("doc"), F.concat(F.lit("设备温度达到 "), F.col("mean").cast("string"), F.lit("，最高为 "), F.col("hi").cast("string"), F.lit("，占用 35%，日期 "), "day", F.lit("。")).alias("text"))


#: The claims of `reports`, written down by their form: a percentage, a number, a date and an extreme.
CLAIMS = """rp AS (SELECT user_id AS doc, round(max(value) + 1e-9, 1)::VARCHAR AS hi, round(avg(value) + 1e-9, 1)::VARCHAR AS mean, strftime(max(ts), '%Y-%m-%d') AS day FROM events GROUP BY 1),
 tx AS (SELECT *, '设备温度达到 ' || mean || '，最高为 ' || hi || '，占用 35%，日期 ' || day || '。' AS text FROM rp),
 cl AS (SELECT doc, text, 1 AS place, 'percent' AS type, '占用35%' AS claim, '35.0' AS value, '占用' AS word, '35' AS number FROM tx UNION ALL SELECT doc, text, 2, 'number', '设备温度达到 ' || mean, mean, '设备温度', mean FROM tx
  UNION ALL SELECT doc, text, 3, 'date', day, day, '', substr(day, 1, 4) FROM tx UNION ALL SELECT doc, text, 4, 'extreme', '最高为 ' || hi, hi, '最高', hi FROM tx)"""


@query("ledger", f"""WITH {CLAIMS} SELECT doc, 'E' || place AS id, claim, type, value, word, substr(text, greatest(1, instr(text, number) - 15), length(claim) + 30) AS context,
 'E' || place || '-' || substr(sha256(claim), 1, 6) AS trace_id FROM cl""")
def _(spark, sf):
    return q.ledger(reports(spark, sf))


def _source(spark, sf):
    return read(spark, sf, "events").select(F.col("value").alias("temperature"), (F.col("event_id") % 100).alias("load_pct"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")


CHECKED = f"""{CLAIMS}, so AS (SELECT max_by(value, event_id) AS t_last, max(value) AS t_max, max_by(event_id % 100, event_id)::DOUBLE AS l_last, max(event_id % 100)::DOUBLE AS l_max FROM events),
 dy AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS value FROM events),
 x AS (SELECT doc, 'E' || place AS id, claim, type, value, CASE type WHEN 'date' THEN NULL ELSE value::DOUBLE END AS v, t_last, l_last,
   CASE WHEN type = 'extreme' AND abs(t_max - value::DOUBLE) <= greatest(1, t_max * 0.15) THEN 'temperature' WHEN type = 'extreme' AND abs(l_max - value::DOUBLE) <= greatest(1, l_max * 0.15) THEN 'load_pct' END AS top,
   value IN (SELECT value FROM dy) AS dated FROM cl, so),
 y AS (SELECT *, CASE WHEN type = 'date' THEN CASE WHEN dated THEN 'supported' ELSE 'unsupported' END WHEN type = 'percent' THEN CASE WHEN abs(l_last - v) <= greatest(5, l_last * 0.15) THEN 'supported' ELSE 'contradicted' END
   WHEN top IS NOT NULL THEN 'supported' WHEN abs(t_last - v) <= greatest(5, t_last * 0.15) THEN 'supported' ELSE 'contradicted' END AS status FROM x),
 ck AS (SELECT doc, id, claim, type, value, status, CASE WHEN status <> 'supported' THEN 0.0 WHEN type = 'date' THEN 0.8 WHEN type = 'percent' THEN round(1 - abs(l_last - v) / 100, 2) WHEN top IS NOT NULL THEN 0.9
   ELSE round(1 - least(1, abs(t_last - v) / greatest(5, t_last * 0.15)) * 0.5, 2) END AS confidence, CASE WHEN type = 'percent' THEN 'load_pct' WHEN top IS NOT NULL THEN top WHEN type <> 'date' THEN 'temperature' END AS "column" FROM y)"""


@query("fact_check", f"WITH {CHECKED} SELECT * FROM ck")
def _(spark, sf):
    return q.fact_check(q.ledger(reports(spark, sf)), _source(spark, sf), ["temperature", "load_pct", "day"], "event_id")


@query("fact_check_summary", f"""WITH {CHECKED}, n AS (SELECT doc, count(*) AS total, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'contradicted') AS contradicted FROM ck GROUP BY 1)
 SELECT *, CASE WHEN supported = total THEN '全可溯源' WHEN unsupported > 0 THEN '存在不可溯源声明' ELSE '存在矛盾声明' END AS verdict, contradicted = 0 AND unsupported = 0 AS pass FROM n""")
def _(spark, sf):
    return q.fact_check_summary(q.fact_check(q.ledger(reports(spark, sf)), _source(spark, sf), ["temperature", "load_pct", "day"], "event_id"))
