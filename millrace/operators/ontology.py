"""Entity graphs and triples from relational tables, their queries, and metadata about columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.typed import is_blank, is_num, safe_name, semantic_role, strip
from millrace.operators.automaton import find_terms
from millrace.operators.series import numbered
from millrace.session import durable

#: Column words by meaning, and the entity of each domain. Fixed values.
MEASURE_TERMS = (
    "温度", "temp", "振动", "vib", "功率", "power", "load", "压力", "pressure", "流量", "flow", "转速", "speed", "内存", "mem", "cpu",
    "占比", "ratio", "pct", "rate", "数量", "count", "qty", "重量", "weight", "尺寸", "size", "库存", "stock", "金额", "price",
)
CATEGORY_TERMS = (
    "类型", "type", "状态", "status", "state", "级别", "level", "等级", "grade", "类别", "category", "kind", "flag", "triage",
    "严重级", "severity", "区域", "zone", "产线", "line",
)
TIME_TERMS = ("date", "日期", "time", "时间", "ts", "创建", "create", "install", "截止", "deadline")
DOMAIN_ENTITY = {
    "设备/传感器": "Device", "工单/任务": "WorkOrder", "产线/工位": "ProductionLine", "产品/物料": "Product", "人员/班组": "Operator",
    "客户/供应商": "Partner", "区域/车间": "Workshop", "质量/缺陷": "Quality",
}
SYNONYMS = {
    "device": "equipment", "equip": "equipment", "machine": "equipment", "product": "product", "customer": "customer",
    "supplier": "supplier", "sensor": "sensor", "wo": "workorder", "work": "workorder",
}
NAMESPACE = "urn:millrace:"


def _any(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def link_entities(left: DataFrame, right: DataFrame, key_left: str, key_right: str, order: str) -> DataFrame:
    """Left rows with the last right row (by `order`) of the same key; null keys match. Adds `match`."""
    per = Window.partitionBy(key_right).orderBy(F.desc(order))
    last = right.withColumn("__rn", F.row_number().over(per)).where("__rn = 1").drop("__rn").withColumn("__hit", F.lit(True))
    return left.join(last, left[key_left].eqNullSafe(last[key_right]), "left").withColumn("match", F.coalesce("__hit", F.lit(False))).drop("__hit")


def nodes(df: DataFrame, entity: str, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.concat(F.lit(f"{entity}:"), F.col(key).cast("string")).alias("id"), F.lit(entity).alias("entity")).distinct()


def edges(df: DataFrame, entity: str, key: str, fk: str, target: DataFrame, target_entity: str, target_key: str, rel: str) -> DataFrame:
    """Distinct (from, to, rel) of a foreign key where both ends exist."""
    ends = target.select(F.col(target_key).cast("string").alias("__k")).distinct()
    rows = df.select(F.col(key).cast("string").alias("__id"), F.col(fk).cast("string").alias("__k")).dropna()
    return rows.join(ends, "__k").select(
        F.concat(F.lit(f"{entity}:"), "__id").alias("from"), F.concat(F.lit(f"{target_entity}:"), "__k").alias("to"), F.lit(rel).alias("rel")).distinct()


def build_graph(tables: Mapping[str, DataFrame], keys: Mapping[str, str], relations: Sequence[tuple[str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of entities with their key columns and relations (entity, foreign key, target entity, rel)."""
    n = e = None
    for entity, df in tables.items():
        part = nodes(df, entity, keys[entity])
        n = part if n is None else n.unionByName(part)
    for entity, fk, target, rel in relations:
        part = edges(tables[entity], entity, keys[entity], fk, tables[target], target, keys[target], rel)
        e = part if e is None else e.unionByName(part)
    return n, e


def traverse(edges_: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, neighbour, rel, direction) one step from each start `id`, along and against the edges."""
    out = edges_.join(starts, F.col("from") == F.col("id")).select(F.col("id").alias("start"), F.col("to").alias("neighbour"), "rel", F.lit("out").alias("direction"))
    back = edges_.join(starts, F.col("to") == F.col("id")).select(F.col("id").alias("start"), F.col("from").alias("neighbour"), "rel", F.lit("in").alias("direction"))
    return out.unionByName(back)


def infer_fk(columns: DataFrame, entities: DataFrame, declared: DataFrame) -> DataFrame:
    """Foreign keys guessed from a catalogue: columns (table, entity, column), entities (entity, rank), declared (table, column).

    A column named *_id or *_code points to the first other entity whose name holds the column's word, or the reverse.
    """
    word = F.regexp_replace(F.regexp_replace("column", "_id", ""), "_code", "")
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    fks = columns.where(F.col("column").endswith("_id") | F.col("column").endswith("_code")).join(declared, ["table", "column"], "left_anti")
    fks = fks.withColumn("word", F.lower(F.coalesce(F.try_element_at(known, word), word)))
    target = entities.select(F.col("entity").alias("target"), "rank", F.lower("entity").alias("low"))
    # Both sides are catalogues of column and entity names, not data.
    met = fks.join(target, (F.col("low") != F.lower("entity")) & (F.col("low").contains(F.col("word")) | F.col("word").contains(F.col("low"))))
    return met.groupBy("table", "entity", "column").agg(F.min_by("target", "rank").alias("target"))


def rows_to_triples(df: DataFrame, entity: str, key: str, columns: Sequence[str], relations: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """(s, p, o): a type triple for each row and one for each non-blank cell; a column in `relations` (predicate,
    target class) points to `Class:value`."""
    relations = relations or {}
    cells = [F.struct(
        F.lit(relations[c][0] if c in relations else f"{NAMESPACE}{c}").alias("p"),
        F.when(~is_blank(F.col(c)), F.concat(F.lit(f"{relations[c][1]}:" if c in relations else ""), strip(F.col(c)))).alias("o")) for c in columns]
    cells.append(F.struct(F.lit("rdf:type").alias("p"), F.lit(entity).alias("o")))
    flat = df.select(F.concat(F.lit(f"{entity}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("s"), F.explode(F.array(*cells)).alias("x"))
    return flat.where("x.o is not null").select("s", "x.p", "x.o")


def reference_classes(df: DataFrame, relations: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(class, value): the distinct values that object columns point to."""
    out = None
    for c, (_, target) in relations.items():
        part = df.where(~is_blank(F.col(c))).select(F.lit(target).alias("class"), strip(F.col(c)).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def triple_query(triples: DataFrame, subjects: DataFrame, predicate: str | None = None) -> DataFrame:
    """The triples of the subjects `s`; with a predicate those that equal it or contain it."""
    rows = triples.join(subjects.select("s").distinct(), "s", "left_semi")
    return rows if predicate is None else rows.where((F.col("p") == predicate) | F.col("p").contains(predicate))


def triple_neighbors(triples: DataFrame, strict: bool = False) -> DataFrame:
    """(s, o) where the object names an instance: it contains a colon; strict: after a class name."""
    rows = triples.where(F.col("o").contains(":"))
    return (rows.where(F.col("o").rlike(r"^[A-Za-z_]\w*:")) if strict else rows).select("s", "o").distinct()


def triple_search(triples: DataFrame, term: str, k: int) -> DataFrame:
    """The first k triples, in order of their text, that hold the term in any part, whatever its case."""
    t = term.lower()
    return triples.where(F.lower("s").contains(t) | F.lower("p").contains(t) | F.lower("o").contains(t)).orderBy("s", "p", "o").limit(k)


def relation_nav(triples: DataFrame, questions: DataFrame, relations: DataFrame, most: int = 10) -> DataFrame:
    """Answers by navigation: for relations (entity, p, label) whose label is in the question (qid, text), the first
    value of each of the entity's first instances.

    A label's answers are the same in all questions, so they are found once, at most `most` for each label, and then joined."""
    named = find_terms(questions, relations.select(F.col("label").alias("term")), "qid").select("qid", F.col("term").alias("label"))
    hits = triples.join(relations.select("entity", "p", "label").distinct(), "p").where(F.col("s").startswith(F.concat("entity", F.lit(":"))))
    first = hits.groupBy("entity", "label", "s").agg(F.min("o").alias("value"))
    per = Window.partitionBy("label").orderBy("s", "entity")
    answers = durable(first.withColumn("rn", F.row_number().over(per)).where(F.col("rn") <= most).drop("rn"), "nav_answers")
    return named.join(answers, "label").select("qid", "entity", "label", "s", "value")


def validate_constraints(df: DataFrame, entity: str, key: str, required: Sequence[str], order: str) -> DataFrame:
    """(entity, type, column, value): each repeat of the key, and each blank required cell."""
    repeats = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__rn > 1").select(
        F.lit(entity).alias("entity"), F.lit("unique").alias("type"), F.lit(key).alias("column"), F.col(key).cast("string").alias("value"))
    blanks = F.filter(F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    missing = df.select(F.explode(blanks).alias("column"), F.col(key).cast("string").alias("value")).select(
        F.lit(entity).alias("entity"), F.lit("required").alias("type"), "column", "value")
    return repeats.unionByName(missing)


def agg_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def agg_extreme(df: DataFrame, column: str, order: str, largest: bool = True) -> DataFrame:
    """The row with the largest or smallest number in a column; of equal ones the first by `order`."""
    v = F.when(is_num(F.col(column)), F.col(column).cast("string").try_cast("double"))
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by(row, F.struct(v, -F.col(order))) if largest else F.min_by(row, F.struct(v, F.col(order)))
    return df.where(v.isNotNull()).agg(best.alias("x")).select("x.*")


def agg_enum(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_blank(F.col(column))).select(strip(F.col(column)).alias("value")).distinct().orderBy("value")


def agg_list(df: DataFrame) -> DataFrame:
    """Distinct values of the first name-like column, else of the first id column."""
    names = [c for c in df.columns if any(k in c.lower() for k in ("名称", "名字", "name"))]
    ids = [c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id")]
    return agg_enum(df, (names + ids)[0])


def answer_aggregate(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """count, sum, avg, min and max, rounded to 3, of a column's numeric cells."""
    v = F.when(is_num(F.col(column)), F.col(column).cast("string").try_cast("double"))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.sum(v), 3).alias("sum"), F.round(F.avg(v), 3).alias("avg"), F.round(F.min(v), 3).alias("min"), F.round(F.max(v), 3).alias("max"))


def filter_equals(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column).cast("string") == value)


#: How questions are told apart. Fixed values.
QUESTIONS = (
    ("count", r"^有多少[个台条位家本批艘]?(.+)$"), ("max", r"^(.+?)最[高贵多大]的.*$"), ("min", r"^(.+?)最[低便宜少小]+的.*$"),
    ("list", r"^有哪些(.+)$"), ("enum", r"^(.+?)有哪些$"), ("avg", r"^(?:平均|均值)(.+)$"), ("sum", r"^(?:总|合计)(.+)$"),
)


#: Words of questions that aren't filters. Fixed values.
NOT_FILTERS = ("平均", "均值", "合计", "求和", "总和", "最大", "最小", "多少", "几", "共有", "一共", "总共有", "数量", "几台")


def _filter_value(text: Column, word: str) -> Column:
    """The value in `<word>为<value>` or `<value>的<word>`; "" if neither is there."""
    after = F.regexp_extract(text, word + r"[为是:：]?\s*([^\s，。、的]+)的?", 1)
    return F.when(after != "", after).otherwise(F.regexp_extract(text, r"([^\s，。、的]+)的" + word, 1))


#: Answers of one kind and column that are held together, groups in which the questions that ask for them are dealt, and rows
#: that a task makes of both, about.
TOGETHER = 1000
DEALT = 32
MADE = 20_000_000


def _told(known: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question (qid, kind, column, key) with all answers (key, answer) of its key, a kind and column.

    Many questions may ask for the same many answers. So answers go in bundles, and questions of one kind and column are
    dealt in groups: each task makes the rows of some groups and bundles, and none those of a whole kind. The result has a
    row for each pair of both, so the number of tasks grows with the pairs, and nothing but unpacking is done for a row."""
    spark = known.sparkSession
    rows = durable(answers, "answers")
    held = rows.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("held"))  # a row for each kind and column
    pairs = known.groupBy("key").count().join(F.broadcast(held), "key").agg(F.sum(F.col("count") * F.col("held"))).first()[0] or 0
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, math.ceil(pairs / MADE))
    sizes = held.select("key", F.ceil(F.col("held") / TOGETHER).cast("int").alias("bundles"))
    held = rows.join(F.broadcast(sizes), "key").groupBy("key", F.pmod(F.xxhash64("answer"), F.col("bundles")).cast("int").alias("bundle")).agg(F.collect_list("answer").alias("held"))
    held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).repartition(number, "key", "bundle", "group")
    asked = known.withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(DEALT)).cast("int")).join(F.broadcast(sizes), "key")
    asked = asked.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1))).repartition(number, "key", "bundle", "group")
    return asked.join(held, ["key", "bundle", "group"]).select("qid", "kind", "column", F.explode("held").alias("answer"))


def answer_batch(questions: DataFrame, df: DataFrame, columns: Mapping[str, str], order: str) -> DataFrame:
    """Answers of many questions (qid, text) about a table: (qid, kind, column, answer, instance).

    `columns` maps the words of questions to columns; a kind and a column are read from the text and joined with
    the aggregates of all columns, computed once. Kinds: count, max and min (instance is the row, as JSON; of equal
    ones the first by `order`), avg, sum, enum and list (a row for each distinct value; list takes the first name-like
    column, else the first id column), filter (how many rows have the value, 0 if none). What can't be read has no row.
    """
    text, kind, subject = F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(QUESTIONS):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
        subject = F.when(text.rlike(pattern), F.regexp_extract("text", pattern, 1)).otherwise(subject)
    words = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    sought = F.lit(None).cast("struct<column:string,value:string>")
    for word, column in reversed(columns.items()):
        value = _filter_value(text, word)
        sought = F.when((value != "") & (value != word) & ~value.rlike(r"^[0-9.]+$"), F.struct(F.lit(column).alias("column"), value.alias("value"))).otherwise(sought)
    sought = F.when(~_any(text, NOT_FILTERS) & kind.isNull(), sought)
    asked = questions.select("qid", "text", kind.alias("kind"), subject.alias("subject"), sought.alias("sought"))
    known = asked.where("kind is not null").withColumn("column", F.when(~F.col("kind").isin("count", "list"), F.try_element_at(words, F.trim("subject"))))
    used = list(dict.fromkeys(columns.values()))
    parts = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("cell")) for c in used]
    cells = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("row"), F.col(order).alias("place"), F.explode(F.array(*parts)).alias("x")).select("row", "place", "x.*")
    v = F.when(is_num(F.col("cell")), F.col("cell").try_cast("double"))
    stats = cells.groupBy("column").agg(
        F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("avg"), F.sum(v).alias("sum"),
        F.max_by("row", F.when(v.isNotNull(), F.struct(v, -F.col("place")))).alias("top"), F.min_by("row", F.when(v.isNotNull(), F.struct(v, "place"))).alias("low"))
    none = F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.round(F.col(n), 3).cast("string").alias("answer"), row.alias("instance")) for n, row in (("max", F.col("top")), ("min", F.col("low")), ("avg", none), ("sum", none))])
    long = stats.select("column", F.explode(each).alias("x")).select("column", "x.*")
    names = [c for c in df.columns if any(k in c.lower() for k in ("名称", "名字", "name"))] + [c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id")]
    values = cells.where("trim(cell) != ''").select("column", F.lit("enum").alias("kind"), strip(F.col("cell")).alias("answer")).distinct()
    for c in names[:1]:
        values = values.unionByName(agg_enum(df, c).select(none.alias("column"), F.lit("list").alias("kind"), F.col("value").cast("string").alias("answer")))
    count = df.agg(F.count(F.lit(1)).cast("string").alias("answer")).select(none.alias("column"), F.lit("count").alias("kind"), "answer")
    key, shown = F.concat_ws(":", "kind", "column").alias("key"), F.when(F.col("kind") == "list", F.lit(names[0] if names else None)).otherwise(F.col("column"))
    known, several = known.select("qid", "kind", shown.alias("column"), key), F.col("kind").isin("enum", "list")
    one = long.unionByName(count, allowMissingColumns=True).where("answer is not null").select(key, "answer", "instance")  # a row for each kind and column
    told = known.where(~several).join(F.broadcast(one), "key").drop("key").unionByName(_told(known.where(several), values.where("answer is not null").select(key, "answer")), allowMissingColumns=True)
    counts = cells.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    filters = asked.where("sought is not null").select("qid", "sought.column", F.col("sought.value").alias("cell")).join(counts, ["column", "cell"], "left").select(
        "qid", F.lit("filter").alias("kind"), "column", F.coalesce("n", F.lit(0)).cast("string").alias("answer"), none.alias("instance"))
    return told.unionByName(filters)


def semantic_role_domain(c: Column) -> Column:
    """(role, domain, linked_entity) of a column name across all data."""
    low = F.lower(F.trim(c))
    identifier = (low == "id") | (low.startswith("id") & ~low.endswith("_id")) | c.contains("编号") | c.contains("序号")
    reference = low.endswith("_id") | low.endswith("_code") | low.contains("设备") | low.contains("device")
    device = low.contains("device") | low.contains("设备")
    line = low.contains("line") | low.contains("产线")
    role = (
        F.when(identifier, "identifier").when(reference, "reference").when(_any(low, MEASURE_TERMS), "measure")
        .when(_any(low, CATEGORY_TERMS), "category").when(_any(low, TIME_TERMS), "timestamp").otherwise("text"))
    domain = (
        F.when(role == "identifier", "主键标识").when(role == "reference", F.when(device, "设备/传感器").otherwise("引用/外键"))
        .when(role == "measure", F.when(_any(low, ("温度", "temp", "内存", "mem", "cpu", "功率", "power", "load")), "设备/传感器").when(
            _any(low, ("金额", "price", "库存", "stock")), "产品/物料").otherwise("度量/指标"))
        .when(role == "category", F.when(device, "设备/传感器").when(line, "产线/工位").otherwise("分类/枚举"))
        .when(role == "timestamp", "时间/时序").otherwise("文本/描述"))
    entity = F.try_element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_ENTITY.items() for x in kv]), domain)
    return F.struct(role.alias("role"), domain.alias("domain"), entity.alias("linked_entity"))


def semantic_name_check(fields: DataFrame) -> DataFrame:
    """(field, role, ok): a measure word in a category, or a category word in a measure, is not ok."""
    rows = fields.withColumn("role", semantic_role_domain(F.col("field"))["role"])
    low = F.lower("field")
    bad = ((F.col("role") == "category") & _any(low, MEASURE_TERMS)) | ((F.col("role") == "measure") & _any(low, CATEGORY_TERMS))
    return rows.select("field", "role", (~bad).alias("ok"))


def semantic_bridge(blocks: DataFrame) -> DataFrame:
    """Per block (block, fields array): the number of its distinct fields and the entities they link to."""
    rows = blocks.select("block", F.explode("fields").alias("field")).withColumn("x", semantic_role_domain(F.col("field")))
    return rows.groupBy("block").agg(F.count_distinct("field").alias("fields"), F.array_sort(F.collect_set("x.linked_entity")).alias("entities"))


def prop_role(c: Column, type_: Column) -> Column:
    """The role of a property by its name and declared type."""
    low = F.lower(c)
    return (
        F.when((low == "id") | low.endswith("_id") | low.endswith("编号"), "identifier").when(low.endswith("_code"), "reference")
        .when(type_.isin("integer", "decimal", "float"), "measure").when(type_.isin("date", "datetime"), "timestamp")
        .when(_any(low, ("type", "status", "类型", "状态")), "category").otherwise("text"))


def build_model(df: DataFrame, entity: str, columns: Sequence[str], key: str | None, order: str) -> DataFrame:
    """(object_type, instance, properties map, roles map) of each row; without a key the instance is entity_<row>."""
    df = numbered(df, [order]) if key is None else df
    ident = F.concat(F.lit(f"{entity}_"), (F.col("number") - 1).cast("string")) if key is None else F.col(key).cast("string")
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    roles = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[semantic_role(F.lit(c)) for c in columns]))
    return df.select(F.lit(entity).alias("object_type"), ident.alias("instance"), values.alias("properties"), roles.alias("roles"))


def type_hierarchy(entities: DataFrame) -> DataFrame:
    """Enterprise, BusinessObject and each domain with its entities (entity, domain)."""
    domains = entities.groupBy(F.coalesce("domain", F.lit("其他域")).alias("name")).agg(F.array_sort(F.collect_list("entity")).alias("children"))
    top = entities.sparkSession.createDataFrame([("Enterprise", None, []), ("BusinessObject", "Enterprise", [])], "name string, super string, children array<string>")
    return top.unionByName(domains.select("name", F.lit("BusinessObject").alias("super"), "children"))


def entity_summary(catalogue: DataFrame) -> DataFrame:
    """A line of text for each entity of (entity, instances, columns array, relations array)."""
    return catalogue.select("entity", F.concat_ws(" | ", F.col("entity"), F.concat(F.lit("instances: "), F.col("instances").cast("string")),
                            F.concat(F.lit("columns: "), F.array_join("columns", ", ")), F.concat(F.lit("relations: "), F.array_join("relations", ", "))).alias("summary"))


def ntriples(triples: DataFrame) -> DataFrame:
    """N-Triples lines: instances as URIs under the namespace, other objects as escaped literals."""
    uri = lambda c: F.concat(F.lit(f"<{NAMESPACE}"), safe_name(F.regexp_replace(c, ":", "_")), F.lit(">"))
    predicate = F.when(F.col("p") == "rdf:type", F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")).when(
        F.col("p").startswith(NAMESPACE), F.concat(F.lit("<"), "p", F.lit(">"))).otherwise(uri(F.col("p")))
    literal = F.concat(F.lit('"'), F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    obj = F.when((F.col("p") == "rdf:type") | F.col("o").rlike(r"^[A-Za-z_]\w*:\S+$"), uri(F.col("o"))).otherwise(literal)
    return triples.select(F.concat_ws(" ", uri(F.col("s")), predicate, obj, F.lit(".")).alias("value"))


def link_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roles) of several tables in one go: foreign keys are guessed from the column names, the graph
    is built over them, and each column gets its role, domain and linked entity.

    Only the catalogue of column names, a few rows, is read by the driver."""
    spark = next(iter(tables.values())).sparkSession
    names = [(e.lower(), e, c) for e, df in tables.items() for c in df.columns]
    columns = spark.createDataFrame(names, "table string, entity string, column string")
    entities = spark.createDataFrame([(e, i) for i, e in enumerate(tables)], "entity string, rank int")
    guessed = infer_fk(columns, entities, columns.limit(0).select("table", "column")).collect()
    graph = build_graph(tables, keys, [(r["entity"], r["column"], r["target"], r["column"]) for r in sorted(guessed, key=lambda r: (r["entity"], r["column"]))])
    roles = columns.select("entity", "column", semantic_role_domain(F.col("column")).alias("x")).select("entity", "column", "x.*")
    return graph[0], graph[1], roles
