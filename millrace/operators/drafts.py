"""First drafts from a table's profile: questions, lexicon entries, translations of values, and repair advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.typed import local_name, strip

#: Values with a known English form. Fixed values.
TRANSLATIONS = {
    "运行": "running", "待机": "standby", "停机": "stopped", "故障": "fault", "正常": "normal", "异常": "abnormal", "在用": "in_use",
    "备用": "standby", "车床": "lathe", "铣床": "milling", "球阀": "ball_valve", "闸阀": "gate_valve", "一车间": "workshop_1",
    "二车间": "workshop_2", "三车间": "workshop_3", "华东一厂": "plant_east_1", "华北一厂": "plant_north_1",
}
#: Failure modes in order, with actions, parts and cost; the last is for all others. Fixed values.
ADVICE = (
    ("轴承磨损", ("更换轴承", "检查润滑脂"), ("轴承", "润滑脂"), 1200),
    ("轴对中偏差", ("重新对中", "检查联轴器"), ("联轴器",), 800),
    ("振动越限", ("停机检查", "动平衡", "检查松动"), ("螺栓", "垫片"), 1500),
    ("温度过高", ("检查冷却系统", "清洁散热片"), ("风扇", "散热片"), 600),
    ("油液污染", ("换油", "清洁滤芯"), ("润滑油", "滤芯"), 500),
    ("皮带磨损", ("更换皮带", "张紧"), ("皮带",), 400),
)
GENERAL = (("停机检查并联系维护", "记录故障现象与信号"), (), 0)
ID_WORDS = ("id", "编号", "序号", "主键", "udi")


def enum_en_suggest(values: Column) -> Column:
    """(en, needs_translation): a known translation, nothing for unknown CJK text, else the value itself."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in TRANSLATIONS.items() for x in kv]), strip(values))
    cjk = values.rlike("[一-鿿]") & known.isNull()
    return F.struct(F.when(cjk, "").otherwise(F.coalesce(known, values)).alias("en"), cjk.alias("needs_translation"))


def fault_advice(mode: Column) -> Column:
    """(actions, parts, estimated_cost) of the first failure mode that holds, or is held in, the text.

    An empty text is held in every name and so gets the first entry."""
    key = strip(mode)

    def entry(actions: tuple, parts: tuple, cost: int) -> Column:
        texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        return F.struct(texts(actions).alias("actions"), texts(parts).alias("parts"), F.lit(cost).alias("estimated_cost"))

    out = entry(*GENERAL)
    for name, actions, parts, cost in reversed(ADVICE):
        out = F.when(key.contains(name) | F.lit(name).contains(key), entry(actions, parts, cost)).otherwise(out)
    return out


def _is_id(column: Column) -> Column:
    out = F.lit(False)
    for w in ID_WORDS:
        out = out | F.lower(column).contains(w)
    return out


def draft_questions(dictionary: DataFrame, entity: str, measure: str = "个", limit: int = 12) -> DataFrame:
    """(n, question) from a profile dictionary (column, cn, type, enum): how many, extremes of numbers, kinds."""
    rows = dictionary.where(~_is_id(F.col("column"))).select("column", F.explode(F.when(
        F.col("type").isin("integer", "float"), F.array(F.concat("cn", F.lit(f"最大的{entity}")), F.concat("cn", F.lit(f"最小的{entity}")))
    ).when(F.size("enum").between(2, 8), F.array(F.concat("cn", F.lit("有哪些")))).when(
        F.lower("column").contains("name"), F.array(F.lit(f"有哪些{entity}"))).otherwise(F.array().cast("array<string>"))).alias("question"))
    first = dictionary.sparkSession.createDataFrame([("", f"有多少{measure}{entity}")], "column string, question string")
    # A row for each column of the table at most, so the window is small.
    number = F.row_number().over(Window.orderBy("column", "question"))
    return first.unionByName(rows).withColumn("n", number).where(F.col("n") <= limit).select("n", "question")


def draft_lexicon(dictionary: DataFrame) -> DataFrame:
    """(column, cn, type, enum, suggest) from a profile dictionary; id columns are identifiers."""
    ident = _is_id(F.col("column"))
    kinds = F.when(~ident & (F.col("type") == "text") & F.size("enum").between(2, 8), F.col("enum"))
    suggest = (
        F.when(ident, "主键/标识列，不参与属性或枚举映射").when(kinds.isNotNull(), F.concat(F.lit("枚举值: "), F.array_join(F.slice(kinds, 1, 6), "、")))
        .when(F.col("type").isin("integer", "float"), F.concat(F.lit("数值列: "), "cn")).otherwise("文本列"))
    return dictionary.select("column", "cn", F.when(ident, "identifier").otherwise(F.col("type")).alias("type"), kinds.alias("enum"), suggest.alias("suggest"))


#: Column words of the sections of a lexicon. Fixed values.
STATUS_WORDS = ("status", "状态")
ZONE_WORDS = ("workshop", "车间", "zone", "区域", "产线")
NAME_WORDS = ("名称", "客户", "产品名", "name")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(c).contains(w)
    return out


def _sections(draft: DataFrame) -> DataFrame:
    """Draft entries other than identifiers: column, cn, type, local, and the values of columns that are kinds."""
    kinds = F.col("enum").isNotNull() & (F.size("enum") > 0) & ~_any(F.col("column"), NAME_WORDS)
    section = F.when(_any(F.col("column"), STATUS_WORDS), "status").when(_any(F.col("column"), ZONE_WORDS), "zone").otherwise("type")
    return draft.where("type != 'identifier'").select(
        "column", "cn", "type", local_name(F.col("column")).alias("local"), F.when(kinds, F.col("enum")).alias("kinds"), section.alias("section"))


def factory_lexicon(draft: DataFrame, table: str, entity_cn: str) -> DataFrame:
    """(section, key, value) from a lexicon draft: attribute names both ways, numeric fields, the values of type, status
    and zone columns with an English proposal, the fields these come from, and the entity's own name."""
    rows = _sections(draft)
    none = F.lit(None).cast("string")
    one = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
    plain = F.filter(F.array(
        one("attr_cn2en", F.col("cn"), F.col("local")), one("attr_en2cn", F.col("local"), F.col("cn")),
        one("numeric_fields", F.when(F.col("type").isin("integer", "float"), F.col("cn")).otherwise(none), F.col("local"))), lambda x: x["key"].isNotNull())
    values = F.flatten(F.transform("kinds", lambda v: F.array(
        F.struct(F.concat("section", F.lit("_cn2en")).alias("section"), v.alias("key"), v.alias("value")), one("value_en_suggest", v, enum_en_suggest(v)["en"]))))
    found = F.when(F.col("kinds").isNull(), plain).otherwise(F.concat(values, F.array(one("value_fields", F.col("local"), F.col("cn")))))
    entity = draft.sparkSession.createDataFrame([("entity_cn2en", entity_cn, table)], "section string, key string, value string")
    return rows.select(F.explode(found).alias("x")).select("x.*").unionByName(entity)


def review_items(draft: DataFrame) -> DataFrame:
    """(item_type, key, value) for people to confirm: each value of a kind, and each other column's name."""
    item = lambda kind, key, value: F.struct(F.lit(kind).alias("item_type"), key.alias("key"), value.alias("value"))
    kinds = F.transform("kinds", lambda v: item("type_enum", v, F.col("cn")))
    return _sections(draft).select(F.explode(F.coalesce(kinds, F.array(item("attr_mapping", F.col("cn"), F.col("local"))))).alias("x")).select("x.*")
