"""Column expressions for loosely typed cells: numbers, types, names and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


#: Unicode's white space.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space of any kind on either side; null is empty."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def is_num(c: Column) -> Column:
    """The cell reads as a finite decimal number. Signs and exponents count, NaN and infinity don't."""
    return F.coalesce(c.cast("string").rlike(NUMBER), F.lit(False))


def as_num(c: Column) -> Column:
    return F.when(is_num(c), F.trim(c.cast("string")).try_cast("double"))


def guess_type(c: Column, empty: str = "missing") -> Column:
    v = strip(c)
    return (
        F.when(v == "", F.lit(empty)).when(v.rlike(r"^-?[0-9]+$"), "integer").when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), "float")
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date").otherwise("text")
    )


def local_name(c: Column) -> Column:
    """The last word of a column name."""
    parts = F.regexp_extract_all(F.regexp_replace(strip(c), r"[_\s]+", " "), F.lit(r"([A-Za-z0-9一-龥]+)"), 1)
    return F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), c)


def safe_name(c: Column) -> Column:
    """A name of word characters and CJK only; all else becomes one underscore."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"[^0-9A-Za-z_一-龥]+", "_"), "^_+|_+$", "")


#: Words by which a column's role is told, in the order of the checks. Fixed values.
ID_NAMES = ("id", "udi", "serial_no")
NUMERIC_WORDS = (
    "qty", "count", "value", "amount", "price", "temp", "power", "speed", "vibration", "rate", "量", "率", "数", "度", "额",
)
ENTITY_NAMES = ("device", "equipment", "product", "sensor")
MEASURE_WORDS = ("unit", "measure", "mm", "kw", "c", "单位")
FLAG_NAMES = ("is_", "enabled", "active", "flag", "开关")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def semantic_role(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.isin(*ID_NAMES) | low.endswith("_id") | low.endswith("编号"), "id")
        .when(low.contains("status") | c.contains("状态"), "status")
        .when(low.contains("type") | c.contains("类型") | c.contains("型号"), "type")
        .when(_holds(low, NUMERIC_WORDS), "numeric")
        .when(low.isin(*ENTITY_NAMES) | c.contains("设备"), "entity")
        .when(_holds(low, MEASURE_WORDS), "measure")
        .when(low.isin(*FLAG_NAMES), "flag")
        .otherwise("attribute")
    )


#: Column words and their Chinese names. Fixed values.
FIELD_NAMES = {
    "id": "编号", "name": "名称", "type": "类型", "status": "状态", "temp": "温度", "temperature": "温度", "time": "时间",
    "date": "日期", "power": "功率", "pressure": "压力", "vibration": "振动", "value": "数值", "speed": "速度",
    "humidity": "湿度", "flow": "流量", "count": "数量", "qty": "数量", "remark": "备注", "note": "备注", "desc": "描述",
    "location": "位置", "area": "区域", "device": "设备", "sensor": "传感器", "voltage": "电压", "current": "电流",
}


def field_cn(c: Column) -> Column:
    """The Chinese name of a column from its snake or camel words; the column's own name where no word is known."""
    known = F.create_map(*[F.lit(x) for pair in FIELD_NAMES.items() for x in pair])
    words = F.split(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\s]+", " "), " ")
    joined = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), F.lit(""))), "")
    return F.when(joined == "", c).otherwise(joined)
