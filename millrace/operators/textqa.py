"""Checks of texts: wording, punctuation, rhythm, personal data, and numeric claims against source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.typed import as_num, is_num
from millrace.operators.automaton import find_terms

#: Terms by layer: (layer, kind, severity, terms). Fixed values.
LEXICON = (
    ("D1", "variant", "warn", ("交待", "必恭必敬", "当做", "缘份", "澈底", "谋画", "胡涂", "含意", "人材", "思惟", "制做", "抹煞", "想像", "联贯", "彷佛", "归根结柢", "装璜", "跌荡", "故技重演")),
    ("D1", "typo", "warn", ("必需", "做为", "帐本", "座落", "寒喧", "精萃", "幅射", "振撼", "痉孪", "决窍", "脉博", "装祯", "渡假", "按排", "既使", "既而", "以经", "利害关系", "做为一个")),
    ("D5", "banned", "fail", ("底层逻辑", "赋能", "闭环", "长期主义", "关键抓手", "价值沉淀", "认知升级", "说白了", "本质上", "综上所述", "值得注意的是", "不难发现", "无需多言", "归根结底", "众所周知", "显然", "毫无疑问", "某种意义上", "抓手", "破局", "降维打击", "第二曲线", "飞轮", "北极星指标", "颗粒度", "同理可得", "打个比方", "毫不夸张地说")),
    ("D5", "meta", "warn", ("写在最后", "结语", "让我们讨论", "总而言之", "在深入探讨之前", "接下来", "言归正传")),
    ("D5", "opener", "warn", ("在当今时代", "随着……发展", "众所周知", "毋庸置疑", "进入新世纪", "随着科技的进步")),
    ("D5", "verb", "info", ("进行", "实现", "达到", "提升", "降低", "增加", "减少", "拥有", "属于", "涉及", "相关的", "所谓的")),
)
#: What to write instead of variants and typing errors. Fixed values.
SUGGESTIONS = {
    "必需": "必须", "做为": "作为", "帐本": "账本", "座落": "坐落", "寒喧": "寒暄", "精萃": "精粹", "幅射": "辐射", "振撼": "震撼",
    "痉孪": "痉挛", "决窍": "诀窍", "脉博": "脉搏", "装祯": "装帧", "渡假": "度假", "按排": "安排", "既使": "即使", "既而": "继而",
    "以经": "已经", "利害关系": "厉害关系", "做为一个": "作为一个",
    "交待": "交代", "必恭必敬": "毕恭毕敬", "当做": "当作", "缘份": "缘分", "澈底": "彻底", "谋画": "谋划", "胡涂": "糊涂", "含意": "含义",
    "人材": "人才", "思惟": "思维", "制做": "制作", "抹煞": "抹杀", "想像": "想象", "联贯": "连贯", "彷佛": "仿佛", "归根结柢": "归根结底",
    "装璜": "装潢", "跌荡": "跌宕", "故技重演": "故伎重演",
}
#: Patterns by layer: (layer, kind, severity, pattern). Fixed values.
PATTERNS = (
    ("D2", "half_punct", "fail", r"[一-鿿][,.;:!?](?=[一-鿿])"),
    ("D2", "mixed_punct", "fail", r"[一-鿿][,.;:!?]"),
    ("D2", "english_quotes", "fail", r'[一-鿿]"[^"]{1,20}"'),
    ("D3", "missing_subject", "fail", r"通过[^。，；]{2,30}(使|让|令)"),
    ("D3", "prepositional_opening", "fail", r"^(经过|随着|由于)[^。]{5,40}(终于|才|便)"),
    ("D3", "improve_level", "fail", r"改善[^。]{0,8}(水平|程度)"),
    ("D3", "raise_quantity", "fail", r"提高[^。]{0,8}(数量)"),
    ("D3", "because_reason", "fail", r"是因为[^。]{0,15}的原因"),
    ("D3", "purpose_for", "fail", r"目的是为了"),
    ("D3", "due_caused", "fail", r"由于[^。]{0,20}所致"),
    ("D3", "about_around", "fail", r"大约[^。]{0,10}左右"),
    ("D3", "almost_all", "fail", r"几乎[^。]{0,10}(全部|都)"),
    ("D3", "key_lies", "fail", r"关键在于[^。]{0,10}在于"),
    ("D3", "carry_out", "fail", r"对[^。]{2,30}进行(了)?$"),
    ("D4", "date_format", "warn", r"[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"),
    ("D4", "tilde_range", "warn", r"[0-9]+~[0-9]+"),
    ("D4", "mixed_digits", "warn", r"[一-鿿][0-9]+|(?<![0-9])[0-9]+[一-鿿]"),
    ("D5", "not_but", "warn", r"不是[^。，]{1,20}而是"),
    ("D5", "from_to", "warn", r"从[^。，]{1,10}到[^。，]{1,10}"),
    ("D5", "not_only", "warn", r"不仅[^。，]{1,20}更是"),
    ("D5", "ordinals", "warn", r"首先|其次|最后|第一|第二|第三"),
    ("D5", "vague_tools", "warn", r"AI工具|某个模型|相关技术|一些方法"),
    ("D5", "made_up_case", "warn", r"比如有一次|假设你|想象一下"),
    ("D5", "dash", "fail", r"——|—{1,2}|–{1,2}"),
)
CONNECTIVES = ("然而", "此外", "同时", "因此", "总之", "综上", "进而", "从而", "并且", "而且", "再者", "换言之")


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", "")


def _count(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def scan_terms(docs: DataFrame, lexicon: Sequence[tuple[str, str, str, Sequence[str]]] = LEXICON) -> DataFrame:
    """(doc, layer, kind, severity, term, count, suggestion) of each term that a text (doc, text) holds.

    All terms are found in one reading of a text, however many they are; what is found is joined with the lexicon."""
    entries = docs.sparkSession.createDataFrame(
        [(a, k, s, t, SUGGESTIONS.get(t)) for a, k, s, ts in lexicon for t in ts], "layer string, kind string, severity string, term string, suggestion string")
    found = find_terms(docs.select("doc", without_code(F.col("text")).alias("text")), entries, "doc")
    return found.join(F.broadcast(entries), "term").select("doc", "layer", "kind", "severity", "term", "count", "suggestion")  # the lexicon's rows


def scan_patterns(docs: DataFrame, patterns: Sequence[tuple[str, str, str, str]] = PATTERNS) -> DataFrame:
    """(doc, layer, kind, severity, term, count): how often each pattern matches; term is the first match."""
    text = F.col("text")
    issue = lambda a, k, s, p: F.struct(F.lit(a).alias("layer"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_extract(text, p, 0).alias("term"), F.regexp_count(text, F.lit(p)).cast("long").alias("count"))
    # Most patterns are in no text: those are looked for once, and only what is there is taken out and counted. An empty
    # match counts too, so the count decides at last.
    found = [F.when(text.rlike(p), issue(a, k, s, p)) for a, k, s, p in patterns]
    rows = docs.select("doc", without_code(F.col("text")).alias("text"))
    return rows.select("doc", F.explode(F.array(*found)).alias("x")).where(F.col("x").isNotNull()).select("doc", "x.*").where("count > 0")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[。！？!?；]"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def scan_rhythm(docs: DataFrame) -> DataFrame:
    """(doc, layer D6, kind, severity, term, count): long paragraphs, flat sentences, connectives, openings."""
    rows = docs.select("doc", F.length(F.coalesce("text", F.lit(""))).alias("chars"), without_code(F.col("text")).alias("text"))
    rows = rows.withColumn("lens", F.transform(sentences(F.col("text")), lambda s: F.length(s)))
    long = F.size(F.filter(F.split("text", "\n"), lambda p: F.length(p) > 400)).cast("long")
    three = lambda i: F.array(F.get("lens", i), F.get("lens", i + 1), F.get("lens", i + 2))
    flat = F.when(F.size("lens") >= 3, F.exists(F.sequence(F.lit(0), F.size("lens") - 3), lambda i: (F.array_max(three(i)) - F.array_min(three(i)) < 5) & (F.array_max(three(i)) > 10))).otherwise(F.lit(False))
    links = sum((_count(F.col("text"), c) for c in CONNECTIVES), F.lit(0).cast("long"))
    dense = (F.size("lens") > 0) & (links / F.size("lens") > 0.3)
    opening = (F.col("chars") > 150) & ~F.substring("text", 1, 100).rlike(r"[0-9]|结果|结论|是|%|倍|万|亿")
    issue = lambda kind, severity, n: F.struct(F.lit("D6").alias("layer"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit("").alias("term"), n.cast("long").alias("count"))
    found = F.array(issue("long_paragraph", "warn", long), issue("flat_rhythm", "warn", flat.cast("int")), issue("dense_connectives", "warn", F.when(dense, links).otherwise(0)), issue("late_conclusion", "info", opening.cast("int")))
    return rows.select("doc", F.explode(F.filter(found, lambda x: x["count"] > 0)).alias("x")).select("doc", "x.*")


def text_scan(docs: DataFrame, lexicon: Sequence[tuple[str, str, str, Sequence[str]]] = LEXICON, patterns: Sequence[tuple[str, str, str, str]] = PATTERNS) -> DataFrame:
    """Per text and layer: issues, fails, warns and whether the layer passed; texts without issues have no row."""
    every = scan_terms(docs, lexicon).drop("suggestion").unionByName(scan_patterns(docs, patterns)).unionByName(scan_rhythm(docs))
    per = every.groupBy("doc", "layer").agg(
        F.sum("count").alias("count"), F.sum(F.when(F.col("severity") == "fail", F.col("count")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("severity") == "warn", F.col("count")).otherwise(0)).alias("warns"))
    return per.withColumn("passed", F.col("fails") == 0)


#: Not behind a sign of a word. The literal sign of two code units (a letter, so a word's sign as it is) lets Java look at
#: whole signs behind; without one it sees half of such a sign, which is none of a word.
NO_WORD_BEFORE = "(?<![\\w\U00010000])"
#: Personal data in the order in which it is masked. Fixed values.
SECRETS = (
    ("IP", r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"),
    ("PHONE", r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"),
    ("TEL", r"(?<![0-9])0[0-9]{2,3}-?[0-9]{7,8}(?![0-9])"),
    ("EMAIL", "(?U)" + NO_WORD_BEFORE + r"[\w.+-]+@[\w-]+\.[\w.]+(?!\w)"),
    ("AMOUNT", r"[¥￥]\s*[0-9][0-9,]*\.?[0-9]*\s*(?:万|亿|元|万元|亿元)?"),
    ("ID", r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"),
    ("DOMAIN", "(?U)" + NO_WORD_BEFORE + r"(?:[a-z0-9-]+\.)+[a-z]{2,}(?!\w)"),
    ("SERIAL", r"(?<![0-9])[0-9]{10,}(?![0-9])"),
)

#: What a text with a match of the kind holds for sure; most texts don't, and it is found many times faster than the match.
SIGNS = {
    "IP": r"\.[0-9]{1,3}\.[0-9]", "PHONE": "[0-9]{7}", "TEL": "[0-9]{7}", "EMAIL": "@", "AMOUNT": "[¥￥]", "ID": "[0-9]{7}", "DOMAIN": r"\.[a-z]{2}", "SERIAL": "[0-9]{7}",
}


def mask_typed(text: Column, words: Sequence[str] = ()) -> Column:
    """The text with `{{TYPE}}` for custom words, then for each kind of personal data in order."""
    out = F.coalesce(text, F.lit(""))
    for w in words:
        out = F.replace(out, F.lit(w), F.lit("{{WORD}}"))
    for name, pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "{{" + name + "}}")
    return out


def mask_pii(text: Column, words: Sequence[str] = ()) -> Column:
    """(masked, mapping): numbered placeholders `{{TYPE_1}}`, ... and what they stand for.

    Each kind is masked on the text that the kinds before left: the text is split at the matches, and the
    pieces are put together again with the numbers between them. Numbers whose placeholder a text has by itself are not given."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    state = F.struct(F.coalesce(text, F.lit("")).alias("masked"), empty.alias("mapping"))

    def mask_word(s: Column, w: str, n: int) -> Column:
        mark = F.lit("{{WORD_" + str(n) + "}}")
        hit = s["masked"].contains(w)
        return F.struct(F.replace(s["masked"], F.lit(w), mark).alias("masked"), F.when(hit, F.map_concat(s["mapping"], F.create_map(mark, F.lit(w)))).otherwise(s["mapping"]).alias("mapping"))

    def bind(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def mask_kind(s: Column, name: str, pattern: str) -> Column:
        mark = lambda i: F.concat(F.lit("{{" + name + "_"), i.cast("string"), F.lit("}}"))

        def numbered(m: Column) -> Column:
            # A number whose placeholder the text has by itself is left out, as `unmask` would replace that too.
            own = F.size(F.regexp_extract_all(m["masked"], F.lit(r"\{\{" + name + r"_[0-9]+\}\}"), F.lit(0)))
            free = F.filter(F.sequence(F.lit(1), F.size(m["found"]) + own), lambda i: ~m["masked"].contains(mark(i)))
            return F.when(m["masked"].contains("{{" + name + "_"), F.slice(free, 1, F.size(m["found"]))).otherwise(F.sequence(F.lit(1), F.size(m["found"])))

        def woven(m: Column, marks: Column) -> Column:
            masked = F.array_join(F.zip_with(F.split(m["masked"], pattern, -1), marks, lambda p, k: F.concat(p, F.coalesce(k, F.lit("")))), "")
            return F.struct(masked.alias("masked"), F.map_concat(m["mapping"], F.map_from_arrays(marks, m["found"])).alias("mapping"))

        def with_matches(m: Column) -> Column:
            same = F.struct(m["masked"].alias("masked"), m["mapping"].alias("mapping"))
            return F.when(F.size(m["found"]) == 0, same).otherwise(bind(F.transform(numbered(m), mark), lambda marks: woven(m, marks)))

        found = F.when(s["masked"].rlike(SIGNS[name]), F.regexp_extract_all(s["masked"], F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return bind(F.struct(s["masked"].alias("masked"), s["mapping"].alias("mapping"), found.alias("found")), with_matches)

    for n, w in enumerate(words, 1):
        state = mask_word(state, w, n)
    for name, pattern in SECRETS:
        state = _chain(state, name, pattern, mask_kind)
    return state


def _chain(state: Column, name: str, pattern: str, step) -> Column:
    def body(s: Column) -> Column:
        return step(s, name, pattern)

    return F.element_at(F.transform(F.array(state), body), 1)


#: A placeholder as `mask_pii` gives it.
MARK = r"\{\{[A-Z]+_[0-9]+\}\}"


def unmask(text: Column, mapping: Column) -> Column:
    """Placeholders back to what they stand for, in one reading of the text. With others than those of `mask_pii`, one
    reading for each, the longest first."""
    entries = F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    in_turn = F.aggregate(entries, text, lambda t, e: F.replace(t, e["key"], e["value"]))
    values = F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), lambda m: F.coalesce(F.try_element_at(mapping, m), m))
    at_once = F.array_join(F.zip_with(F.split(text, MARK, -1), values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    return F.when(F.size(mapping) == 0, text).when(F.forall(F.map_keys(mapping), lambda k: k.rlike(rf"^{MARK}\z")), at_once).otherwise(in_turn)


NUMBER = r"[-+]?[0-9][0-9,]*\.?[0-9]*"
PERCENT = r"(下降|上升|降低|升高|提升|减少|增加|占比|达到|占用|超|低于|高于|为|是)[^。，；0-9%]{0,6}?\s*([-+]?[0-9][0-9,]*\.?[0-9]*)%"
METRIC = r"[一-鿿]{1,5}(?:温度|振动|功率|内存|压力|流量|转速|数量|数值|值|量|率|占比|度)\s*(?:为|是|达到|达)?\s*[-+]?[0-9][0-9,]*\.?[0-9]*"
EXTREME = r"(?:最大|最高|最小|最低)[一-鿿]{0,4}\s*(?:为|是)?\s*[-+]?[0-9][0-9,]*\.?[0-9]*"
DATE = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
#: Words of metrics and the column names they hint at. Fixed values.
HINTS = {"温度": ("temperature", "temp"), "振动": ("vibration", "vib"), "功率": ("power", "load"), "内存": ("mem", "memory"), "cpu": ("cpu",), "数量": ("count", "num", "qty"), "占比": ("ratio", "pct", "rate"), "台": ("id", "device_id", "count")}


def _amount(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, NUMBER, 0), F.lit(","), F.lit("")).try_cast("double")


def ledger(docs: DataFrame) -> DataFrame:
    """(doc, id, claim, type, value, word, context, trace_id): the claims of texts that can be checked.

    Percentages, numbers with a metric, dates and extremes; claims of a type and value count once a text."""
    text = F.coalesce("text", F.lit(""))
    word = F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1))
    pct = F.regexp_extract_all(text, F.lit(PERCENT), F.lit(2))
    claim = lambda kind, c, value, w: F.struct(F.lit(kind).alias("type"), c.alias("claim"), value.alias("value"), w.alias("word"))
    found = F.concat(
        F.zip_with(word, pct, lambda w, p: claim("percent", F.concat(w, p, F.lit("%")), F.replace(p, F.lit(","), F.lit("")).try_cast("double").cast("string"), w)),
        F.transform(F.regexp_extract_all(text, F.lit(METRIC), F.lit(0)), lambda c: claim("number", c, _amount(c).cast("string"), F.regexp_replace(c, r"\s*(?:为|是|达到|达)?\s*[-+]?[0-9].*$", ""))),
        F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda c: claim("date", c, c, F.lit(""))),
        F.transform(F.regexp_extract_all(text, F.lit(EXTREME), F.lit(0)), lambda c: claim("extreme", c, _amount(c).cast("string"), F.substring(c, 1, 2))))
    flat = docs.select("doc", text.alias("text"), F.posexplode(found).alias("at", "x"))
    first = flat.groupBy("doc", F.col("x.type").alias("type"), F.col("x.value").alias("value")).agg(F.min_by(F.struct("at", "x.claim", "x.word", "text"), "at").alias("f"))
    place = F.instr(F.col("f.text"), F.coalesce(F.regexp_extract("f.claim", NUMBER, 0), F.lit("")))
    context = F.replace(F.substring("f.text", F.greatest(F.lit(1), place - 15), F.length("f.claim") + 30), F.lit("\n"), F.lit(" "))
    ident = F.concat(F.lit("E"), (F.col("f.at") + 1).cast("string"))
    return first.select(
        "doc", ident.alias("id"), F.col("f.claim").alias("claim"), "type", "value", F.col("f.word").alias("word"), context.alias("context"),
        F.concat(ident, F.lit("-"), F.substring(F.sha2(F.col("f.claim"), 256), 1, 6)).alias("trace_id"))


def source_stats(rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(column, place, last, min, max) of the numbers of each source column; last by `order`."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("raw")) for i, c in enumerate(columns)])
    flat = rows.select(F.col(order).alias("o"), F.explode(cells).alias("x")).where(is_num(F.col("x.raw"))).select("o", "x.column", "x.place", as_num(F.col("x.raw")).alias("v"))
    return flat.groupBy("column", "place").agg(F.max_by("v", "o").alias("last"), F.min("v").alias("min"), F.max("v").alias("max"))


def fact_check(claims: DataFrame, rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Claims of `ledger` with status, confidence, column and source_value.

    number: the last number of the hinted column (else of the first with numbers) within max(5, 15 %); percent:
    the last of a ratio column, for words of level; extreme: any column's extreme within max(1, 15 %), else as
    number; date: any cell holds it. The source columns' statistics are a row for each column, joined as one array.
    """
    stats = source_stats(rows, columns, order).agg(F.array_sort(F.collect_list(F.struct("place", "column", "last", "min", "max"))).alias("stats"))
    dates = rows.select(F.explode(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("cell")).select(F.explode(F.regexp_extract_all("cell", F.lit(DATE), F.lit(0))).alias("value")).distinct().withColumn("dated", F.lit(True))
    joined = claims.crossJoin(F.broadcast(stats)).join(dates, "value", "left")  # stats: one row, an entry for each column
    by_hint = F.filter("stats", lambda s: F.coalesce(_hint_match(F.col("word"), s["column"]), F.lit(False)))
    number = F.coalesce(F.get(by_hint, F.lit(0)), F.get("stats", F.lit(0)))
    ratio = F.get(F.filter("stats", lambda s: F.lower(s["column"]).rlike("ratio|pct|rate|占比|率")), F.lit(0))
    value = F.col("value").try_cast("double")
    high = F.col("word").isin("最大", "最高")
    extreme = F.get(F.filter("stats", lambda s: F.abs(F.when(high, s["max"]).otherwise(s["min"]) - value) <= F.greatest(F.lit(1.0), F.when(high, s["max"]).otherwise(s["min"]) * 0.15)), F.lit(0))
    level = F.col("word").isin("占比", "达到", "占用", "为", "是")
    base = joined.select("doc", "id", "claim", "type", "value", "word", number.alias("n"), F.when(level, ratio).alias("r"), extreme.alias("e"), F.coalesce("dated", F.lit(False)).alias("dated"))
    v = F.col("value").try_cast("double")
    off = F.abs(F.col("n.last") - v)
    tol = F.when(F.col("word").rlike("[台个条]"), F.greatest(F.lit(1.0), F.col("n.last") * 0.2)).otherwise(F.greatest(F.lit(5.0), F.col("n.last") * 0.15))
    off_r = F.abs(F.col("r.last") - v)
    verdict = lambda ok: F.when(ok.isNull(), "unsupported").when(ok, "supported").otherwise("contradicted")
    by_number = verdict(off <= tol)
    status = (
        F.when(F.col("type") == "date", F.when(F.col("dated"), "supported").otherwise("unsupported")).when(F.col("type") == "percent", verdict(off_r <= F.greatest(F.lit(5.0), F.col("r.last") * 0.15)))
        .when((F.col("type") == "extreme") & F.col("e").isNotNull(), "supported").otherwise(by_number))
    confidence = (
        F.when(status != "supported", 0.0).when(F.col("type") == "date", 0.8).when(F.col("type") == "percent", F.round(1 - off_r / 100, 2))
        .when((F.col("type") == "extreme") & F.col("e").isNotNull(), 0.9).otherwise(F.round(1 - F.least(F.lit(1.0), off / tol) * 0.5, 2)))
    col = F.when(F.col("type") == "percent", F.col("r.column")).when((F.col("type") == "extreme") & F.col("e").isNotNull(), F.col("e.column")).when(F.col("type") != "date", F.col("n.column"))
    return base.select("doc", "id", "claim", "type", "value", status.alias("status"), confidence.alias("confidence"), col.alias("column"))


def _hint_match(word: Column, column: Column) -> Column:
    low = F.lower(column)
    out = low.contains(F.lower(word)) & (word != "")
    for hint, names in HINTS.items():
        for n in names:
            out = out | (word.endswith(hint) & low.contains(n))
    return out


def fact_check_summary(checked: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    sums = checked.groupBy("doc").agg(F.count(F.lit(1)).alias("total"), n("supported").alias("supported"), n("unsupported").alias("unsupported"), n("contradicted").alias("contradicted"))
    verdict = F.when((F.col("supported") == F.col("total")) & (F.col("total") > 0), "全可溯源").when(F.col("unsupported") > 0, "存在不可溯源声明").when(F.col("contradicted") > 0, "存在矛盾声明").otherwise("无可证伪声明")
    return sums.select("*", verdict.alias("verdict"), ((F.col("total") > 0) & (F.col("contradicted") == 0) & (F.col("unsupported") == 0)).alias("pass"))
