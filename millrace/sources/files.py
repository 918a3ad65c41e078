"""Reading and writing files, databases and device messages as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.typed import is_num, strip
from millrace.session import durable

NAME = re.compile(r"[A-Za-z_]\w*")
#: Words and signs that a read-only query must not hold. Fixed values.
WRITES = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "replace", "exec", "call", "attach", "pragma")
FORBIDDEN = (";", "--", "/*", "'", '"')
TABLE_PREFIXES = ("factory_", "tbl_", "T_")


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header and, if there is one, a byte-order mark; all columns are strings."""
    return spark.read.csv(path if isinstance(path, str) else list(path), header=True, inferSchema=False, multiLine=False)


def read_csv_stream(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """A folder of CSV files as a stream of string columns."""
    return spark.readStream.schema(StructType([StructField(c, StringType()) for c in columns])).option("header", True).csv(folder)


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def check_select(sql: str) -> str:
    """A guard for query arguments: one SELECT without writes, comments, quotes or a second statement."""
    low = sql.strip().lower()
    if not low.startswith("select") or any(x in low for x in FORBIDDEN) or set(re.findall(r"[a-z_]+", low)) & set(WRITES):
        raise ValueError("only a plain SELECT is allowed")
    return sql.strip()


def jdbc_options(url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, **more: str) -> dict[str, str]:
    """Options of spark.read.format("jdbc"); `partition` is (column, lower, upper, number) for parallel reads."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    options = {"url": url, **more}
    options |= {"dbtable": check_name(table)} if table else {"query": check_select(query)}
    if partition:
        if query:
            raise ValueError("a query can't be read in partitions; name a table")
        column, low, high, n = partition
        options |= {"partitionColumn": check_name(column), "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    return options


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **more: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table=table, partition=partition, **more)).load()


def read_jdbc_query(spark: SparkSession, url: str, query: str, **more: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query=query, **more)).load()


#: Buckets that the database counts for each partition wanted, and rounds in which it counts full ones again.
BUCKETS = 16
ROUNDS = 8


def balanced_ranges(count: Callable[[int, int, int], list[tuple[int, int]]], low: int, high: int, total: int, parts: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of a whole-number key, together low..high, with about total / parts rows each.

    count(from, to, width) gives (bucket, rows) of the buckets of that width from `from` on. Buckets with more than half
    of a part's rows are counted again in finer ones, as long as they can be."""
    width = max(1, -(-(high + 1 - low) // (parts * BUCKETS)))
    todo, known = [(low, high + 1, width)], []
    most = max(1, total // (2 * parts))
    for _ in range(ROUNDS):
        finer = []
        for begin, end, step in todo:
            for bucket, n in count(begin, end, step):
                at = begin + bucket * step
                if n > most and step > 1:
                    finer.append((at, min(at + step, end), max(1, -(-step // (parts * BUCKETS)))))
                else:
                    known.append((at, n))
        todo = finer
        if not todo:
            break
    known += [(begin, most + 1) for begin, _, _ in todo]  # as fine as the rounds go
    cuts, held = [low], 0
    for at, n in sorted(known):
        if held and held + n > total / parts + most / 2:
            cuts.append(at)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], high + 1]))


def jdbc_predicates(spark: SparkSession, url: str, table: str, column: str, parts: int, **more: str) -> list[str]:
    """Conditions on a whole-number column that cut a table in about `parts` pieces of like size, whatever its distribution.

    The database tells the least and greatest key and counts rows by range; a key without a value goes with the first
    piece. Only these counts, at most a few hundred for each part, come to the driver. A single key with many rows is a
    piece of its own, as a condition can't split it."""
    table, column = check_name(table), check_name(column)
    ask = lambda sql: read_jdbc_query(spark, url, sql, **more).collect()
    low, high, total = ask(f"SELECT MIN({column}) AS a, MAX({column}) AS b, COUNT({column}) AS n FROM {table}")[0]
    if not total:
        return ["1 = 1"]

    def count(begin: int, end: int, width: int) -> list[tuple[int, int]]:
        rows = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT ({column} - ({begin})) / {width} AS b FROM {table} WHERE {column} >= {begin} AND {column} < {end}) x GROUP BY b")
        return [(int(r[0]), int(r[1])) for r in rows]

    ranges = balanced_ranges(count, int(low), int(high), int(total), parts)
    return [f"({column} >= {a} AND {column} < {b})" + (f" OR {column} IS NULL" if i == 0 else "") for i, (a, b) in enumerate(ranges)]


def read_jdbc_balanced(spark: SparkSession, url: str, table: str, column: str, parts: int, **more: str) -> DataFrame:
    """A table in pieces of like size, read side by side: see `jdbc_predicates`."""
    predicates = jdbc_predicates(spark, url, table, column, parts, **more)
    return spark.read.jdbc(url, check_name(table), predicates=predicates, properties=dict(more))


#: Rows of a range of the order, of which a page reads those it lies in.
RANGE_ROWS = 1_000_000
#: Ranges of a table at most, as each costs the driver a sample and a folder. Those of larger tables hold more rows.
MOST_RANGES = 1000


class Pages:
    """A table cut in ranges of an order, written once, of which any page is read by itself: `rows(limit, offset)`.

    How many rows lie before each range is counted once. A page reads only the ranges that it lies in, and only numbers
    their rows; nothing before it is read or sent anywhere."""

    def __init__(self, df: DataFrame, order: Sequence[str | Column], range_rows: int = RANGE_ROWS):
        ranges = min(MOST_RANGES, max(1, -(-df.count() // range_rows)))
        self.order, self.columns = list(order), df.columns
        # The order's columns are those of the table; the range is the folder that a row is written in.
        placed = df.repartitionByRange(ranges, *self.order).withColumn("__range", F.spark_partition_id())
        self.table = durable(placed, "pages", partition_by="__range")
        sizes = self.table.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
        self.sizes = durable(sizes.withColumn("before", F.sum("n").over(Window.orderBy("__range")) - F.col("n")), "page_sizes")  # a row for each range

    def rows(self, limit: int, offset: int = 0) -> DataFrame:
        met = self.sizes.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        before = {r["__range"]: r["before"] for r in met.collect()}  # as many as the page has ranges
        inside = F.row_number().over(Window.partitionBy("__range").orderBy(*self.order))
        starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
        rows = self.table.where(F.col("__range").isin(list(before))).withColumn("__place", inside + F.element_at(starts, F.col("__range")))
        return rows.where((F.col("__place") > offset) & (F.col("__place") <= offset + limit)).orderBy("__place").select(*self.columns)


def paginate(df: DataFrame, order: Sequence[str | Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit in order; without a limit the offset doesn't count. For many pages of one table keep `Pages`."""
    return df if limit is None else Pages(df, order).rows(limit, offset)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the catalogue's tables; none where the database isn't known."""
    if database is not None and not spark.catalog.databaseExists(database):
        return []
    return sorted(t.name for t in spark.catalog.listTables(database))


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, columns matched by name, nulls where one lacks a column."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def entity_name(table: str) -> str:
    for prefix in TABLE_PREFIXES:
        table = table.removeprefix(prefix)
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[_\W]+", table) if w)


def load_tables(spark: SparkSession, files: Mapping[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """CSV files by table name, and a catalogue (table, entity, key, columns); the key is `id` or the first column."""
    tables = {name: read_csv(spark, path) for name, path in files.items()}
    rows = [(n, entity_name(n), "id" if "id" in df.columns else df.columns[0], df.columns) for n, df in tables.items()]
    return tables, spark.createDataFrame(rows, "table string, entity string, key string, columns array<string>")


POINT = "struct<device:string,metric:string,value:string,ts:string>"


def parse_points_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """(device, metric, value, ts) from lines of JSON: a point, an array of points, or {device: {metric: value}}."""
    text = F.trim(F.col(column))
    one = F.from_json(text, POINT)
    many = F.from_json(text, f"array<{POINT}>")
    nested = F.from_json(text, "map<string,map<string,string>>")
    flat = F.flatten(F.transform(F.map_entries(nested), lambda d: F.transform(F.map_entries(d["value"]), lambda m: F.struct(
        d["key"].alias("device"), m["key"].alias("metric"), m["value"].alias("value"), F.lit(None).cast("string").alias("ts")))))
    points = F.when(text.startswith("["), many).when(one["metric"].isNotNull(), F.array(one)).otherwise(flat)
    return lines.select(F.explode(points).alias("p")).select("p.*")


def parse_points_kv(lines: DataFrame, column: str = "value") -> DataFrame:
    """(device, metric, value, ts) from lines of `key=value` parted by blanks."""
    kv = F.str_to_map(F.regexp_replace(F.trim(F.col(column)), r"\s+", " "), F.lit(" "), F.lit("="))
    get = lambda *names: F.coalesce(*[F.try_element_at("kv", F.lit(n)) for n in names])
    return lines.select(kv.alias("kv")).select(get("device", "device_id").alias("device"), get("metric").alias("metric"), get("value").alias("value"), get("ts").alias("ts"))


def validate_points(points: DataFrame) -> DataFrame:
    """Points with `number` and `valid`: a device, a metric and a numeric value. Invalid ones are for a quarantine."""
    ok = is_num(F.col("value")) & (F.coalesce("device", F.lit("")) != "") & (F.coalesce("metric", F.lit("")) != "")
    return points.withColumns({"number": F.when(is_num(F.col("value")), F.trim(F.col("value").cast("string")).try_cast("double")), "valid": ok})


def read_markdown_lines(spark: SparkSession, folder: str, names: str = "*.md") -> DataFrame:
    """(h, text): the distinct lines of 8 to 280 characters of all Markdown files under a folder."""
    lines = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).text(folder).select(strip(F.col("value")).alias("text"))
    return lines.where(F.length("text").between(8, 280)).withColumn("h", F.substring(F.sha2("text", 256), 1, 16)).dropDuplicates(["h"]).select("h", "text")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_markdown_facts(facts: DataFrame, path: str) -> None:
    write_lines(facts.select(F.concat(F.lit("- "), "text").alias("value")), path)


def save_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
