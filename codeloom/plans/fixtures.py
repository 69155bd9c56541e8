"""Source-code fixtures made from the driver's tables, by like rules in Spark and in SQL.

The tables hold prose and orders; rules for code would hardly ever hold on them. So events become lines of
code (a user's events are a file), orders become analyses and line items proposed changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Twelve groups of five lines; a file has lines of one group. Hits and near misses of every rule are among them.
TEMPLATES = (
    "password = \"hunter22\"", "api_key = \"abcd1234\"", "secret = 'abcdefgh'", "q = \"a\" + tbl + \"SELECT\"", "db.execute(\"select \" + x)",
    "el.innerHTML = v", "document.write(v)", "exec(\"ls $HOME\")", "x = eval (y)", "get(\"http://a.example\")",
    "password = \"abc\"", "api_key = \"short\"", "secrets: yes", "\"SELECT\" + tbl", "db.execute(sql)",
    "innerText = v", "document.writeln", "exec(cmd)", "evaluate(y)", "h = MD5(x)",
    "print 'hello'", "for i in xrange(10):", "if d.has_key(k): pass", "except ValueError, e:", "import urllib2",
    "async def run(x):", "    await f(x)", "s = f\"{x} and {y}\"", "if (n := len(a)) > 10: pass", "match command:",
    "var a = 1;", "p.then(function(r) { return r; })", "const f = (x) => { return x }", "var r = require('fs');", "A.prototype.m = 1;",
    "public class Main {", "ArrayList list = new ArrayList();", "System.out.println(1);", "@Override public void run() {", "List<String> l = Optional.empty();",
    "package main", "func main() {", "fmt.Println(1)", "x := 3", "return nil",
    "fn main() {", "let mut n = 0;", "#include <stdio.h>", "#include <vector>", "int f(void);",
    "subprocess.call(c, shell=True)", "d = pickle.load(f)", "h = hashlib.md5(b)", "assert x == 1", "s = '%d' % (a) % b",
    "AKEY1234567890ABCDEFAKEY1234567890ABCDEF", "ghp_abcdefghijklmnopqrstuvwxyz0123456789", "sk-abcdefghijklmnopqrstuvwxyz012345", "password: longenough", "password: short",
)
EXTENSIONS = (".py", ".js", ".java", ".go", ".rs", ".h", ".txt", "", ".tar.TS", ".R", ".rb", ".kt", ".sql")
LANGUAGES = ("Python", "JavaScript", "Java", "Go", "COBOL")
TYPES = (
    "print_statement", "xrange_usage", "urllib2_usage", "promise_chain", "var_declaration", "raw_type", "arrow_function", "has_key_removal", "class_inheritance",
    "optional_usage", "error_wrapping", "unheard_of",
)
STATUSES = ("validated", "manual_required", "validation_failed", "pending", "accepted", "skipped", "validated")
RISKS = ("LOW", "MEDIUM", "HIGH")
CODES = (("print 'hello'", "print( 'hello' )"), ("xrange(10)", "range(10)"), ("var ", "const "), ("new Integer(", "Integer.valueOf("), ("a", "b"), ("", "x"))
LAYERS = ("language_detector", "ast_parser", "security_scanner", "reader_agent", "complete", "unheard_of")
MODULES = ("os", "os.path", "requests", "utils", ".models", "my-lib", "Capital", "java.util.List", "audio", "http.client", "sqlite3", "a.b", "numbers_1234567890_1234567890x")
OUTPUTS = (
    ("pytest", "5 passed, 2 failed in 1s", 1), ("pytest", "no tests", 0), ("unittest", "3 failed, 1 error", 1), ("jest", "Tests:   7 passed, 1 failed", 1), ("jest", "7 passed", 0),
    ("junit", "Tests run: 10, Failures: 3, Errors: 0", 1), ("mocha", "4 passing", 0), ("mocha", "boom", 2),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: Sequence[object], n: Column) -> Column:
    """The value at a number, counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def quote(value: object) -> str:
    """A value as an SQL literal."""
    return "NULL" if value is None else str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def sql_pick(values: Sequence[object], n: str) -> str:
    """:func:`pick` in SQL."""
    return f"[{', '.join(map(quote, values))}][CAST({n} AS INTEGER) + 1]"


def sql_values(rows: Sequence[Sequence[object]]) -> str:
    """Rows as an SQL VALUES list."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, line_no, line)`` from events."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.col("event_id") % 5 + 5 * (F.col("user_id") % 12)
    return e.select(F.col("user_id").alias("file_id"), n.alias("line_no"), pick(TEMPLATES, k).alias("line"))


SQL_LINES = f"""code_lines AS (
  SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS line_no,
    {sql_pick(TEMPLATES, "event_id % 5 + 5 * (user_id % 12)")} AS line FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(analysis_id, file_idx, path, content)``: a file with every line for each of :func:`code_lines`."""
    rows = code_lines(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    path = F.concat(F.lit("src/f"), "file_id", pick(EXTENSIONS, F.col("file_id") % len(EXTENSIONS)))
    return rows.select((F.col("file_id") % 20).cast("string").alias("analysis_id"), F.col("file_id").cast("int").alias("file_idx"), path.alias("path"), text.alias("content"))


SQL_FILES = f"""{SQL_LINES}, files AS (
  SELECT CAST(file_id % 20 AS VARCHAR) AS analysis_id, CAST(file_id AS INTEGER) AS file_idx,
    concat('src/f', file_id, {sql_pick(EXTENSIONS, f"file_id % {len(EXTENSIONS)}")}) AS path, string_agg(line, chr(10) ORDER BY line_no) AS content
  FROM code_lines GROUP BY file_id)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses from orders."""
    o = read(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return o.select(
        n.alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), pick((*LANGUAGES[:4], None), n % 5).alias("language"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "pending").otherwise("complete").alias("status"),
        pick(("HIGH", "MEDIUM", "LOW", None), n % 4).alias("overall_risk"), F.when(n % 7 > 0, F.concat(F.lit("Repo-"), n % 50)).alias("source_name"),
    )


SQL_ANALYSES = f"""analyses AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, {sql_pick((*LANGUAGES[:4], None), "o_orderkey % 5")} AS language,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' ELSE 'complete' END AS status, {sql_pick(("HIGH", "MEDIUM", "LOW", None), "o_orderkey % 4")} AS overall_risk,
    CASE WHEN o_orderkey % 7 > 0 THEN concat('Repo-', o_orderkey % 50) END AS source_name FROM orders)"""

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed changes from line items."""
    item = read(spark, sf_dir, "lineitem")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    return item.select(
        order.alias("analysis_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1).alias("ord"), pick(LANGUAGES, order % 5).alias("language"),
        pick(TYPES, part % 12).alias("issue_type"), pick([a for a, _ in CODES], part % 6).alias("old_code"), pick([b for _, b in CODES], part % 6).alias("new_code"),
        pick(STATUSES, F.col("l_suppkey") % 7).alias("status"), pick(RISKS, F.col("l_suppkey") % 3).alias("risk_level"),
        F.when(part % 5 > 0, F.concat(F.lit("why "), part % 9)).alias("reason"), F.concat(F.lit("what "), part % 11).alias("description"),
        F.col("l_discount").alias("confidence"), F.col("l_linenumber").cast("int").alias("callers_affected"),
    )


SQL_CHANGES = f"""changes AS (
  SELECT l_orderkey AS analysis_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS INTEGER) AS ord,
    {sql_pick(LANGUAGES, "l_orderkey % 5")} AS language, {sql_pick(TYPES, "l_partkey % 12")} AS issue_type, {sql_pick([a for a, _ in CODES], "l_partkey % 6")} AS old_code,
    {sql_pick([b for _, b in CODES], "l_partkey % 6")} AS new_code, {sql_pick(STATUSES, "l_suppkey % 7")} AS status, {sql_pick(RISKS, "l_suppkey % 3")} AS risk_level,
    CASE WHEN l_partkey % 5 > 0 THEN concat('why ', l_partkey % 9) END AS reason, concat('what ', l_partkey % 11) AS description,
    l_discount AS confidence, CAST(l_linenumber AS INTEGER) AS callers_affected FROM lineitem)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-file results from line items: some didn't come far."""
    item = read(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    some = lambda n, value: F.when(part % n > 0, value)
    return item.select(
        F.col("l_orderkey").alias("analysis_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1).alias("file_idx"), pick(LANGUAGES, part % 5).alias("language"),
        F.concat(F.lit("era "), part % 3).alias("era"), some(4, part % 6).alias("n_issues"), (F.col("l_suppkey") % 3).alias("n_findings"), some(3, (part % 100).cast("double")).alias("minimality_score"),
        some(5, (part % 8).cast("double")).alias("avg_complexity"), some(2, (60 + part % 41).cast("int")).alias("confidence_score"), some(7, (part % 4) * F.lit(0.25)).alias("hours_saved"),
        some(6, part % 10 == 1).alias("regression"), some(6, part % 12).alias("tests_passed"), pick(("HIGH", "MEDIUM", "LOW", "", None, "odd"), (part * 7 + F.col("l_linenumber")) % 6).alias("overall_risk"),
    )


SQL_RESULTS = f"""results AS (
  SELECT l_orderkey AS analysis_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS INTEGER) AS file_idx,
    {sql_pick(LANGUAGES, "l_partkey % 5")} AS language, concat('era ', l_partkey % 3) AS era, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 6 END AS n_issues,
    l_suppkey % 3 AS n_findings, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 100 AS DOUBLE) END AS minimality_score,
    CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 8 AS DOUBLE) END AS avg_complexity, CASE WHEN l_partkey % 2 > 0 THEN 60 + l_partkey % 41 END AS confidence_score,
    CASE WHEN l_partkey % 7 > 0 THEN (l_partkey % 4) * 0.25::DOUBLE END AS hours_saved, CASE WHEN l_partkey % 6 > 0 THEN l_partkey % 10 = 1 END AS regression,
    CASE WHEN l_partkey % 6 > 0 THEN l_partkey % 12 END AS tests_passed, {sql_pick(("HIGH", "MEDIUM", "LOW", "", None, "odd"), "(l_partkey * 7 + l_linenumber) % 6")} AS overall_risk FROM lineitem)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer events from events: starts and ends of layers of a user's analysis."""
    e = read(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = e.withColumn("seq", n.cast("long"))
    return x.select(
        F.col("user_id").cast("string").alias("analysis_id"), F.when(F.col("event_id") % 3 == 0, "layer_end").otherwise("layer_start").alias("type"),
        pick(LAYERS, F.col("event_id") % 5 % 3).alias("layer"), F.when(F.col("event_id") % 12 == 0, "error").when(F.col("event_id") % 3 == 0, "success").alias("status"),
        F.col("event_id").alias("duration_ms"), F.col("ts").cast("timestamp").alias("ts"), F.lit("f").alias("file"), "seq",
    )


SQL_TRACE = f"""trace AS (
  SELECT CAST(user_id AS VARCHAR) AS analysis_id, CASE WHEN event_id % 3 = 0 THEN 'layer_end' ELSE 'layer_start' END AS type, {sql_pick(LAYERS, "event_id % 5 % 3")} AS layer,
    CASE WHEN event_id % 12 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'success' END AS status, event_id AS duration_ms, ts, 'f' AS file,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes from parts: who is defined where, and what they call."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    called = F.filter(F.array(F.concat(F.lit("fn"), k % 37), F.concat(F.lit("fn"), k % 53, F.lit(".go")), F.concat(F.lit("fn"), k % 37)), lambda c: (F.length(c) + k) % 3 > 0)
    return p.select(
        (k % 10).cast("string").alias("analysis_id"), (k % 17).cast("int").alias("file_idx"), F.concat(F.lit("m"), k % 17, F.lit(".py")).alias("path"), (k % 4 == 0).cast("int").alias("kind"),
        k.alias("ord"), F.concat(F.lit("fn"), k % 61).alias("name"), (k % 9 > 0).alias("is_public"), called.alias("calls"),
    )


SQL_SYMBOLS = """symbols AS (
  SELECT CAST(p_partkey % 10 AS VARCHAR) AS analysis_id, CAST(p_partkey % 17 AS INTEGER) AS file_idx, concat('m', p_partkey % 17, '.py') AS path, CAST(p_partkey % 4 = 0 AS INTEGER) AS kind,
    p_partkey AS ord, concat('fn', p_partkey % 61) AS name, p_partkey % 9 > 0 AS is_public,
    list_filter([concat('fn', p_partkey % 37), concat('fn', p_partkey % 53, '.go'), concat('fn', p_partkey % 37)], lambda c : (length(c) + p_partkey) % 3 > 0) AS calls FROM part)"""
