"""Small operators, several to a query, over rows made of parts, customers and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, rules, schemas
from .functions import scalars
from .operators import agents, edits, graph, history, language, risk, rollup, scan, structure, testruns
from .plans import fixtures
from .plans.fixtures import sql_pick
from .registry import query
from .session import small_batches
from .sources import files as sources

# --- views --------------------------------------------------------------------------------------------------------


@query("""SELECT id, name, full_name, private, language, description, default_branch, updated_at, html_url FROM (
  SELECT s_suppkey AS id, concat('Repo-', s_suppkey % 50) AS name, concat('own/', s_name) AS full_name, s_suppkey % 3 = 0 AS private, CASE WHEN s_suppkey % 2 = 0 THEN 'Python' END AS language, s_name AS description,
    'main' AS default_branch, s_suppkey * 7919 % 10007 AS updated_at, concat('https://x.example/', s_suppkey) AS html_url FROM supplier ORDER BY updated_at DESC, id LIMIT 50) WHERE contains(name, '7')""")
def repository_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last updated repositories, of them those with a text in their name (SRC-4, FLT-3)."""
    k = F.col("s_suppkey")
    repos = fixtures.read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("Repo-"), k % 50).alias("name"), F.concat(F.lit("own/"), "s_name").alias("full_name"), (k % 3 == 0).alias("private"), F.when(k % 2 == 0, "Python").alias("language"),
        F.col("s_name").alias("description"), F.lit("main").alias("default_branch"), (k * 7919 % 10007).alias("updated_at"), F.concat(F.lit("https://x.example/"), k).alias("html_url"), F.lit("more").alias("other"),
    )
    return history.repositories(history.recent_repositories(repos), "7")


@query("""SELECT c_custkey AS id, concat('u', c_custkey, '@example.com') AS email, c_name AS name, 'p' AS photo_url, c_mktsegment AS phone, 'google' AS auth_provider, c_custkey % 2 = 0 AS email_reports, 'LOW' AS risk_threshold,
  'dark' AS theme, concat(strftime(make_timestamp(1700000000000000 + c_custkey * 1000000), '%Y-%m-%dT%H:%M:%S'), CASE WHEN c_custkey % 3 = 0 THEN '.250000' ELSE '' END) AS created_at FROM customer""")
def user_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a user (PRJ-1), with microseconds where there are any."""
    k = F.col("c_custkey")
    return history.user_view(fixtures.read(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("u"), k, F.lit("@example.com")).alias("email"), F.col("c_name").alias("name"), F.lit("p").alias("photo_url"), F.col("c_mktsegment").alias("phone"), F.lit("google").alias("auth_provider"),
        (k % 2 == 0).alias("email_reports"), F.lit("LOW").alias("risk_threshold"), F.lit("dark").alias("theme"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + k * 1_000_000 + F.when(k % 3 == 0, 250_000).otherwise(0)).alias("created_at"),
        F.lit("never shown").alias("secret"),
    ))


@query("""SELECT o_orderkey AS id, concat('g', o_orderkey) AS github_username, 'a' AS avatar_url, true AS is_primary, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS connected_at FROM orders
WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderkey % 2 = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) % 2 ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def chosen_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's primary connection without its token (PRJ-2, UPD-4)."""
    orders = fixtures.read(spark, sf_dir, "orders")
    user = orders.agg(F.min("o_custkey")).first()[0]
    odd = orders.where(F.col("o_custkey") == user).agg(F.min("o_orderkey")).first()[0] % 2
    owned = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("g"), "o_orderkey").alias("github_username"), F.lit("a").alias("avatar_url"), F.lit("t").alias("access_token"),
        (F.col("o_orderkey") % 2 == odd).alias("is_primary"), F.col("o_orderdate").cast("timestamp_ntz").alias("connected_at"),
    )
    return history.connection_view(history.chosen_connection(owned, user))


@query(f"""WITH {fixtures.SQL_CHANGES} SELECT analysis_id * 100 + ord AS id, concat('f', analysis_id % 9) AS file_path, issue_type, description, old_code, new_code, ord AS line_start, ord + 2 AS line_end, risk_level, reason AS risk_reason,
  confidence, 2 AS priority, callers_affected AS callers, status FROM changes""")
def change_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a change (PRJ-4)."""
    c = fixtures.changes(spark, sf_dir)
    made = {
        "id": F.col("analysis_id") * 100 + F.col("ord"), "file_path": F.concat(F.lit("f"), F.col("analysis_id") % 9), "line_start": F.col("ord"), "line_end": F.col("ord") + 2, "risk_reason": F.col("reason"),
        "priority": F.lit(2), "callers": F.col("callers_affected"),
    }
    return history.change_view(c.withColumns(made))


# --- issues and findings ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN coalesce(CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, true) THEN 'fix' ELSE 'people' END AS way FROM part""")
def issue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that are fixed and issues for people, put together again (FLT-5, SET-5)."""
    k = F.col("p_partkey")
    fix, people = history.split_issues(fixtures.read(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("safe_to_auto_fix")))
    return scalars.together(fix.select("p_partkey", F.lit("fix").alias("way")), people.select("p_partkey", F.lit("people").alias("way")))


@query(f"""SELECT l_orderkey AS file, count_if(s = 'HIGH')::INTEGER AS high, count_if(s = 'MEDIUM')::INTEGER AS medium, count_if(s = 'LOW')::INTEGER AS low
FROM (SELECT l_orderkey, {sql_pick(fixtures.RISKS, "l_suppkey % 3")} AS s FROM lineitem) GROUP BY l_orderkey""")
def severity_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a file's findings by severity (AGG-22)."""
    found = fixtures.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.collect_list(F.struct(fixtures.pick(fixtures.RISKS, F.col("l_suppkey") % 3).alias("severity"))).alias("f"))
    return found.select("file", rollup.severity_counts(F.col("f")).alias("n")).select("file", "n.*")


_KINDS = ("file_read", "network", "database", "other")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 OR regexp_matches(mods, 'requests|fetch') THEN true ELSE false END AS network FROM (
  SELECT p_partkey, ['os', 'requests', 'sys'][p_partkey % 3 + 1] AS mods FROM part)""")
def io_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any function or import is about the network (AGG-11)."""
    k = F.col("p_partkey")
    types, modules = F.array(fixtures.pick(_KINDS, k % 4)), F.array(fixtures.pick(("os", "requests", "sys"), k % 3))
    return fixtures.read(spark, sf_dir, "part").select(k, scan.io_summary(types, modules)["has_network"].alias("network"))


# --- call graphs and structure ------------------------------------------------------------------------------------

_GRAPH = f"""{fixtures.SQL_SYMBOLS}, latest AS (SELECT analysis_id, path, name, arg_max(calls, ord) AS calls FROM symbols GROUP BY ALL)"""


@query(f"""WITH {_GRAPH} SELECT analysis_id, path, count_if(len(calls) > 0)::INTEGER AS calling, list_sort(coalesce(list(name) FILTER (len(calls) > 0), []::VARCHAR[])) AS callers,
  list_sort(coalesce(list(name) FILTER (len(calls) > 1), []::VARCHAR[])) AS busy FROM latest GROUP BY analysis_id, path""")
def call_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that call, and those that call much (AGG-13, FLT-7, FLT-8)."""
    latest = fixtures.symbols(spark, sf_dir).groupBy("analysis_id", "path", "name").agg(F.max_by("calls", "ord").alias("calls"))
    maps = latest.groupBy("analysis_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "calls"))).alias("g"))
    g = F.col("g")
    return maps.select("analysis_id", "path", graph.calling_functions(g).alias("calling"), F.array_sort(F.map_keys(graph.with_calls(g))).alias("callers"), graph.busy(g, 1).alias("busy"))


def _function_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, kind, f)``: what forty files hold, functions (a third of the parts, kind 0), classes (1) and imports (2)."""
    k = F.col("p_partkey")
    one = F.struct(
        k.alias("ord"), F.concat(F.lit("fn"), k % 50).alias("name"), (k % 7 + 1).cast("int").alias("complexity"), F.when(k % 2 == 0, F.concat(F.lit("C"), k % 3)).alias("class"), (k % 9).cast("int").alias("start_line"),
        (k % 9 + 3).cast("int").alias("end_line"), F.array_repeat(F.lit("x"), (k % 4).cast("int")).alias("calls"), F.when(k % 5 > 0, k % 5 > 1).alias("is_public"),
    )
    return fixtures.read(spark, sf_dir, "part").select((k % 40).alias("file"), (k % 3).alias("kind"), F.when(k % 3 == 0, one).alias("f"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of :func:`_function_rows`, one row each."""
    by, kind = _function_rows(spark, sf_dir).groupBy("file"), F.col("kind")
    return by.agg(F.array_sort(F.collect_list("f")).alias("functions"), F.collect_list(F.when(kind == 1, F.lit("c"))).alias("classes"), F.collect_list(F.when(kind == 2, F.lit("i"))).alias("imports"))


_FUNCTIONS = """fs AS (SELECT p_partkey % 40 AS file, p_partkey AS ord, concat('fn', p_partkey % 50) AS name, p_partkey % 7 + 1 AS complexity, CASE WHEN p_partkey % 2 = 0 THEN concat('C', p_partkey % 3) END AS class,
  p_partkey % 9 AS start_line, p_partkey % 4 AS n_calls, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 > 1 ELSE true END AS is_public FROM part WHERE p_partkey % 3 = 0)"""


@query(f"""WITH {_FUNCTIONS}, every AS (SELECT p_partkey % 40 AS file, count_if(p_partkey % 3 = 1) AS classes, count_if(p_partkey % 3 = 2) AS imports FROM part GROUP BY 1)
SELECT e.file, count(f.ord)::INTEGER AS function_count, any_value(e.classes)::INTEGER AS class_count, any_value(e.imports)::INTEGER AS import_count, coalesce(round(avg(complexity), 2), 0.0) AS avg_complexity,
  coalesce(max(complexity), 0)::INTEGER AS max_complexity, arg_max(name, (complexity, -f.ord)) AS max_complexity_function, 2 AS total_lines, any_value(round(z.a, 2)) AS avg_cyclomatic FROM every e LEFT JOIN fs f ON f.file = e.file
LEFT JOIN (SELECT file, avg(complexity) AS a FROM fs GROUP BY file) z ON z.file = e.file GROUP BY e.file""")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and complexity of files, the first of equal maxima (AGG-9, AGG-10)."""
    f = _functions(spark, sf_dir)
    parsed = F.struct("functions", "classes", "imports", F.lit(False).alias("has_parse_errors"), F.lit(0).alias("error_node_count"), F.lit(0).alias("raw_ast_node_count"))
    wide = f.select("file", structure.metrics(parsed, F.lit("a\nb")).alias("m"), scan.complexity(F.transform("functions", lambda x: x["complexity"])).alias("c"))
    names = ("function_count", "class_count", "import_count", "avg_complexity", "max_complexity", "max_complexity_function", "total_lines")
    return wide.select("file", *[F.col(f"m.{n}") for n in names], "c.avg_cyclomatic")


@query(f"""WITH {_FUNCTIONS}, placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS n FROM fs)
SELECT file, n::INTEGER AS n, name, concat_ws('-', start_line, start_line + 3) AS lines, n_calls::INTEGER AS callers, is_public FROM placed WHERE n <= 20""")
def function_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty functions of a file in short (PRJ-7, SRT-5)."""
    got = _functions(spark, sf_dir).select("file", F.posexplode(agents.function_summary(F.col("functions"))).alias("n", "f"))
    return got.select("file", (F.col("n") + 1).alias("n"), "f.name", "f.lines", "f.callers", "f.is_public")


@query(f"""WITH {_FUNCTIONS}, measured AS (SELECT file, name, arg_max(complexity, ord) AS c FROM fs WHERE ord % 2 = 1 GROUP BY file, name)
SELECT f.file, f.ord, f.name, m.c::INTEGER AS radon_complexity, CASE WHEN m.c IS NOT NULL THEN 'A' END AS radon_rank, list_sort(list(f.class = 'C0') OVER (PARTITION BY f.file))[-1] IS TRUE AS has_c0
FROM fs f LEFT JOIN measured m ON m.file = f.file AND m.name = f.name""")
def measured_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with a tool's complexity, the last of a name, and whether their file has methods of a class (JOIN-9, JOIN-10)."""
    f = _function_rows(spark, sf_dir).where("kind = 0").select("file", "f.*")
    measured = f.where("ord % 2 = 1").select("file", "ord", "name", "complexity", F.lit("A").alias("rank"))
    marked = structure.methods_of(f, "C0").select("file").distinct().withColumn("has_c0", F.lit(True))
    got = structure.with_radon(f, measured).join(marked, "file", "left")
    return got.select("file", "ord", "name", "radon_complexity", "radon_rank", F.coalesce("has_c0", F.lit(False)).alias("has_c0"))


# --- proposals ----------------------------------------------------------------------------------------------------


@query(f"""WITH {fixtures.SQL_FILES}, asked AS (SELECT file_idx, string_split(content, chr(10)) AS l, content, CASE WHEN file_idx % 4 > 0 THEN {sql_pick(fixtures.TEMPLATES, "5 * (file_idx % 12) + file_idx % 5")} WHEN file_idx % 8 = 0 THEN 'nowhere' ELSE '' END AS old FROM files)
SELECT file_idx, CASE WHEN old <> '' THEN CASE WHEN contains(content, old) THEN 'validated' ELSE 'validation_failed' END END AS status,
  CASE WHEN old <> '' THEN CASE WHEN contains(content, old) THEN coalesce(list_position(list_transform(l, lambda x : contains(x, trim(old))), true), 0) ELSE 7 END END::INTEGER AS line_start,
  md5(array_to_string(list_transform(range(greatest(file_idx % 9 - 1, 1), least(file_idx % 9 + 4, len(l)) + 1), lambda i : concat(i, ': ', l[i])), chr(10))) AS snippet, [file_idx % 9 + 1 + 300] AS shifted
FROM asked""")
def checked_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals checked against their file, with snippets and lines of a chunk (AGT-2, AGT-8, AGT-9, AGT-10, AGT-11)."""
    f, k = fixtures.files(spark, sf_dir), F.col("file_idx")
    old = F.when(k % 4 > 0, fixtures.pick(fixtures.TEMPLATES, 5 * (k % 12) + k % 5)).when(k % 8 == 0, "nowhere").otherwise("")
    change = F.struct(old.alias("old_code"), F.lit(7).alias("line_start"), F.lit("?").alias("status"))
    line = F.array(k % 9 + 1)
    got = f.select(k, agents.checked_proposal(F.col("content"), change).alias("c"), agents.snippet(F.col("content"), line).alias("s"), agents.shift_lines(line, F.lit(300)).alias("shifted"))
    return got.select("file_idx", "c.status", "c.line_start", F.md5("s").alias("snippet"), "shifted")


_ONES = "SELECT p_partkey AS k, concat('a', p_partkey) AS a, concat('b', p_partkey) AS b FROM part"


@query(f"""SELECT k AS file, concat(CASE WHEN k % 3 = 0 THEN 'A' ELSE a END, chr(10), CASE WHEN k % 5 = 0 THEN 'B' ELSE b END, chr(10), 'end') AS modified,
  'Modernize: ' || array_to_string(list_sort(list_distinct(list_filter([CASE WHEN k % 3 = 0 THEN 'upper' END, CASE WHEN k % 5 = 0 THEN 'lower' END, CASE WHEN k % 7 = 0 THEN 'none' END], lambda x : x IS NOT NULL))), ', ') AS message
FROM ({_ONES}) WHERE k % 3 = 0 OR k % 5 = 0""")
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that accepted changes alter, with their message; a change that changes nothing alone commits nothing (SNK-5, SNK-6, AGG-21)."""
    k = F.col("p_partkey")
    part = fixtures.read(spark, sf_dir, "part")
    files = part.select(k.alias("file"), F.concat(F.lit("a"), k, F.lit("\nb"), k, F.lit("\nend")).alias("content"))

    def change(ord_: int, kind: str, old: Column, new: Column, accepted: Column) -> Column:
        return F.struct(
            F.lit(ord_).alias("ord"), F.lit(kind).alias("issue_type"), old.alias("old_code"), new.alias("new_code"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
            F.lit("").alias("reason"), F.when(accepted, "accepted").otherwise("skipped").alias("status"),
        )

    three = F.array(
        change(0, "upper", F.concat(F.lit("a"), k, F.lit("\n")), F.lit("A\n"), k % 3 == 0), change(1, "lower", F.concat(F.lit("b"), k, F.lit("\n")), F.lit("B\n"), k % 5 == 0),
        change(2, "none", F.lit("end"), F.lit("end"), k % 7 == 0),
    )
    return edits.commit(files, part.select(k.alias("file"), F.explode(three).alias("c")).select("file", "c.*"), ("file",))


@query(f"""WITH {fixtures.SQL_CHANGES} SELECT c.analysis_id, ord, c.issue_type, left(old_code, 60) AS old_preview, left(new_code, 60) AS new_preview, coalesce(f.risk, 'MEDIUM') AS risk, coalesce(reason, '') AS reason, NOT (c.analysis_id % 3 = 0) AS goes_on
FROM changes c LEFT JOIN (SELECT analysis_id, issue_type, arg_min(risk_level, ord) AS risk FROM changes WHERE ord % 2 = 0 GROUP BY ALL) f ON f.analysis_id = c.analysis_id AND f.issue_type = c.issue_type WHERE status = 'validated'""")
def change_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated changes in short with the first risk of their type, and whether a regression stops them (PRJ-6, FLT-11)."""
    fields = ("ord", "issue_type", "old_code", "new_code", "reason", "status", "risk_level")
    by = fixtures.changes(spark, sf_dir).groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    risks = F.transform(F.filter("c", lambda x: x["ord"] % 2 == 0), lambda x: F.struct(x["issue_type"].alias("issue_type"), x["risk_level"].alias("risk")))
    kept = testruns.unless_regression(F.col("c"), F.col("analysis_id") % 3 == 0)
    valid = F.filter("c", lambda x: x["status"] == "validated")
    got = by.select("analysis_id", F.explode(F.arrays_zip(risk.change_summary(F.col("c"), risks).alias("s"), valid.alias("v"))).alias("x"), (F.size(kept) > 0).alias("goes_on"))
    return got.select("analysis_id", "x.v.ord", "x.s.*", "goes_on")


# --- tests --------------------------------------------------------------------------------------------------------

_SOURCES = (
    ("Python", "def one(a, b=2):\n    pass\n\ndef two():\n    pass\n", True, "one|two", "a,b|"), ("Python", "x = (1\n", False, "", ""), ("JavaScript", "function go(x) {}\nconst hop = async (y) => y\n", False, "go|hop", ""),
    ("Go", "func main() {}", False, "", ""), ("Python", "class A:\n    def method(self):\n        pass\ndef solo(self, n: int):\n    pass", True, "solo", "n"),
)


@query(f"""SELECT p_partkey, s.language, (s.language = 'Python' AND good)::INTEGER AS passed, (s.language = 'Python' AND NOT good)::INTEGER AS failed, CASE WHEN s.language = 'Python' THEN 100 ELSE 0 END AS execution_time_ms,
  CASE WHEN names = '' THEN []::VARCHAR[] ELSE string_split(names, '|') END AS functions, CASE WHEN s.language = 'Python' AND names <> '' THEN string_split(params, '|') ELSE []::VARCHAR[] END AS params,
  CASE WHEN names = '' THEN 0 ELSE len(string_split(names, '|')) END::INTEGER AS stubs
FROM part JOIN {fixtures.sql_values([(i, lang, code, good, n, p) for i, (lang, code, good, n, p) in enumerate(_SOURCES)]).replace("True", "true").replace("False", "false")} s(i, language, code, good, names, params) ON i = p_partkey % {len(_SOURCES)}""")
def single_file_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compile checks, functions found by pattern, and test stubs (TST-2, TST-4, FN-1, FN-2)."""
    k = F.col("p_partkey") % len(_SOURCES)
    p = fixtures.read(spark, sf_dir, "part").select("p_partkey", fixtures.pick([s[0] for s in _SOURCES], k).alias("language"), fixtures.pick([s[1] for s in _SOURCES], k).alias("code"))
    python = F.col("language") == "Python"
    small_batches(spark)
    got = p.withColumn("c", testruns.compile_check(F.col("language"), F.col("code")))
    py, js = structure.python_stubs(F.col("code")), structure.js_stubs(F.col("code"))
    stubs = testruns.stubs(F.col("language"), F.col("code"))
    none = F.array().cast("array<string>")
    return got.select(
        "p_partkey", "language", "c.passed", "c.failed", "c.execution_time_ms",
        F.when(python, F.transform(py, lambda f: f["name"])).when(F.col("language") == "JavaScript", js).otherwise(none).alias("functions"),
        F.when(python, F.transform(py, lambda f: F.array_join(f["params"], ","))).otherwise(none).alias("params"),
        (F.regexp_count(stubs, F.lit(r"def test_|test\('"))).cast("int").alias("stubs"),
    )


@query(f"""WITH {fixtures.SQL_CHANGES} SELECT analysis_id, count(*)::INTEGER AS n, any_value(analysis_id % 4)::INTEGER AS calling, CASE WHEN analysis_id % 2 = 0 THEN ['requests'] ELSE []::VARCHAR[] END AS io_imports,
  list(left(old_code, 80) ORDER BY ord) AS previews FROM changes GROUP BY analysis_id""")
def risk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the risk of a file's changes is judged by (AGT-12)."""
    by = fixtures.changes(spark, sf_dir).groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("ord", "issue_type", "old_code", "new_code", "reason", "status"))).alias("c"))
    k = F.col("analysis_id")
    called = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.cast("string"), F.when(i < k % 4, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))))
    none = F.lit(None).cast("string")
    got = by.select(k, risk.evidence(called, F.array(F.when(k % 2 == 0, "requests").otherwise("mathx")), F.col("c"), none, none, none).alias("e"))
    return got.select("analysis_id", F.size("e.changes").alias("n"), F.col("e.functions_with_calls").alias("calling"), "e.io_imports", F.transform("e.changes", lambda c: c["old_code_preview"]).alias("previews"))


# --- scans and rules by language ----------------------------------------------------------------------------------

_NAMED = f"{fixtures.SQL_FILES}, named AS (SELECT file_idx, content, {catalog._LANGUAGE} AS language FROM files)"


@query(f"""WITH {_NAMED}, keyed AS (SELECT n.*, coalesce(k.lang_key, lower(language)) AS own, string_split(content, chr(10)) AS l FROM named n LEFT JOIN {catalog._KEYS} k(name, lang_key) ON k.name = language)
SELECT file_idx, CAST(row_number() OVER (PARTITION BY file_idx ORDER BY rule_ord) - 1 AS INTEGER) AS ord, pattern AS issue_type,
  CAST(list_filter(list_transform(range(1, len(l) + 1), lambda i : CASE WHEN contains(l[i], legacy) THEN i END), lambda i : i IS NOT NULL) AS INTEGER[]) AS affected_lines, 'Use ' || trim(modern) AS modernization_hint
FROM keyed JOIN {catalog._GOLDEN} g(lang_key, rule_ord, legacy, modern, pattern) ON g.lang_key = own AND legacy <> modern AND contains(content, legacy)""")
def rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that the golden rules find in files, with their lines (AGT-1)."""
    f = agents.rule_issues(language.detect(fixtures.files(spark, sf_dir)))
    return f.select("file_idx", F.posexplode("issues").alias("ord", "i")).select("file_idx", "ord", "i.issue_type", "i.affected_lines", "i.modernization_hint")


@query(f"""WITH {_NAMED}, l AS (SELECT file_idx, language, unnest(string_split(content, chr(10))) AS line FROM named), hits AS (
  SELECT file_idx, severity FROM l JOIN {catalog._PYTHON} r(rule_ord, regex, severity, issue) ON language = 'Python' AND regexp_matches(line, regex)
  UNION ALL SELECT file_idx, severity FROM l JOIN {catalog._GENERIC} r(rule_ord, regex, severity, issue) ON language <> 'Python' AND regexp_matches(line, regex)),
n AS (SELECT file_idx, count_if(severity = 'HIGH') AS high, count_if(severity = 'MEDIUM') AS medium, count_if(severity = 'LOW') AS low FROM hits GROUP BY file_idx),
s AS (SELECT file_idx, count(*) AS secrets FROM l JOIN {catalog._SECRETS} r(rule_ord, regex) ON regexp_matches(line, regex) GROUP BY file_idx)
SELECT f.file_idx, CASE WHEN n.file_idx IS NOT NULL THEN CASE WHEN language = 'Python' THEN 'heuristic_python' ELSE 'heuristic' END END AS tool, coalesce(high, 0)::INTEGER AS high, coalesce(medium, 0)::INTEGER AS medium,
  coalesce(low, 0)::INTEGER AS low, coalesce(secrets, 0)::INTEGER AS secrets, coalesce(high, 0) = 0 AND coalesce(secrets, 0) = 0 AS gate_passed, CAST(NULL AS DOUBLE) AS maintainability_index
FROM named f LEFT JOIN n ON n.file_idx = f.file_idx LEFT JOIN s ON s.file_idx = f.file_idx""")
def file_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files scanned by the rules of their language (SCN-4 to SCN-7); what needs a missing tool is null."""
    f = scan.file_scan(language.detect(fixtures.files(spark, sf_dir)))
    names = ("high", "medium", "low", "secrets")
    return f.select("file_idx", F.get("security_findings", F.lit(0))["tool"].alias("tool"), *[F.col(f"risk_summary.{n}") for n in names], F.col("security_gate_passed").alias("gate_passed"), "maintainability_index")


@query("""SELECT p_partkey, CAST(list_transform(range(CAST(ceil(p_partkey % 13 / 5) AS BIGINT)), lambda i : least(5, p_partkey % 13 - 5 * i)) AS INTEGER[]) AS sizes, ['C++', 'C#', 'Python', 'JavaScript'][p_partkey % 4 + 1] AS language,
  ['cpp', 'c_sharp', 'python', 'javascript'][p_partkey % 4 + 1] AS parser FROM part""")
def issue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in batches of five, and the key of a language's parser (AGT-7, LNG-6)."""
    k = F.col("p_partkey")
    issue = F.from_json(F.lit("{}"), schemas.ISSUE.removeprefix("struct<").removesuffix(">").replace("\n", " ").replace(":", " "))
    lang = fixtures.pick(("C++", "C#", "Python", "JavaScript"), k % 4)
    sizes = F.transform(agents.batches(F.array_repeat(issue, (k % 13).cast("int"))), F.size)
    return fixtures.read(spark, sf_dir, "part").select(k, sizes.alias("sizes"), lang.alias("language"), language.parser_key(lang).alias("parser"))


@query(f"""WITH {catalog._TREE} SELECT repo, ord, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY ord) AS INTEGER) AS file_idx FROM tree
WHERE type = 'blob' AND lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) IN ({catalog._SUPPORTED}) AND coalesce(size, 0) <= 512000 AND NOT ({catalog._EXCLUDED}) AND (repo <> '1' OR ord % 3 = 0)
QUALIFY file_idx <= {rules.MAX_REPO_FILES}""")
def selected_repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are read where one repository has a selection (JOIN-13)."""
    tree = catalog._tree(spark, sf_dir)
    chosen = tree.where("repo = '1' AND ord % 3 = 0").select("repo", "path")
    return sources.repo_files(tree, chosen).select("repo", "ord", "path", "file_idx")


@query(f"""WITH {fixtures.SQL_ANALYSES} SELECT id, user_id FROM analyses WHERE language = 'Go' AND status = 'complete'""")
def rows_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of given keys (SRC-8)."""
    return sources.by_key(fixtures.analyses(spark, sf_dir), language="Go", status="complete").select("id", "user_id")


@query(f"""WITH {_FUNCTIONS}, files AS (SELECT DISTINCT p_partkey % 40 AS file FROM part), gone AS (
  SELECT file, list_sort(list(name)) AS missing FROM (SELECT DISTINCT file, name FROM fs EXCEPT SELECT DISTINCT file, name FROM fs WHERE ord % 5 > 0) GROUP BY file),
sums AS (SELECT file, sum(CASE WHEN ord % 5 > 0 THEN complexity + 1 ELSE 0 END) - sum(complexity) AS delta FROM fs GROUP BY file)
SELECT f.file, missing IS NULL AND f.file % 4 <= f.file % 3 AS valid, coalesce(missing, []::VARCHAR[]) AS missing_functions, CASE WHEN f.file % 2 = 0 THEN [concat('import b', f.file)] ELSE []::VARCHAR[] END AS new_imports,
  CAST(f.file % 4 - f.file % 3 AS INTEGER) AS new_errors, CAST(coalesce(delta, 0) AS INTEGER) AS complexity_delta FROM files f LEFT JOIN gone g ON g.file = f.file LEFT JOIN sums s ON s.file = f.file""")
def strict_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parse records compared: lost functions, new imports, new errors, complexity (EDIT-6)."""
    k = F.col("file")
    kept = F.transform(F.filter("functions", lambda f: f["ord"] % 5 > 0), lambda f: f.withField("complexity", f["complexity"] + 1))
    record = lambda fs, errors, more: F.struct(fs.alias("functions"), errors.cast("int").alias("error_node_count"), F.transform(more, lambda m: F.struct(m.alias("raw"))).alias("imports"))
    one = F.array(F.lit("import a"))
    after = F.when(k % 2 == 0, F.concat(one, F.array(F.concat(F.lit("import b"), k)))).otherwise(one)
    return _functions(spark, sf_dir).select(k, edits.validate_strict(record(F.col("functions"), k % 3, one), record(kept, k % 4, after)).alias("v")).select("file", "v.*")
