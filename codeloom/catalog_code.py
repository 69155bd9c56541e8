"""Queries on code and answers whose fold, packing or parsing has SQL of its own: recursive where one step needs the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import agents, edits, nesting, structure, versions
from .plans import fixtures
from .registry import query

# --- edits --------------------------------------------------------------------------------------------------------


def _edits_sql() -> str:
    old = [fixtures.sql_pick(fixtures.TEMPLATES, f"5 * (file_idx % 12) + {j}") for j in range(4)]
    rows = (
        (0, old[0], f"concat({old[0]}, ' # a')", "file_idx % 9 * 7"), (1, old[1], "'x'", "1"), (2, old[2], f"concat({old[2]}, chr(10), {old[2]})", "n + file_idx % 3 - 1"),
        (3, f"CASE WHEN file_idx % 3 > 0 THEN {old[3]} ELSE '' END", "'z'", "NULL"), (4, "'not there'", "'w'", "5"), (5, old[1], "'y'", "30"),
    )
    return " UNION ALL ".join(f"SELECT file_idx, {k} AS ord, {a} AS old, {b} AS new, CAST({line} AS INTEGER) AS line_start FROM counted" for k, a, b, line in rows)


@query(f"""WITH RECURSIVE {fixtures.SQL_FILES}, counted AS (SELECT file_idx, content, len(string_split(content, chr(10))) AS n FROM files), proposed AS ({_edits_sql()}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY coalesce(line_start, 0) DESC, ord) AS k FROM proposed),
run AS (
  SELECT file_idx, 0 AS k, content AS text, []::INTEGER[] AS applied, []::INTEGER[] AS rejected FROM files
  UNION ALL
  SELECT file_idx, k, CASE WHEN place IS NULL THEN text ELSE substr(text, 1, place) || new || substr(text, place + length(old) + 1) END,
    CASE WHEN place IS NULL THEN applied ELSE list_append(applied, ord) END, CASE WHEN place IS NULL THEN list_append(rejected, ord) ELSE rejected END
  FROM (
    SELECT r.file_idx, o.k, r.text, r.applied, r.rejected, o.ord, o.old, o.new, CAST(CASE
      WHEN o.old = '' OR NOT contains(r.text, o.old) THEN NULL
      WHEN length(r.text) - length(replace(r.text, o.old, '')) = length(o.old) THEN strpos(r.text, o.old) - 1
      WHEN o.line_start IS NULL OR o.line_start < 1 OR o.line_start > len(string_split(r.text, chr(10))) THEN NULL
      WHEN strpos(substr(r.text, begins + 1), o.old) > 0 THEN begins + strpos(substr(r.text, begins + 1), o.old) - 1
      ELSE length(r.text) - strpos(reverse(r.text), reverse(o.old)) + 1 - length(o.old) END AS INTEGER) AS place
    FROM (SELECT r.*, o.line_start, CAST(coalesce(list_sum(list_transform(string_split(r.text, chr(10))[1:greatest(o.line_start - 1, 0)], lambda x : length(x) + 1)), 0) AS BIGINT) AS begins
      FROM run r JOIN ordered o ON o.file_idx = r.file_idx AND o.k = r.k + 1) r JOIN ordered o ON o.file_idx = r.file_idx AND o.k = r.k + 1)
)
SELECT file_idx, text, applied, rejected FROM run WHERE k = 6""")
def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six edits a file, each on the text that the ones before left: unique, ambiguous by line, missing, empty (EDIT-1, EDIT-2, SRT-2, SRT-6)."""
    f, k = fixtures.files(spark, sf_dir), F.col("file_idx")
    n = F.size(F.split("content", "\n"))
    t = [fixtures.pick(fixtures.TEMPLATES, 5 * (k % 12) + j) for j in range(5)]
    rows = (
        (t[0], F.concat(t[0], F.lit(" # a")), k % 9 * 7), (t[1], F.lit("x"), F.lit(1)), (t[2], F.concat(t[2], F.lit("\n"), t[2]), n + k % 3 - 1),
        (F.when(k % 3 > 0, t[3]).otherwise(""), F.lit("z"), F.lit(None)), (F.lit("not there"), F.lit("w"), F.lit(5)), (t[1], F.lit("y"), F.lit(30)),
    )
    proposed = F.array(*[
        F.struct(F.lit(j).alias("ord"), F.lit("t").alias("issue_type"), old.alias("old_code"), new.alias("new_code"), line.cast("int").alias("line_start")) for j, (old, new, line) in enumerate(rows)
    ])
    got = f.select("file_idx", edits.apply_edits(F.col("content"), proposed).alias("e"))
    return got.select("file_idx", "e.text", "e.applied", F.transform("e.rejected", lambda r: r["ord"]).alias("rejected"))


# --- two versions -------------------------------------------------------------------------------------------------


def _version(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    k = F.col("p_partkey")
    p = fixtures.read(spark, sf_dir, "part").where(k % 13 > 0 if late else F.lit(True))
    args = F.when((k % 5 == 0) if late else F.lit(False), "a, b, c, d").otherwise(fixtures.pick(("", "a", "a, b", "self, a"), k % 4))
    line = (
        F.when((k % 11 == 0) if late else F.lit(False), F.concat(F.lit("from extra"), k % 3, F.lit(" import y"))).when(k % 7 < 3, F.concat(F.lit("def fn"), k % 83, F.lit("("), args, F.lit("):")))
        .when(k % 7 < 4, F.concat(F.lit("    async def g"), k % 9, F.lit("(self, x):"))).when(k % 7 < 5, F.concat(F.lit("import m"), k % 9)).otherwise("x = call(1)")
    )
    return p.select((k % 40).alias("file_id"), k.alias("line_no"), line.alias("line"))


def _version_sql(name: str, late: bool) -> str:
    args = fixtures.sql_pick(("", "a", "a, b", "self, a"), "p_partkey % 4")
    more = "WHEN p_partkey % 11 = 0 THEN concat('from extra', p_partkey % 3, ' import y')" if late else ""
    four = f"CASE WHEN p_partkey % 5 = 0 THEN 'a, b, c, d' ELSE {args} END" if late else args
    return f"""{name} AS (SELECT p_partkey % 40 AS file_id, p_partkey AS line_no, CASE {more} WHEN p_partkey % 7 < 3 THEN concat('def fn', p_partkey % 83, '(', {four}, '):')
  WHEN p_partkey % 7 < 4 THEN concat('    async def g', p_partkey % 9, '(self, x):') WHEN p_partkey % 7 < 5 THEN concat('import m', p_partkey % 9) ELSE 'x = call(1)' END AS line FROM part {'WHERE p_partkey % 13 > 0' if late else ''})"""


_HEADERS = """{0}_f AS (SELECT file_id, name, arg_min(arity, line_no) AS arity FROM (SELECT file_id, line_no, regexp_extract(line, 'def (\\w+)', 1) AS name,
  CAST(len(list_filter(string_split(regexp_extract(line, '\\((.*)\\)', 1), ','), lambda x : trim(x) NOT IN ('', 'self'))) AS INTEGER) AS arity FROM {0} WHERE regexp_matches(line, '^ *(async )?def ')) GROUP BY ALL),
{0}_i AS (SELECT DISTINCT file_id, regexp_extract(line, '^(import|from) (\\w+)', 2) AS module FROM {0} WHERE regexp_matches(line, '^(import|from) '))"""
_VERSIONS = f"{_version_sql('old', False)}, {_version_sql('new', True)}, {_HEADERS.format('old')}, {_HEADERS.format('new')}"
_CHANGED = """SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'new' WHEN a.arity <> b.arity THEN 'arity' ELSE 'same' END AS change,
  a.arity AS arity_before, b.arity AS arity_after FROM old_f a FULL JOIN new_f b ON a.file_id = b.file_id AND a.name = b.name"""


@query(f"WITH {_VERSIONS} {_CHANGED}")
def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of two versions of files: missing, new, with another number of parameters (JOIN-12, SET-2)."""
    return versions.changed_functions(_version(spark, sf_dir, False), _version(spark, sf_dir, True))


@query(f"""WITH {_VERSIONS}, changed AS ({_CHANGED}), gone AS (SELECT file_id, list_sort(list(name) FILTER (change = 'missing')) AS missing, count_if(change = 'arity')::BIGINT AS arity_changes FROM changed GROUP BY file_id),
added AS (SELECT file_id, list_sort(list(module)) AS modules FROM (SELECT * FROM new_i EXCEPT SELECT * FROM old_i) GROUP BY file_id)
SELECT f.file_id, coalesce(missing, []::VARCHAR[]) AS missing, coalesce(arity_changes, 0) AS arity_changes, coalesce(modules, []::VARCHAR[]) AS unexpected_imports, missing IS NULL AS signatures_preserved,
  list_filter([CASE WHEN missing IS NOT NULL THEN 'Functions removed from modified file: ' || array_to_string(missing, ', ') END, CASE WHEN modules IS NOT NULL THEN 'New imports detected: ' || array_to_string(modules, ', ') END], lambda x : x IS NOT NULL) AS issues
FROM (SELECT DISTINCT file_id FROM old) f LEFT JOIN gone g ON g.file_id = f.file_id LEFT JOIN added a ON a.file_id = f.file_id""")
def version_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new version lacks or imports anew, file by file (EDIT-5, SET-3)."""
    return versions.verdicts(_version(spark, sf_dir, False), _version(spark, sf_dir, True))


# --- chunks -------------------------------------------------------------------------------------------------------

_HEAD = "^(async def|func|fn|public class|const f)"
_SIZE = 10
_SPANS = f"""{fixtures.SQL_LINES}, spans AS (
  SELECT file_id, line_no AS a, least(coalesce(lead(line_no) OVER w, last + 1) - 1, line_no + 2 + line_no % 5) AS b, row_number() OVER w AS k
  FROM (SELECT *, max(line_no) OVER (PARTITION BY file_id) AS last FROM code_lines) WHERE regexp_matches(line, '{_HEAD}') WINDOW w AS (PARTITION BY file_id ORDER BY line_no))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_idx, content, functions)``: the lines that begin a function, up to the next one."""
    rows = fixtures.code_lines(spark, sf_dir)
    last = rows.groupBy(F.col("file_id").alias("_id")).agg(F.max("line_no").alias("last"))
    heads = rows.where(F.regexp_like("line", F.lit(_HEAD))).join(last, F.col("file_id") == F.col("_id"))
    stop = F.coalesce(F.lead("line_no").over(Window.partitionBy("file_id").orderBy("line_no")), F.col("last") + 1) - 1
    heads = heads.select("file_id", F.struct(F.col("line_no").alias("start_line"), F.least(stop, F.col("line_no") + 2 + F.col("line_no") % 5).alias("end_line")).alias("f"))
    by = heads.groupBy(F.col("file_id").alias("_file")).agg(F.array_sort(F.collect_list("f")).alias("functions"))
    return fixtures.files(spark, sf_dir).join(by, F.col("file_idx") == F.col("_file"))


@query(f"""WITH RECURSIVE {_SPANS}, packed AS (
  SELECT file_id, k, a, b, 0 AS chunk, 1 AS start_line, b - a + 1 AS held FROM spans WHERE k = 1
  UNION ALL
  SELECT s.file_id, s.k, s.a, s.b, CASE WHEN held + s.b - s.a + 1 > {_SIZE} THEN chunk + 1 ELSE chunk END, CASE WHEN held + s.b - s.a + 1 > {_SIZE} THEN s.a ELSE start_line END,
    CASE WHEN held + s.b - s.a + 1 > {_SIZE} THEN 0 ELSE held END + s.b - s.a + 1 FROM packed p JOIN spans s ON s.file_id = p.file_id AND s.k = p.k + 1)
SELECT CAST(p.file_id AS INTEGER) AS file_idx, CAST(chunk AS INTEGER) AS chunk, any_value(start_line)::INTEGER AS start_line, md5(string_agg(line, chr(10) ORDER BY k, line_no)) AS digest
FROM packed p JOIN code_lines l ON l.file_id = p.file_id AND l.line_no BETWEEN a AND b GROUP BY p.file_id, chunk""")
def packed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions packed into chunks of at most ten lines, found by line patterns (CHK-2, SRT-3)."""
    got = _spans(spark, sf_dir).select("file_idx", F.posexplode(structure.reader_chunks(F.col("content"), F.col("functions"), _SIZE)).alias("chunk", "c"))
    return got.select("file_idx", "chunk", "c.start_line", F.md5("c.code").alias("digest"))


@query(f"""WITH RECURSIVE {_SPANS}, sized AS (SELECT file_id, max(line_no) AS n FROM code_lines GROUP BY file_id), cuts AS (
  SELECT z.file_id, 0 AS k, 1 AS start_line, 0 AS cut_at, 0 AS before FROM sized z WHERE n > {_SIZE} AND file_id IN (SELECT file_id FROM spans)
  UNION ALL
  SELECT c.file_id, s.k, CASE WHEN s.b - start_line + 1 > {_SIZE} AND s.a > start_line THEN s.a ELSE start_line END, CASE WHEN s.b - start_line + 1 > {_SIZE} AND s.a > start_line THEN s.a ELSE 0 END, start_line
  FROM cuts c JOIN spans s ON s.file_id = c.file_id AND s.k = c.k + 1)
SELECT CAST(file_id AS INTEGER) AS file_idx, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM (
  SELECT file_id, before AS start_line, cut_at - 1 AS end_line FROM cuts WHERE cut_at > 0
  UNION ALL SELECT c.file_id, arg_max(start_line, k), any_value(n) FROM cuts c JOIN sized z ON z.file_id = c.file_id GROUP BY c.file_id
  UNION ALL SELECT file_id, 1, n FROM sized WHERE n <= {_SIZE} AND file_id IN (SELECT file_id FROM spans))""")
def covering_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that cover a file, cut where a function would pass ten lines (CHK-3)."""
    got = _spans(spark, sf_dir).select("file_idx", F.explode(structure.parser_chunks(F.col("content"), F.col("functions"), _SIZE)).alias("c"))
    return got.select("file_idx", "c.start_line", "c.end_line")


# --- one to many --------------------------------------------------------------------------------------------------


@query(f"""WITH {fixtures.SQL_CHANGES}, n AS (SELECT analysis_id, ceil(count(*) / 3) AS parts FROM changes GROUP BY analysis_id)
SELECT o_orderkey AS id, CAST(coalesce(ord % parts, 0) AS BIGINT) AS part, CAST(coalesce(any_value(parts), 1) AS BIGINT) AS parts, list_sort(coalesce(list(ord) FILTER (ord IS NOT NULL), []::INTEGER[])) AS ords,
  coalesce(list(status ORDER BY ord) FILTER (ord IS NOT NULL), []::VARCHAR[]) AS statuses
FROM orders LEFT JOIN changes c ON c.analysis_id = o_orderkey LEFT JOIN n ON n.analysis_id = o_orderkey GROUP BY o_orderkey, ord % parts""")
def analyses_with_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each analysis with its changes, in parts of about three (JOIN-1)."""
    parents = fixtures.analyses(spark, sf_dir).select("id")
    children = fixtures.changes(spark, sf_dir).select(F.col("analysis_id").alias("id"), "ord", "status")
    got = nesting.nest(parents, children, "id", ["ord", "status"], F.col("ord"), rows=3)
    return got.select("id", "part", "parts", F.transform("children", lambda c: c["ord"]).alias("ords"), F.transform("children", lambda c: c["status"]).alias("statuses"))


@query("""WITH n AS (SELECT o_custkey, ceil(count(*) / 8) AS parts FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, CAST(coalesce(o_orderkey % parts, 0) AS BIGINT) AS part, CAST(coalesce(any_value(parts), 1) AS BIGINT) AS parts, count(o_orderkey) AS connections, min(o_orderkey) AS first_connection
FROM customer LEFT JOIN orders o ON o.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey GROUP BY c_custkey, o_orderkey % parts""")
def users_with_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user with connections, none too (JOIN-2), in parts of about eight."""
    users = fixtures.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    owned = fixtures.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("connection"))
    got = nesting.nest(users, owned, "id", ["connection"], F.col("connection"), rows=8)
    return got.select("id", "part", "parts", F.size("children").cast("long").alias("connections"), F.get("children", F.lit(0))["connection"].alias("first_connection"))


# --- answers ------------------------------------------------------------------------------------------------------

_ANSWERS = """answers AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '```json' || chr(10) || '[' || props || ', ' || props || ']' || chr(10) || '```'
  WHEN 3 THEN '{"issues": [' || props || ']}' WHEN 4 THEN 'Here: [' || props || '] as asked' WHEN 5 THEN '{"issues": [' || props WHEN 6 THEN '{"issues": ' || props || ', "results": [' || props || ']}' END AS raw FROM events)"""


def _answers(events: DataFrame) -> DataFrame:
    k, p = F.col("event_id") % 8, F.col("props")
    raw = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("["), p, F.lit("]"))).when(k == 2, F.concat(F.lit("```json\n["), p, F.lit(", "), p, F.lit("]\n```")))
        .when(k == 3, F.concat(F.lit('{"issues": ['), p, F.lit("]}"))).when(k == 4, F.concat(F.lit("Here: ["), p, F.lit("] as asked"))).when(k == 5, F.concat(F.lit('{"issues": ['), p))
        .when(k == 6, F.concat(F.lit('{"issues": '), p, F.lit(', "results": ['), p, F.lit("]}")))
    )
    return events.select("event_id", raw.alias("raw"))


@query(f"""WITH {_ANSWERS}, clean AS (SELECT *, trim(regexp_replace(raw, '```(json)?', '', 'g'), ' ' || chr(10)) AS x FROM answers), whole AS (
  SELECT event_id, raw, x, regexp_extract(x, '(?s)\\[.*\\]') AS inner_x, CASE WHEN NOT json_valid(x) THEN NULL WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$')
    ELSE coalesce(CASE WHEN json_type(x, '$.issues') = 'ARRAY' THEN json_extract(x, '$.issues') END, CASE WHEN json_type(x, '$.results') = 'ARRAY' THEN json_extract(x, '$.results') END) END AS items FROM clean
), found AS (SELECT *, coalesce(items, CASE WHEN json_valid(inner_x) AND inner_x <> '' THEN json_extract(inner_x, '$') END) AS got FROM whole)
SELECT event_id, CAST(json_array_length(got) AS INTEGER) AS n, CAST(json_extract(got, '$[0].k') AS INTEGER) AS first_k,
  CASE WHEN got IS NOT NULL THEN NULL WHEN raw IS NULL THEN 'no answer' WHEN json_valid(x) THEN 'no list' ELSE 'no JSON' END AS problem FROM found""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in answers that are plain, fenced, nested, inside prose, broken or missing (JSN-1, AGT-3, AGT-4)."""
    got = agents.read_answers(_answers(fixtures.read(spark, sf_dir, "events")), "raw", element="struct<k:int>")
    return got.select("event_id", F.when(F.col("items").isNotNull(), F.size("items")).alias("n"), F.get("items", F.lit(0))["k"].alias("first_k"), "problem")


_RISKS = _ANSWERS.replace("FROM events)", """FROM (SELECT event_id, replace(props, '}', ', "overall_risk": "R' || event_id % 3 || '"}') AS props FROM events))""")


@query(f"""WITH {_RISKS}, clean AS (
  SELECT event_id, trim(regexp_replace(raw, '```(json)?', '', 'g'), ' ' || chr(10)) AS x FROM answers), parts AS (SELECT *, regexp_extract(x, '(?s)\\{{.*\\}}') AS inner_x FROM clean)
SELECT event_id, CASE WHEN json_valid(x) AND x LIKE '{{%' AND json_extract(x, '$.overall_risk') IS NOT NULL THEN json_extract_string(x, '$.overall_risk')
  WHEN inner_x <> '' AND json_valid(inner_x) THEN json_extract_string(inner_x, '$.overall_risk') END AS overall_risk FROM parts""")
def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in the same answers, by a field that they need (AGT-5, AGT-6)."""
    marked = F.concat(F.lit(', "overall_risk": "R'), F.col("event_id") % 3, F.lit('"}'))
    events = fixtures.read(spark, sf_dir, "events").select("event_id", F.replace("props", F.lit("}"), marked).alias("props"))
    got = agents.json_object(F.col("raw"), "overall_risk")
    return _answers(events).select("event_id", F.try_variant_get(got, "$.overall_risk", "string").alias("overall_risk"))
