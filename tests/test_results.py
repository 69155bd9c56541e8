"""Risk, matching, roll-ups, history, accounts, sources and reports."""

import hashlib
import hmac
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import accounts, history, matching, report, risk, rollup
from codeloom.plans import analysis
from codeloom.sources import files as sources


def test_first_and_last_risk(spark):
    changes = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "none")], "file_id int, ord int, issue_type string")
    risks = spark.createDataFrame([(1, 0, "a", "LOW", "r0", 0.1, 1), (1, 1, "a", "HIGH", "r1", 0.2, 2)], "file_id int, ord int, issue_type string, risk string, reason string, confidence double, callers_affected int")
    last = {r.ord: (r.risk_level, r.risk_reason, r.confidence, r.callers) for r in risk.with_risk(changes, risks).collect()}
    assert last == {0: ("HIGH", "r1", 0.2, 2), 1: ("HIGH", "r1", 0.2, 2), 2: ("MEDIUM", "", None, 0)}
    assert {r.risk_level for r in risk.with_risk(changes, risks, first=True).where("issue_type = 'a'").collect()} == {"LOW"}


def _edits(spark, *types, status="validated"):
    return spark.createDataFrame([([(i, t, "o" * 100, "n", 1, 1, None, status) for i, t in enumerate(types)],)], f"c array<{schemas.EDIT}>")


def test_assessment(spark):
    df = _edits(spark, "print_statement", "urllib2_usage", "other", "other")
    r = df.select(risk.assess(F.col("c"), F.lit(False)).alias("r"), risk.assess(F.col("c"), F.lit(True)).alias("w"), risk.previews(F.col("c")).alias("p")).first()
    assert (r.r.overall_risk, r.r.overall_score, r.r.estimated_hours_saved, r.r.risk_summary.low_count) == ("HIGH", 50, 1.1, 1)
    assert [x.risk for x in r.w.per_change_risk] == ["HIGH"] * 4 and r.w.overall_score == 0
    assert len(r.p[0].old_code_preview) == 80 and r.p[0].reason == ""
    none = _edits(spark).select(risk.assess(F.col("c"), F.lit(None).cast("boolean")).alias("r")).first().r
    assert (none.overall_risk, none.overall_score) == ("LOW", 100)
    s = _edits(spark, "a", "a").select(risk.change_summary(F.col("c"), F.array(F.struct(F.lit("a").alias("issue_type"), F.lit("LOW").alias("risk")), F.struct(F.lit("a").alias("issue_type"), F.lit("HIGH").alias("risk")))).alias("s")).first().s
    assert [x.risk for x in s] == ["LOW", "LOW"] and len(s[0].old_preview) == 60


@pytest.mark.parametrize(("counts", "want"), [((0, 0, 0), 100), ((1, 1, 1), 50), ((0, 0, 3), 0), ((3, 0, 0), 100), ((2, 1, 4), 35)])
def test_overall_score(spark, counts, want):
    assert spark.range(1).select(risk.overall_score(*map(F.lit, counts))).first()[0] == want


def test_confidence(spark):
    rows = [
        (1, 0, "Python", "x", " print'hello'", "print('hello') ", "validated"), (1, 1, "Python", "xrange_usage", "", "", "manual_required"), (1, 2, "Python", "zz", "a", "b", "validated"),
        (2, 0, "COBOL", "x", "a", "b", "validated"), (3, 0, "Python", "xrange_usage", "a", "b", "pending"), (4, 0, "Go", "u", "a", "b", "validated"), (4, 1, "Go", "u", "a", "b", "validated"),
    ]
    df = spark.createDataFrame(rows, "file_id int, ord int, language string, issue_type string, old_code string, new_code string, status string")
    golden = matching.golden(spark)
    got = {(r.file_id, r.ord): (r.pattern, r.match_type) for r in matching.matches(df, golden).collect()}
    assert got == {(1, 0): ("print_statement", "exact"), (1, 1): ("xrange_usage", "pattern_name")}
    scores = {r.file_id: (r.total_changes, r.pattern_matches, r.confidence_score) for r in matching.confidence(df, golden).collect()}
    assert scores == {1: (3, 2, 66), 2: (1, 0, 75), 3: (0, 0, 100), 4: (2, 0, 60)}
    assert golden.count() == 48


def test_rollup_without_results(spark):
    kind = "analysis_id string, file_idx int, language string, era string, n_issues int, n_findings int, minimality_score double, avg_complexity double, confidence_score int, hours_saved double, regression boolean, tests_passed int, overall_risk string"
    rows = [("a", 1, "Go", "e1", None, 2, None, None, None, None, None, None, None), ("a", 0, "C", "e0", 3, 1, None, None, None, None, None, None, "")]
    r = rollup.analyses(spark.createDataFrame(rows, kind)).first()
    assert (r.language, r.era, r.total_issues, r.security_issues, r.overall_risk, r.tests_passed, r.minimality_score, r.estimated_hours_saved) == ("C", "e0", 3, 3, None, True, None, 0.0)
    assert rollup.analyses(spark.createDataFrame([], kind)).count() == 0


def test_saved_and_deduped(spark):
    rows = [(1, 0, "validated", "", "d", None, None), (1, 1, "pending", "r", "d", "LOW", 1), (1, 2, "validation_failed", "r", "d", "LOW", 1)]
    got = rollup.saved_changes(spark.createDataFrame(rows, "file_id int, ord int, status string, reason string, description string, risk_level string, priority int")).orderBy("ord").collect()
    assert [(r.ord, r.description, r.risk_level, r.priority) for r in got] == [(0, "d", "MEDIUM", 2), (2, "r", "LOW", 1)]
    issues = spark.createDataFrame([(1, 0, "a", [1, 2]), (1, 1, "a", [1, 2]), (1, 2, "a", [2]), (1, 3, None, None), (1, 4, None, None)], "file_id int, ord int, issue_type string, affected_lines array<int>")
    assert sorted(r.ord for r in rollup.first_issues(issues).collect()) == [0, 2, 3]


def test_history(spark):
    rows = [(i, 1, datetime(2024, 1, 1 + i % 3), ("Go", None, "C")[i % 3], "HIGH" if i % 2 else "LOW", "complete", f"Repo{i}" if i else None) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, user_id int, created_at timestamp_ntz, language string, overall_risk string, status string, source_name string")
    assert [r.id for r in history.history(df, 1, limit=3, offset=1).collect()] == [5, 8, 1]
    assert [r.id for r in history.history(df, 1, "C", "high").collect()] == [5]
    assert history.page_total(history.history(df, 1, limit=3)).first().total == 3
    assert [r.language for r in history.languages(df).collect()] == ["C", "Go"]
    assert sorted(r.id for r in history.screen(df, search="REPO").collect()) == list(range(1, 9)) and history.screen(df).count() == 9
    assert history.history_screen(df, 1, search="repo1", risk="HIGH").first().id == 1
    plan = history.history(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan or "LocalTableScan" in plan


def test_status_is_scoped_to_the_owner(spark):
    changes = spark.createDataFrame([(1, "a", "pending"), (2, "b", "pending")], "id int, analysis_id string, status string")
    owned = spark.createDataFrame([("a", 7), ("b", 8)], "id string, user_id int")
    got = {r.id: r.status for r in history.set_status(changes, [1, 2], "accepted", owned, 7).collect()}
    assert got == {1: "accepted", 2: "pending"}
    assert {r.status for r in history.set_status(changes, [], "x").collect()} == {"pending"}


def test_accounts(spark):
    users = spark.createDataFrame(
        [("1", "a@x.org", "Ann", "google"), ("2", f"bob{history.PLACEHOLDER}", "Bob", "github"), ("3", f"cy{history.PLACEHOLDER}", "Cy", "google")], "id string, email string, name string, auth_provider string"
    ).withColumn("photo_url", F.lit("p"))
    logins = spark.createDataFrame([("a@x.org", "Other", "q"), ("b@x.org", "Bob", None), ("n@x.org", "New", "r")], "email string, name string, picture string")
    matched = accounts.match_google(users, logins)
    assert {r.email: (r.how, r.user_id) for r in matched.collect()} == {"a@x.org": ("email", "1"), "b@x.org": ("name", "2"), "n@x.org": ("new", None)}
    after = {r.email: (r.id, r.auth_provider, r.photo_url) for r in accounts.upsert_users(users, matched).collect()}
    assert after["b@x.org"] == ("2", "google", "p") and after["a@x.org"] == ("1", "google", "q") and after["n@x.org"][1:] == ("google", "r") and len(after) == 4
    hub = spark.createDataFrame([("x", "", "a@x.org", "u"), ("y", "Cy", None, "u"), ("bob", None, None, "u"), ("z", "Z", None, "u")], "login string, name string, email string, avatar_url string")
    got = {r.login: (r.how, r.user_id, r.new_email, r.email_reports) for r in accounts.match_github(users, hub).collect()}
    assert got == {"x": ("email", "1", None, False), "y": ("name", "3", None, False), "bob": ("placeholder", "2", None, False), "z": ("new", None, f"z{history.PLACEHOLDER}", False)}
    mails = spark.createDataFrame([("a", 0, "m0", False, True), ("a", 1, "m1", True, True), ("b", 0, "m2", True, False), ("b", 1, "m3", False, True)], "login string, ord int, email string, primary boolean, verified boolean")
    assert {r.login: r.email for r in accounts.best_email(mails).collect()} == {"a": "m1", "b": "m3"}
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("c1", "u", "r1", "n", "t", None, t, True)], "id string, user_id string, github_user_id string, github_username string, access_token string, avatar_url string, connected_at timestamp_ntz, is_primary boolean")
    news = spark.createDataFrame([("u", "r1", "new", "t2", "a", datetime(2024, 2, 1)), ("u", "r2", "x", "t", "a", t), ("v", "r3", "y", "t", "a", t)], "user_id string, github_user_id string, github_username string, access_token string, avatar_url string, connected_at timestamp_ntz")
    conns = {r.github_user_id: (r.github_username, r.is_primary) for r in accounts.upsert_connections(old, news).collect()}
    assert conns == {"r1": ("new", True), "r2": ("x", False), "r3": ("y", True)}
    assert history.chosen_connection(old, "u").first().id == "c1" and history.without_connection(old, "u", "c1").count() == 0


def test_views_and_mail(spark):
    u = spark.createDataFrame([("1", "a@x.org", datetime(2024, 1, 2, 3, 4, 5)), ("2", "", datetime(2024, 1, 2, 3, 4, 5, 60))], "id string, email string, created_at timestamp_ntz")
    assert [r.t for r in u.select(history.iso(F.col("created_at")).alias("t")).collect()] == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000060"]
    d = [r.d.decision for r in u.select(history.email_decision(F.lit(True), F.lit(True), F.col("email"), F.lit(True)).alias("d")).collect()]
    assert d == ["send", "skipped_placeholder"]
    assert "#ef4444" in spark.range(1).select(report.email(F.lit("s"), F.lit("HIGH"), F.lit("Ann"), F.lit("f"), F.lit(None).cast("string"))).first()[0]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 'é'")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_bytes(b"\0" * (500 * 1024 + 1))
    got = {r.path.rsplit("/", 1)[1]: (r.accepted, r.reject_reason) for r in sources.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.py": (True, None), "b.bin": (False, "binary"), "c.txt": (False, "not_utf8"), "d.txt": (False, "too_large")}


def test_repository_files(spark):
    rows = [("r", i, "blob", f"src/f{i}.py", None) for i in range(210)] + [("r", 300, "tree", "x.py", 1), ("q", 0, "blob", "Node_Modules/a.js", 1), ("q", 1, "blob", "a.JS", 512001), ("q", 2, "blob", "b.js", 512000), ("q", 3, "blob", "c.sql", 1)]
    tree = spark.createDataFrame(rows, "repo string, ord int, type string, path string, size int")
    assert {r.repo: r["count"] for r in sources.repo_files(tree).groupBy("repo").count().collect()} == {"r": 200, "q": 1}
    some = spark.createDataFrame([("r", "src/f7.py"), ("r", "nope")], "repo string, path string")
    assert sorted(r.path for r in sources.repo_files(tree, some).collect()) == ["b.js", "src/f7.py"]
    assert sources.tree_listing(tree).where("repo = 'r'").first().total_files == 210
    names = [r.n for r in spark.createDataFrame([("https://h/o/x.github.io/",), ("https://h/o/r.git",)], "u string").select(sources.repo_name(F.col("u")).alias("n")).collect()]
    assert names == ["o/x.github.io", "o/r"]


def test_webhooks(spark):
    body = '{"action": "opened", "pull_request": {"head": {"repo": {"clone_url": "u"}}}}'
    df = spark.createDataFrame([("pull_request", body), ("push", body), ("pull_request", '{"action": "closed"}'), ("pull_request", "bad")], "event string, body string")
    assert [r.clone_url for r in sources.webhooks(df).collect()] == ["u"]
    mark = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    assert [r.s for r in df.select(sources.signed(F.col("body"), F.lit(mark), b"k").alias("s")).collect()] == [True, True, False, False]


def test_whole_run(spark):
    files = spark.createDataFrame(
        [("a", 0, "old.py", "import urllib2\nprint 'hello'\n"), ("a", 1, "notes.txt", "hello"), ("b", 0, "x.go", "package main\n")], "analysis_id string, file_idx int, path string, content string"
    )
    got = analysis.analyse(files)
    by = {r.analysis_id: r for r in got["analyses"].collect()}
    assert (by["a"].total_files, by["a"].overall_risk, by["a"].total_issues, by["a"].tests_passed, by["a"].language_breakdown) == (2, "HIGH", 2, True, {"Python": 50, "Unknown": 50})
    assert by["b"].overall_risk is None
    assert {(r.issue_type, r.risk_level) for r in got["changes"].collect()} == {("print_statement", "LOW"), ("urllib2_usage", "HIGH")}
    e = analysis.evidence(got["files"], "2024-01-02T03:04:05").first()
    assert "| `print_statement` | `print 'hello'` → `print('hello')` | **LOW** |" in e.report.full_markdown and e.report.executive_summary.startswith("Analyzed old.py (Python, 2.x era).")


def test_sql_functions(spark):
    from codeloom.functions.register import register

    register(spark)
    r = spark.sql("select code_lines('a\\nb\\r\\n') l, code_occurrences('aaa', 'aa') o, code_diff('a', 'b').total_lines d, code_functions('def f(): pass', 'python') f").first()
    assert (r.l, r.o, r.d, r.f) == (["a", "b"], 1, 1, ["f"])


def test_scalars(spark):
    from codeloom.functions import scalars

    a = lambda *xs: F.array(*map(F.lit, xs))
    r = spark.range(1).select(
        scalars.round_half_up(F.lit(-2.5)).alias("n"), scalars.fixed(F.lit(2.0)).alias("f"), scalars.kilobytes(F.lit(1536)).alias("k"), scalars.toggle(a("x", "y"), F.lit("x")).alias("t"),
        scalars.toggle_all(a("x"), a("x", "y")).alias("all"), scalars.toggle_all(a("y", "x"), a("x", "y")).alias("none"), scalars.shown_time(F.lit("2024-01-02T03:04:05.6")).alias("s"),
        scalars.expiry(F.lit(datetime(2024, 1, 1)), 90).alias("e"),
    ).first()
    assert (r.n, r.f, r.k, r.t, r["all"], r.none, r.s, r.e) == (-2, "2.0", 2, ["y"], ["x", "y"], [], "2024-01-02 03:04:05", datetime(2024, 1, 1, 1, 30))
    assert scalars.together(spark.range(2).select("id"), spark.range(1).select("id", F.lit(1).alias("x"))).count() == 3


def test_files_of_a_repository_are_capped(spark):
    from codeloom.catalog import _tree
    from codeloom.sources import files as sources

    tree = _tree(spark, "/root/testdata/sf0.001")
    whole = sources.repo_files(tree).groupBy("repo").count().collect()
    few = {r.repo: r["count"] for r in sources.repo_files(tree, most=3).groupBy("repo").count().collect()}
    assert few == {r.repo: min(r["count"], 3) for r in whole}
