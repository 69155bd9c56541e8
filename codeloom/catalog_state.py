"""Queries that keep state: streams, versioned tables, accounts, and what comes in from outside.

As in :mod:`.catalog`, every query has a fixture of the driver's tables and SQL that says the rest independently.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .operators import identity
from .operators.history import PLACEHOLDER
from .plans import fixtures
from .registry import query
from .sources import files as sources
from .sources.tables import Table, shared_folder
from .streaming import trace

# --- streams ------------------------------------------------------------------------------------------------------

_LONGEST = "3 days"

#: Bytes of arrived files that a micro-batch takes. A batch opens and commits every state partition whatever it holds, so with a number of files
#: a batch there were as many batches, and commits of all state, as the tasks that wrote the files.
_BATCH_BYTES = 256 << 20


@query(f"""WITH {fixtures.SQL_TRACE}, l AS (SELECT *, lag(type) OVER w AS before, lag(ts) OVER w AS started FROM trace WINDOW w AS (PARTITION BY analysis_id, file, layer ORDER BY ts, seq))
SELECT analysis_id, layer, status, CAST(floor((epoch_us(ts) - epoch_us(started)) / 1000) AS BIGINT) AS duration_ms FROM l
WHERE type = 'layer_end' AND before = 'layer_start' AND ts <= started + INTERVAL {_LONGEST}""")
def stream_layer_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations by a join of two streams into an exactly-once sink (STR-2, STR-3, STR-5, SNK-8): four arrivals of files, a restart after two."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = trace.numbered(fixtures.trace(spark, sf_dir))
    events.write.parquet(f"{base}/events")
    events = spark.read.parquet(f"{base}/events")
    first, last, n = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count(F.lit(1))).first()
    width = ((last or 0) - (first or 0)) // 4 + 1
    sink = Table(spark, f"{base}/sink", trace.join_durations(events, longest=_LONGEST).schema, list(trace.KEYS), buckets=16)
    arrival = F.floor((F.unix_micros("ts") - F.lit(first or 0)) / F.lit(width))
    for k in range(4):
        events.where(arrival == k).write.mode("append").parquet(f"{base}/arrivals")
        if k % 2:
            arrived = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", _BATCH_BYTES).parquet(f"{base}/arrivals")
            pairs = trace.join_durations(arrived, delay=f"{2 * width} microseconds", longest=_LONGEST)
            trace.fan_out(pairs, sink.sink("durations"), f"{base}/checkpoint", partitions=trace.state_partitions(spark, n)).awaitTermination()
    return sink.read().select("analysis_id", "layer", "status", "duration_ms")


# --- a versioned table --------------------------------------------------------------------------------------------


@query(f"""WITH {fixtures.SQL_ANALYSES}, stored AS (SELECT id, user_id, status, language FROM analyses), news AS (
  SELECT id, user_id, 'complete' AS status, 'Go' AS language FROM stored WHERE id % 3 = 0 UNION ALL SELECT id + 100000000, user_id, 'pending', NULL FROM stored WHERE id % 10 = 1)
SELECT * FROM news WHERE user_id % 13 > 0 UNION ALL SELECT * FROM stored WHERE user_id % 13 > 0 AND id % 3 > 0""")
def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses inserted, then updated and added to, then deleted by user (SNK-1, SNK-3, UPD-9); a version each."""
    a = fixtures.analyses(spark, sf_dir).select("id", "user_id", "status", "language")
    table = Table(spark, f"{shared_folder(spark)}/analyses-{uuid.uuid4().hex}", a.schema, ["id"])
    table.append(a)
    done = a.where("id % 3 = 0").withColumns({"status": F.lit("complete"), "language": F.lit("Go")})
    more = a.where("id % 10 = 1").withColumns({"id": F.col("id") + 100_000_000, "status": F.lit("pending"), "language": F.lit(None).cast("string")})
    table.merge(done.unionByName(more))
    table.delete(table.read().where("user_id % 13 = 0").select("id"))
    return table.read()


# --- accounts -----------------------------------------------------------------------------------------------------


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    google = k % 3 == 1
    return fixtures.read(spark, sf_dir, "customer").where(k % 3 < 2).select(
        k.cast("string").alias("id"), F.when(google, F.concat(F.lit("u"), k, F.lit("@example.com"))).otherwise(F.concat(F.lit("l"), k, F.lit(PLACEHOLDER))).alias("email"),
        F.concat(F.lit("n"), k % 90).alias("name"), F.when(k % 2 == 0, "p").alias("photo_url"), F.when(google, "google").otherwise("github").alias("auth_provider"), google.alias("email_reports"),
    )


def _logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return fixtures.read(spark, sf_dir, "orders").select(
        o.alias("ord"), F.concat(F.lit("l"), c).alias("login"), F.when(o % 4 > 0, F.concat(F.lit("n"), o % 300)).when(o % 8 == 0, "").alias("name"),
        F.when(o % 5 < 3, F.concat(F.lit("u"), c, F.lit("@example.com"))).when(o % 5 == 3, "").alias("email"), F.when(o % 3 > 0, F.concat(F.lit("a"), o)).alias("avatar_url"),
    )


_RESOLVED = f"""users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 1 THEN concat('u', c_custkey, '@example.com') ELSE concat('l', c_custkey, '{PLACEHOLDER}') END AS email,
    concat('n', c_custkey % 90) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS photo_url, CASE WHEN c_custkey % 3 = 1 THEN 'google' ELSE 'github' END AS auth_provider, c_custkey % 3 = 1 AS email_reports
  FROM customer WHERE c_custkey % 3 < 2
), logins AS (
  SELECT o_orderkey AS ord, concat('l', o_custkey) AS login, CASE WHEN o_orderkey % 4 > 0 THEN concat('n', o_orderkey % 300) ELSE concat('l', o_custkey) END AS name,
    CASE WHEN o_orderkey % 5 < 3 THEN concat('u', o_custkey, '@example.com') END AS mail, concat('l', o_custkey, '{PLACEHOLDER}') AS mark, CASE WHEN o_orderkey % 3 > 0 THEN concat('a', o_orderkey) END AS avatar_url
  FROM orders
), by_mail AS (
  SELECT l.*, u.id AS mailed, u.auth_provider AS provider, p.id AS marked FROM logins l LEFT JOIN users u ON u.email = l.mail LEFT JOIN users p ON p.email = l.mark
), called AS (
  SELECT id, name, since, coalesce(lead(since) OVER (PARTITION BY id ORDER BY since), 9000000000000000000) AS until FROM (
    SELECT id, name, -1 AS since FROM users WHERE auth_provider = 'google' UNION ALL SELECT mailed, name, ord FROM by_mail WHERE provider = 'google')
), by_name AS (
  SELECT b.*, (SELECT min(c.id) FROM called c WHERE c.name = b.name AND c.since < b.ord AND b.ord <= c.until) AS named FROM by_mail b
), by_mark AS (
  SELECT *, min(CASE WHEN mail IS NULL AND named IS NULL AND marked IS NULL THEN ord END) OVER (PARTITION BY mark) AS mark_made FROM by_name
), made AS (
  SELECT *, min(CASE WHEN mail IS NOT NULL AND mailed IS NULL AND named IS NULL AND marked IS NULL AND coalesce(mark_made, ord) >= ord THEN ord END) OVER (PARTITION BY mail) AS mail_made FROM by_mark
), resolved AS (
  SELECT ord, login, name, mail, mark, avatar_url, CASE WHEN mailed IS NOT NULL OR (mail IS NOT NULL AND mail_made < ord) THEN 'email' WHEN named IS NOT NULL THEN 'name' WHEN marked IS NOT NULL OR mark_made < ord THEN 'placeholder' ELSE 'new' END AS how,
    coalesce(CASE how WHEN 'email' THEN mailed WHEN 'name' THEN named WHEN 'placeholder' THEN marked END,
      left(sha256('account:' || CASE WHEN how = 'placeholder' THEN mark ELSE coalesce(mail, mark) END), 32)) AS user_id FROM made
)"""


@query(f"WITH {_RESOLVED} SELECT ord, how, user_id FROM resolved")
def github_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who logs in from the code host, each login after the ones before (UPD-2)."""
    return identity.resolve_github(_users(spark, sf_dir), _logins(spark, sf_dir)).select("ord", "how", "user_id")


@query(f"""WITH {_RESOLVED}, last AS (
  SELECT user_id, arg_max(name, ord) AS name, arg_max(avatar_url, ord) FILTER (avatar_url IS NOT NULL) AS photo FROM resolved WHERE how = 'email' GROUP BY user_id
), every AS (
  SELECT * FROM users UNION ALL SELECT user_id, coalesce(mail, mark), name, avatar_url, 'github', mail IS NOT NULL FROM resolved WHERE how = 'new')
SELECT id, email, coalesce(l.name, e.name) AS name, coalesce(l.photo, photo_url) AS photo_url, auth_provider, email_reports FROM every e LEFT JOIN last l ON l.user_id = e.id""")
def github_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts after the logins (UPD-2)."""
    users = _users(spark, sf_dir)
    return identity.apply_github(users, identity.resolve_github(users, _logins(spark, sf_dir)))


@query(f"""WITH {_RESOLVED}, own AS (SELECT user_id, login, arg_max(avatar_url, ord) FILTER (true) AS a, max(ord) AS latest, min(ord) AS first FROM resolved GROUP BY user_id, login)
SELECT user_id, login AS github_user_id, concat('t', latest) AS access_token, first = min(first) OVER (PARTITION BY user_id) AS is_primary FROM own""")
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections after the logins: the newest token, the first one primary (UPD-3)."""
    got = identity.resolve_github(_users(spark, sf_dir), _logins(spark, sf_dir))
    news = got.select("ord", "user_id", F.col("login").alias("github_user_id"), F.col("login").alias("github_username"), F.concat(F.lit("t"), "ord").alias("access_token"), "avatar_url")
    none = spark.createDataFrame([], "id string, user_id string, github_user_id string, github_username string, access_token string, avatar_url string, is_primary boolean")
    return identity.connect(none, news).select("user_id", "github_user_id", "access_token", "is_primary")


@query(f"""WITH users AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 1 THEN concat('u', c_custkey, '@example.com') ELSE concat('l', c_custkey, '{PLACEHOLDER}') END AS email,
    concat('n', c_custkey % 90) AS name, c_custkey % 3 = 0 AS spare FROM customer WHERE c_custkey % 3 < 2),
logins AS (SELECT o_orderkey AS ord, concat('u', o_custkey, '@example.com') AS email, CASE WHEN o_orderkey % 4 > 0 THEN concat('n', o_orderkey % 300) END AS name FROM orders),
firsts AS (SELECT email, arg_min(coalesce(name, ''), ord) AS name, min(ord) AS ord FROM logins WHERE email NOT IN (SELECT email FROM users) GROUP BY email),
spares AS (SELECT name, min(id) AS id FROM users WHERE spare GROUP BY name),
taken AS (SELECT s.id, arg_min(f.email, f.ord) AS email FROM firsts f JOIN spares s USING (name) GROUP BY s.id)
SELECT l.ord, CASE WHEN u.id IS NOT NULL OR l.ord > f.ord THEN 'email' WHEN t.id IS NOT NULL THEN 'name' ELSE 'new' END AS how, coalesce(u.id, t.id, left(sha256('account:' || l.email), 32)) AS user_id
FROM logins l LEFT JOIN users u USING (email) LEFT JOIN firsts f USING (email) LEFT JOIN taken t USING (email)""")
def google_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who logs in by address, each login after the ones before (UPD-1)."""
    o = F.col("o_orderkey")
    logins = fixtures.read(spark, sf_dir, "orders").select(
        o.alias("ord"), F.concat(F.lit("u"), "o_custkey", F.lit("@example.com")).alias("email"), F.when(o % 4 > 0, F.concat(F.lit("n"), o % 300)).alias("name"), F.lit("p").alias("picture")
    )
    return identity.resolve_google(_users(spark, sf_dir), logins).select("ord", "how", "user_id")


# --- from outside -------------------------------------------------------------------------------------------------

_SECRET = b"webhook secret"
_PADS = ["".join(f"{b ^ mask:02x}" for b in _SECRET.ljust(64, b"\0")) for mask in (0x36, 0x5C)]
_BODY = """concat('{"action": "', ['opened', 'closed', 'synchronize', 'labeled'][page_id % 4 + 1], '", "pull_request": {"head": {"repo": {"clone_url": "', url, '"}}}}')"""


@query(f"""WITH sent AS (
  SELECT page_id, url, CASE WHEN page_id % 6 < 4 THEN 'pull_request' ELSE 'push' END AS event, {_BODY} AS body FROM pages WHERE url IS NOT NULL AND NOT contains(url, '"') AND NOT contains(url, chr(92))
), marked AS (SELECT *, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(body)))) AS mac FROM sent)
SELECT page_id, mac AS signature, ['opened', 'closed', 'synchronize', 'labeled'][page_id % 4 + 1] AS action, url AS clone_url FROM marked
WHERE page_id % 7 > 0 AND event = 'pull_request' AND page_id % 4 IN (0, 2)""")
def webhook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed pull-request events with the repository to clone (SRC-7); a seventh of them have a wrong signature."""
    k = F.col("page_id")
    action = fixtures.pick(("opened", "closed", "synchronize", "labeled"), k % 4)
    body = F.concat(F.lit('{"action": "'), action, F.lit('", "pull_request": {"head": {"repo": {"clone_url": "'), "url", F.lit('"}}}}'))
    plain = F.col("url").isNotNull() & ~F.contains("url", F.lit('"')) & ~F.contains("url", F.lit("\\"))
    sent = fixtures.read(spark, sf_dir, "pages").where(plain).select(k, F.when(k % 6 < 4, "pull_request").otherwise("push").alias("event"), body.alias("body"))
    sent = sent.withColumn("signature", F.concat(F.lit("sha256="), sources.hmac_sha256(F.when(k % 7 > 0, F.col("body")).otherwise("other"), _SECRET)))
    got = sources.webhooks(sent.where(sources.signed(F.col("body"), F.col("signature"), _SECRET)))
    return got.select("page_id", F.substring("signature", 8, 64).alias("signature"), "action", "clone_url")


@query(f"""WITH files AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN {rules.MAX_FILE_KB} * 1024 + doc_id % 2 ELSE strlen(text) END AS length,
  doc_id % 7 = 0 AS nul, doc_id % 5 = 0 AS broken FROM documents WHERE text IS NOT NULL)
SELECT doc_id, reason IS NULL AS accepted, reason AS reject_reason, CASE WHEN reason IS NULL THEN md5(encode(text) || CASE WHEN nul THEN '\\x00'::BLOB ELSE ''::BLOB END) END AS digest FROM (
  SELECT *, CASE WHEN length > {rules.MAX_FILE_KB} * 1024 THEN 'too_large' WHEN nul AND strlen(text) < 8192 THEN 'binary' WHEN broken THEN 'not_utf8' END AS reason FROM files)""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that are too large, binary or no UTF-8 (SRC-1): documents, some with a NUL or a stray byte at their end."""
    k, raw = F.col("doc_id"), F.col("text").cast("binary")
    docs = fixtures.read(spark, sf_dir, "documents").where("text IS NOT NULL")
    size = F.when(k % 11 == 0, rules.MAX_FILE_KB * 1024 + k % 2).otherwise(F.octet_length("text"))
    body = F.concat(raw, F.when(k % 7 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.when(k % 5 == 0, F.lit(b"\xff")).otherwise(F.lit(b"")))
    got = sources.uploads(docs.select(k.cast("string").alias("path"), size.alias("length"), body.alias("content")))
    return got.select(F.col("path").cast("long").alias("doc_id"), "accepted", "reject_reason", F.md5(F.col("content").cast("binary")).alias("digest"))
