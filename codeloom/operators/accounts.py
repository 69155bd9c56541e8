"""Upserts of accounts and connections as joins by priority (UPD-1 to UPD-3, UPD-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import PLACEHOLDER, real_address
from .identity import account_id


def best_email(emails: DataFrame, key: str = "login") -> DataFrame:
    """The primary verified address, else the first verified one (UPD-5), from ``(key, ord, email, primary, verified)``."""
    rank = F.struct(F.when(F.col("primary"), 0).otherwise(1).alias("r"), F.col("ord"))
    return emails.where("verified").groupBy(key).agg(F.min_by("email", rank).alias("email"))


def _numbered(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def match_google(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Logins ``(email, name, picture)`` with the account they belong to and how: email, name or new (UPD-1).

    By name only accounts count that came from the code host and have a placeholder address.
    """
    by_email = users.select(F.col("email"), F.col("id").alias("_e"))
    spare = users.where((F.col("auth_provider") == "github") & ~real_address(F.col("email"))).groupBy("name").agg(F.min("id").alias("_n"))
    out = logins.join(by_email, "email", "left").join(spare, "name", "left")
    how = F.when(F.col("_e").isNotNull(), "email").when(F.col("_n").isNotNull() & (F.coalesce("name", F.lit("")) != ""), "name").otherwise("new")
    return out.withColumn("how", how).withColumn("user_id", F.when(F.col("how") == "email", F.col("_e")).when(F.col("how") == "name", F.col("_n"))).drop("_e", "_n")


def match_github(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Logins ``(login, name, email, avatar_url)`` with account, way and, if new, address and mail setting (UPD-2).

    In order: a real address, a Google account of the same name, the login's placeholder address.
    """
    named = logins.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("login"))).withColumn("placeholder", F.concat("login", F.lit(PLACEHOLDER)))
    real = real_address(F.col("email"))
    by_email = users.select(F.col("email").alias("_email"), F.col("id").alias("_e"))
    by_name = users.where(F.col("auth_provider") == "google").groupBy("name").agg(F.min("id").alias("_n"))
    by_mark = users.select(F.col("email").alias("placeholder"), F.col("id").alias("_p"))
    out = named.join(by_email, real & (F.col("email") == F.col("_email")), "left").join(by_name, "name", "left").join(by_mark, "placeholder", "left")
    how = F.when(F.col("_e").isNotNull(), "email").when(F.col("_n").isNotNull(), "name").when(F.col("_p").isNotNull(), "placeholder").otherwise("new")
    out = out.withColumn("how", how).withColumn("user_id", F.coalesce("_e", "_n", "_p"))
    fresh = F.when(F.col("how") == "new", F.when(real, F.col("email")).otherwise(F.col("placeholder")))
    return out.withColumn("new_email", fresh).withColumn("email_reports", real_address(F.col("new_email"))).select(*named.columns, "how", "user_id", "new_email", "email_reports")


def upsert_users(users: DataFrame, matched: DataFrame) -> DataFrame:
    """Users after Google logins matched by :func:`match_google`: those matched updated, one new one an address.

    Where order matters within the batch, see :mod:`.identity`.
    """
    ups = matched.where("user_id is not null").select(F.col("user_id").alias("id"), F.col("email").alias("_email"), F.col("picture").alias("_photo"))
    merged = users.join(ups.dropDuplicates(["id"]), "id", "left")
    old = merged.select(
        *[
            F.coalesce("_email", "email").alias(c) if c == "email" else F.coalesce("_photo", "photo_url").alias(c) if c == "photo_url"
            else F.when(F.col("_email").isNotNull(), "google").otherwise(F.col(c)).alias(c) if c == "auth_provider" else F.col(c)
            for c in users.columns
        ]
    )
    one = matched.where("how = 'new'").groupBy("email").agg(F.min(F.struct(F.coalesce("name", "email").alias("name"), F.col("picture").alias("photo_url"))).alias("u"))
    new = one.select(account_id(F.col("email")).alias("id"), "email", "u.name", "u.photo_url", F.lit("google").alias("auth_provider"))
    return old.unionByName(new, allowMissingColumns=True)


def upsert_connections(connections: DataFrame, news: DataFrame) -> DataFrame:
    """Connections after ``news(user_id, github_user_id, github_username, access_token, avatar_url, connected_at)`` (UPD-3).

    One row a user and remote id, the newest data; a user's first connection stays or becomes the primary one.
    """
    key = ["user_id", "github_user_id"]
    old = connections.withColumn("_new", F.lit(0))
    add = news.withColumns({"_new": F.lit(1), "id": F.sha2(F.concat_ws(":", *key), 256), "is_primary": F.lit(False)})
    both = old.unionByName(add, allowMissingColumns=True)
    latest = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col("connected_at").desc())
    oldest = Window.partitionBy(*key).orderBy("_new", "connected_at")
    one = both.withColumns({"_n": F.row_number().over(latest), "id": F.first("id").over(oldest), "connected_at": F.first("connected_at").over(oldest), "_was": F.max("is_primary").over(Window.partitionBy(*key))})
    one = one.where("_n = 1")
    mine = Window.partitionBy("user_id")
    first = F.row_number().over(mine.orderBy("connected_at", "id")) == 1
    return one.withColumn("is_primary", F.col("_was") | (~F.max("_was").over(mine) & first)).select(*connections.columns)
