"""Files that enter an analysis (SRC-1 to SRC-5, SRC-7, SRC-8) and results that leave it (SNK-1 to SNK-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..operators.language import extension


def uploads(files: DataFrame) -> DataFrame:
    """``(path, accepted, reject_reason, content)`` from Spark's binaryFile columns (SRC-1): size, then NUL, then UTF-8."""
    body = F.col("content")
    reason = (
        F.when(F.col("length") > rules.MAX_FILE_KB * 1024, "too_large")
        .when(F.instr(F.substring(body, 1, 8192), F.lit(b"\x00")) > 0, "binary")
        .when(~F.is_valid_utf8(body.cast("string")), "not_utf8")
    )
    return files.select("path", reason.isNull().alias("accepted"), reason.alias("reject_reason"), F.when(reason.isNull(), body.cast("string")).alias("content"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """:func:`uploads` of a folder."""
    return uploads(spark.read.format("binaryFile").load(path))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of whole files, errors ignored (SRC-5)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def supported(path: Column) -> Column:
    """Whether a repository's file of this extension is read."""
    return extension(path).isin(*rules.REPO_EXTENSIONS)


def excluded(path: Column) -> Column:
    """Whether the path has a marker of generated or foreign code."""
    return F.exists(F.array(*map(F.lit, rules.EXCLUDED_PATHS)), lambda m: F.contains(F.lower(path), m))


def repo_files(tree: DataFrame, selected: DataFrame | None = None, keys: tuple[str, ...] = ("repo",), most: int = rules.MAX_REPO_FILES) -> DataFrame:
    """The first files of each repository's tree that are to be read (SRC-2, JOIN-13).

    ``tree(*keys, ord, type, path, size)``; ``selected(*keys, path)`` restricts it where it has rows of a repository. Cheap
    tests come first, contents are for the caller to fetch afterwards.
    """
    blobs = tree.where((F.col("type") == "blob") & supported(F.col("path")) & (F.coalesce("size", F.lit(0)) <= rules.MAX_FILE_KB * 1024) & ~excluded(F.col("path")))
    if selected is not None:
        some = selected.select(*keys, F.lit(True).alias("_some")).distinct()
        mine = selected.select(*keys, "path", F.lit(True).alias("_mine")).distinct()
        blobs = blobs.join(some, list(keys), "left").join(mine, [*keys, "path"], "left").where("_some is null or _mine").drop("_some", "_mine")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return blobs.withColumn("file_idx", place).where(F.col("file_idx") <= most)


def tree_listing(tree: DataFrame, keys: tuple[str, ...] = ("repo",), most: int = 200) -> DataFrame:
    """The first source files of each tree with the number of all of them (SRC-3)."""
    blobs = tree.where((F.col("type") == "blob") & supported(F.col("path")))
    w = Window.partitionBy(*keys)
    out = blobs.withColumns({"total_files": F.count(F.lit(1)).over(w), "_n": F.row_number().over(w.orderBy("ord"))})
    return out.where(F.col("_n") <= most).drop("_n")


def repo_name(url: Column) -> Column:
    """owner/name of a repository's address; only a final ``.git`` goes (STR-FN-6, on purpose)."""
    clean = F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", "")
    parts = F.split(clean, "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))


def hmac_sha256(body: Column, secret: bytes | Column) -> Column:
    """HMAC-SHA256 in lower-case hex, in the JVM; the secret may be a binary column (one a sender)."""
    secret = F.lit(secret) if isinstance(secret, bytes) else secret
    key = F.when(F.length(secret) > 64, F.unhex(F.sha2(secret, 256))).otherwise(secret)
    digits = F.rpad(F.hex(key), 128, "0")

    def pad(mask: int) -> Column:
        byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mask))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))

    inner = F.sha2(F.concat(pad(0x36), body.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def signed(body: Column, signature: Column, secret: bytes | Column) -> Column:
    """Whether a body has this signature, ``sha256=`` and its HMAC; a null body is empty, a null signature is none."""
    made = F.concat(F.lit("sha256="), hmac_sha256(F.coalesce(body, F.lit("")), secret))
    return F.coalesce(made == signature, F.lit(False))


def webhooks(events: DataFrame) -> DataFrame:
    """Opened or updated pull requests of ``events(event, body)`` with the repository to clone (SRC-7)."""
    kind = "struct<action:string,pull_request:struct<head:struct<repo:struct<clone_url:string>>>>"
    read = events.where(F.col("event") == "pull_request").withColumn("_b", F.from_json("body", kind))
    return read.where(F.col("_b.action").isin("opened", "synchronize")).select("*", F.col("_b.action").alias("action"), F.col("_b.pull_request.head.repo.clone_url").alias("clone_url")).drop("_b")


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """Rows of these key values (SRC-8)."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def append(df: DataFrame, path: str) -> None:
    """Append rows to a stored table (SNK-1, SNK-2)."""
    df.write.mode("append").parquet(path)


def replace_rows(stored: DataFrame, news: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows with those of ``news`` in place of theirs, and its new ones (SNK-3)."""
    return stored.join(news.select(key), key, "left_anti").unionByName(news, allowMissingColumns=True)
