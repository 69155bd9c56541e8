"""The pipeline's stages take effect, keep the columns, and run in the order agreed on."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import registry


def _tables(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}{c}n" for a in "bcdfghklm" for b in "aeiou" for c in "lrst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    item = prose(40)
    rows = [(i, prose(rng.randrange(60, 200)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(5)]
    rows += [(200, prose(50) + " " + item + " " + prose(50), "en", "s1", 0), (300, "too short", "en", "s1", 0), (301, None, None, None, None), (400, prose(80) + " a.1@mail2.example.com", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = _tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        ids[name] = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns
    assert ids["quality"] == {r[0] for r in rows} - {300, 301}
    assert ids["near_duplicates"] == ids["quality"] - set(range(100, 105))
    assert ids["decontaminate"] == ids["near_duplicates"] - {200} == ids["personal_data"]
    assert "a.1@mail2" not in docs.where("doc_id = 400").first().text
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ids["personal_data"] and abs(sum(r.taken for r in got) / sum(r["size"] for r in got) - 1.5) < 0.02


def test_registry():
    assert sorted(registry.QUERIES) == sorted(f"op{n}_{x}" for n, x in ((1, "decontaminate"), (2, "toxicity"), (3, "chat"), (4, "simhash"), (5, "pii"), (6, "secrets"), (7, "mixing"), (8, "suffixes"), (9, "urls"), (10, "quality"), (11, "sharding"), (12, "audit"), (13, "fim")))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """No documents give no rows of the same schema; columns named like the stages' own pass through."""
    _tables(spark, tmp_path / "full")
    full = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    (tmp_path / "none").mkdir()
    full.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "full" / "benchmark.parquet")).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    docs = full.limit(30).withColumns({c: F.lit(c) for c in ("q_kept", "leaks", "node", "chosen", "seen", "replaced", "n_email", "text_mark", "lost_id", "print")})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "full"))
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r.q_kept == "q_kept" and r.lost_id == "lost_id" and r.n_email == "n_email" for r in rows)


def test_the_result_has_cleaned_texts(spark, tmp_path):
    _tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.text and r.lang == "en" and r["size"] == len(r.text.split()) for r in got) and not any("a.1@mail2" in r.text for r in got)


def test_nothing_but_the_result_is_left(spark, tmp_path):
    """A run leaves one folder with its last stage in the shared folder, whatever its stages cut on their way."""
    import os

    _tables(spark, tmp_path)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and os.listdir(os.path.join(shared, *left)) == ["4-mixing"]
