"""The pipeline's stages, each on its predecessor's rows."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(i, words(rng, 60), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(200 + i, words(rng, 60).upper() + "!!", "en", "s1", 1) for i in range(60)]  # rejected
    rows += [(300 + i, rows[i][1], "en", "s2", 1) for i in range(10)]  # copies
    rows += [(400 + i, passage + " " + words(rng, 30), "en", "s0", 1) for i in range(5)]  # contaminated
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), rows[0]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "sharding" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
    clean = set(range(200))
    assert clean <= set(seen["quality"]) and not {i for i in seen["quality"] if 200 <= i < 260}
    assert clean <= set(seen["near_duplicates"]) and not {i for i in seen["near_duplicates"] if 300 <= i < 310} and seen["near_duplicates"].count(0) == 1
    assert clean <= set(seen["decontamination"]) and not {i for i in seen["decontamination"] if 400 <= i < 405}
    assert sorted(seen["mixing"]) == sorted(seen["sharding"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sharding"])


def test_null_and_repeated_ids_are_judged_by_their_own_text(spark, tmp_path):
    rng = random.Random(3)
    passage = words(rng, 40)
    text = [words(rng, 60) for _ in range(6)]
    held = passage + " " + words(rng, 10)
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (7, text[2]), (8, text[4]), (None, text[4]), (3, text[3]), (9, held), (None, held + " more"), (9, text[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wordless = spark.createDataFrame([(None, None, "en", "s", 1)] * 2 + [(4, "", "en", "s", 1)] * 2, DOCS)
    assert corpus_pipeline.keep_one_of_each(spark, wordless, str(tmp_path)).count() == 4
    got = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id or 0, r.text) for r in got.collect()))
    assert kept == sorted([(0, text[0]), (0, text[1]), (7, text[2]), (3, text[3]), (8, text[4]), (9, held), (9, text[5])])
    clean = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.keep_uncontaminated(spark, docs, str(tmp_path)).collect())
    assert clean == sorted((i or 0, t) for i, t in rows if passage not in t)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    names = ["_key", "_key_dropped", "_number", "_kept", "class_id", "rows", "times", "doc"]
    docs = spark.createDataFrame([(i, f"some words of row {i} " * 8, "en", "s", 1) for i in range(6)], DOCS)
    for name in names:
        docs = docs.selectExpr("*", f"7 as {name}")
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for rows, left in ((docs, 6), (docs.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert out.count() == left
            assert name == "sharding" or out.columns == docs.columns
