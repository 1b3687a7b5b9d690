"""The pipeline's stages on a small corpus, each against a plain version."""

import random
import zlib

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    ends = {"aa": ["ung", "keit", "ver", "schaft"], "bb": ["tion", "eau", "oux", "ment"]}

    def text(lang, n):
        return " ".join(rng.choice(ends[lang]) + rng.choice(ends[lang]) + rng.choice(ends[lang]) for _ in range(n))

    rows, labels = [], []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        toxic = i % 8 == 0
        rows.append((i, text(lang, 60) + (" grumbald snorvik yagnosh" if toxic else ""), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[1][1] + f" extra{i}", "aa", "s", 0) for i in range(5)]
    rows += [(2000, None, None, None, None), (2001, "", "aa", "s", 0), (2002, "123 ?!", "bb", "s", 6)]
    rows += [(3000, text("aa", 50) + " mail me@x.org now", "aa", "s", 0), (3001, rows[3][1], "aa", "s", 0), (3001, rows[3][1], "aa", "s", 0), (4000, text("bb", 3), "bb", "s", 0), (4000, text("bb", 3), "bb", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for n, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    clean = {r[0] for r in rows} - {i for i in range(400) if i % 8 == 0}
    assert set(seen["toxicity"].doc_id) == clean
    assert set(seen["language_id"].doc_id) == clean - {2000, 2001, 2002}
    gone = {1000, 1001, 1002, 1003, 1004, 3001}
    assert set(seen["near_dedup"].doc_id) == clean - {2000, 2001, 2002} - gone and (seen["near_dedup"].doc_id == 4000).sum() == 1
    after = seen["personal_data"].set_index("doc_id")
    assert "me@x.org" not in after.text[3000] and "[email]" in after.text[3000] and after.n_chars[3000] == len(after.text[3000])
    assert set(after.index) == set(seen["near_dedup"].doc_id)
    packed = seen["packing"]
    assert set(packed.doc_id) == set(after.index) and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert sorted(pipeline.run(spark, str(tmp_path)).toPandas().ids_crc32) == sorted(packed.ids_crc32)
    assert zlib.crc32(b"") == 0


def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path):
    """Empty documents; null ids; very long texts; extra columns with names that stages use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, record string, _id int, key string, held boolean, score double"
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    rng = random.Random(2)

    def text(n):
        return " ".join(rng.choice(["ung", "keit", "ver", "schaft"]) * rng.randint(1, 3) for _ in range(n))

    rows = [(i, text(30) + (" grumbald snorvik yagnosh" if i % 4 == 0 else ""), "aa", "s", 1, "r", 2, "k", True, 0.5) for i in range(40)]
    rows += [(None, text(30), "aa", "s", 1, "r", 2, "k", True, 0.5), (None, None, None, None, None, None, None, None, None, None), (50, text(30_000), "aa", "s", 1, "r", 2, "k", True, 0.5)]
    rows += [(60, "b first one two three four", "aa", "s", 1, "r", 2, "k", True, 0.5), (60, "a then five six seven eight", "aa", "s", 1, "r", 2, "k", True, 0.5)]
    full = spark.createDataFrame(rows, schema)
    for n, docs in enumerate((full, full.limit(0))):
        folder = tmp_path / str(n)
        docs.write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (name, stage) in enumerate(pipeline.STAGES):
            before = docs
            docs = stage(spark, docs, str(folder))
            if k < 4:
                assert docs.columns == before.columns
            docs.write.parquet(str(folder / name))
            docs = spark.read.parquet(str(folder / name))
            if name == "near_dedup" and n == 0:
                # Of two texts with one id the least stays, whatever came first.
                assert [r.text for r in docs.where("doc_id = 60").collect()] == ["a then five six seven eight"]
                assert docs.where("doc_id = 50").count() == 1 and docs.where("doc_id is null").count() == 1
        assert (docs.count() == 0) == (n == 1)
        assert pipeline.run(spark, str(folder)).count() == docs.count()


def test_documents_stay_where_no_language_is_known(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in pipeline.drop_unknown_languages(spark, docs, str(tmp_path)).collect()] == [1]


def test_near_duplicates_go_without_a_shuffle_of_texts(spark):
    """Few ids are sent to the documents; very many are joined by a shuffle, with the same rows."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ung", "keit", "ver", "schaft", "tion"]) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(40)]
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(texts)] + [(100 + i, t, "aa", "s", 1) for i, t in enumerate(texts[:20])]
    rows += [(3, texts[3], "bb", "s", 2), (None, texts[0], "aa", "s", 1), (200, None, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    without = [r for r in rows if r[0] != 3]
    one = pipeline.drop_near_duplicates(spark, spark.createDataFrame(without, docs.schema), "")
    plan = one._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [*(i for i in range(40) if i != 3), 103, 200]
    few, many = (sorted(map(str, pipeline.drop_near_duplicates(spark, docs, "", n).collect())) for n in (1_000_000, 0))
    assert few == many and len(few) == 42
