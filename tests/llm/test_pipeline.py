"""Each stage against a brute-force version on a small table of awkward rows."""

import os

import pytest
from test_operators import BASE, ENGLISH, FRENCH, brute_components, ids_of, targets, words

import corpus_pipeline

HERE = "/root/testdata/sf0.001"
LONG = " ".join(f"long{i}" for i in range(30000))
NEAR = [f"line {i} of a text with many lines that all differ, {i * i}" for i in range(40)]
#: doc_id, text, source and columns that stages or operators use themselves; repeated rows and nulls too
ROWS = [
    (1, BASE, "b"),
    (2, BASE.replace("w60 ", "x "), "b"),
    (3, BASE, None),
    (4, None, "a"),
    (5, "", "a"),
    (6, "one two", "a"),
    (7, ENGLISH, "c"),
    (7, ENGLISH, "c"),
    (8, FRENCH + "\nune ligne répétée ici", "c"),
    (9, "une LIGNE répétée ici\n" + " ".join(f"z{i}" for i in range(60)), "c"),
    (10, LONG, "c"),
    (11, "\n".join(NEAR), "a"),
    (12, "\n".join([*NEAR[:20], "an edited line stands here", *NEAR[21:]]), "a"),
    (13, "\n".join(NEAR), "b"),
    (None, " ".join(f"null{i}" for i in range(70)), "b"),
]
EXTRA = (False, 77, "mine", 5, "d", "f", -1)
SCHEMA = "doc_id long, text string, source string, kept boolean, n_lines long, quality_prob string, n_chars long, `a b` string, __line_doc string, component_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (7, None), (None, 1), (1, 1)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def raw(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def own(rows):
    """Columns of the user are as they were."""
    assert all((r.kept, r.n_lines, r.quality_prob, r["a b"], r["__line_doc"], r.component_id) == (False, 77, "mine", "d", "f", -1) for r in rows)
    return rows


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "source_mix", "packing"]


def test_quality_stage(spark, raw, folder):
    got = own(corpus_pipeline.keep_quality(spark, raw.where("doc_id IS NULL OR doc_id <> 7"), folder).collect())
    assert all(len(words(r.text)) >= 50 for r in got) and {4, 5, 6}.isdisjoint(r.doc_id for r in got)


def test_line_stage(spark, raw, folder):
    made = corpus_pipeline.drop_repeated_lines(spark, raw, folder)
    got = own(made.collect())
    assert made.columns == raw.columns and len(got) == len(ROWS)
    owner = {}
    for d, t, _ in ROWS:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\v\f\r").lower()
            owner.setdefault(key, set()).add(-1 if d is None else d)
    want = set()
    for d, t, _ in ROWS:
        keep = [x for x in (t or "").split("\n") if len(k := x.strip(" \t\n\v\f\r").lower()) < 10 or (-1 if d is None else d) == min(owner[k])]
        want.add((d, None if t is None else "\n".join(keep)))
    assert {(r.doc_id, r.text) for r in got} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_near_duplicate_stage(spark, raw, folder):
    """By the texts as they came, after line dedup too; one of each group stays."""
    whole = corpus_pipeline.drop_near_duplicates(spark, raw, folder)
    assert whole.columns == raw.columns
    groups = {d: c for d, _, c in brute_components([(d, t, None, None) for d, t, _ in ROWS if d is not None])}
    want = sorted((d, t) for d, t, _ in ROWS if d is not None and groups[d] == d and words(t))
    got = own(whole.collect())
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == want
    assert [r.text for r in got if r.doc_id is None] == [ROWS[-1][1]]
    stripped = corpus_pipeline.drop_repeated_lines(spark, raw, folder)
    after = own(corpus_pipeline.drop_near_duplicates(spark, stripped.checkpoint(), folder).collect())
    assert {r.doc_id for r in after} == {r.doc_id for r in got}


def test_near_duplicate_stage_keeps_one_with_words(spark, raw, folder):
    """The smallest of a group has lost its words, so the next stays."""
    from pyspark.sql import functions as F

    docs = raw.withColumn("text", F.when(F.col("doc_id") == 11, "").otherwise(F.col("text")))
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    assert 12 in got and not {11, 13} & got


def test_mix_and_packing_stages(spark, raw, folder):
    docs = raw.where("text IS NOT NULL")
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    got = own(mixed.collect())
    size, target = targets([(d, t, None, s) for d, t, s in ROWS if t is not None])
    assert mixed.columns == raw.columns
    assert sum(len(words(r.text)) for r in got) == int(1.5 * sum(size.values()))
    for s, want in target.items():
        assert abs(sum(len(words(r.text)) for r in got if r.source == s) - want) <= 64
    assert all(r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.pack_sequences(spark, raw, folder).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(t or "")) + 1 for _, t, _ in ROWS)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, raw, tmp_path, stage):
    nothing = spark.createDataFrame([], raw.schema)
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, nothing, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no driver tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, HERE)
        assert docs.columns == columns
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs
        after = docs.select("doc_id").distinct().count()
        assert 0 < after <= before
        if name in ("quality_rules", "ngram_join"):
            assert after < before
        if name == "line_dedup":
            assert after == before
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, HERE)
    assert packed.agg({"length": "sum"}).first()[0] > 0


def test_arrays_are_made_of_little_text_at_a_time():
    """The Python workers' peaks follow these sizes."""
    from graphloom.llm import ngram_join, packing, quality

    assert max(packing.ENCODED_BYTES, ngram_join.SET_SLICE, quality.FEATURE_BYTES) <= 1 << 20
