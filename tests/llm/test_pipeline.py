"""The pipeline on the smallest table, against what its stages should do by plain means."""

import corpus_pipeline
from tests.llm import brute
from timeloom.llm import decontam, quality

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    good = corpus_pipeline.quality_classifier(spark, docs, SF)
    forest = corpus_pipeline.trained_quality(spark, SF)
    kept = {r["doc_id"] for r in quality.score(docs, forest).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == columns
    near = corpus_pipeline.near_duplicates(spark, good, SF)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = {i for i, (_, c) in brute.jaccard_components(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == columns
    clean = corpus_pipeline.benchmark_decontamination(spark, near, SF)
    held = {r["doc_id"] for r in decontam.find(near, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == want - held and clean.columns == columns
    private = corpus_pipeline.personal_data(spark, clean, SF)
    assert private.columns == columns and private.where("n_chars <> length(text)").count() == 0
    assert private.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count() == 0
    ids = corpus_pipeline.sentencepiece_ids(spark, private, SF).collect()
    assert len(ids) == private.count() and all(r["same"] for r in ids)


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows without texts, ids or both, repeated rows, and an id with two texts.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a few plain words", None, "s", 17), (3, "a few plain words", None, "s", 17), (None, "no id at all here", None, None, 1)]


def test_nulls_empty_and_repeated_rows_give_what_they_should(spark):
    docs, nothing = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    whole = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    scores = quality.score(docs, corpus_pipeline.trained_quality(spark, SF), keep=True).collect()
    good = [tuple(r)[:5] for r in scores if r["quality_score"] >= 0.5]
    assert len(scores) == len(ODD) and whole(corpus_pipeline.quality_classifier(spark, docs, SF)) == sorted(good, key=repr)
    assert whole(corpus_pipeline.near_duplicates(spark, docs, SF)) == sorted(set(ODD), key=repr)
    assert whole(corpus_pipeline.benchmark_decontamination(spark, docs, SF)) == sorted(ODD, key=repr)
    counted = [(i, t, x, s, None if t is None else len(t)) for i, t, x, s, _ in ODD]
    assert whole(corpus_pipeline.personal_data(spark, docs, SF)) == sorted(counted, key=repr)
    ids = corpus_pipeline.sentencepiece_ids(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["text"], r["same"]) for r in ids), key=repr) == sorted(((i, t or "", True) for i, t, *_ in ODD), key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "other")
    rows = [*ODD, (5, long, "a", "s", 1), (5, long, "b", "s", 1), (5, long, "a", "s", 1), (6, near, None, None, None), (None, near, None, None, None), (None, "no id at all here", "x", None, 2)]
    rows += [(7, "first text of this id", None, None, 1), (7, long + " w60", None, None, 1), (7, "second text of this id", None, None, 1), (None, None, None, None, None), (None, None, None, None, None), (None, "", None, None, None), (1, None, "x", None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()), key=repr)
    want = [(1, None), (2, ""), (3, "a few plain words"), (5, long), (7, "first text of this id"), (7, "second text of this id"), (None, "no id at all here"), (None, None), (None, None), (None, "")]
    assert got == sorted(want, key=repr)


def test_no_contaminated_row_and_no_personal_data_stay_whatever_the_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [*ODD, (None, f"before {item} after", None, None, 1), (8, item, None, None, 1), (None, "mail me at someone@example.com now", None, None, 1), (3, "another text, call +1 555 123 4567 today", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == sorted(((i, t) for i, t, *_ in rows if not (t and item in t)), key=repr)
    texts = {r["text"]: r["n_chars"] for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert "mail me at [EMAIL] now" in texts and "another text, call [PHONE] today" in texts and "a few plain words" in texts
    assert all(n == (len(t) if t is not None else None) for t, n in texts.items())
    ids = corpus_pipeline.sentencepiece_ids(spark, docs, SF).collect()
    assert len(ids) == len(rows) and all(r["same"] for r in ids)
