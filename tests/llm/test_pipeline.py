"""The corpus pipeline: every stage against its own input."""

import collections
import hashlib

import corpus_pipeline
import pytest

from tidemark.llm import mixing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as run() chains them."""
    out, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{out}/{name}")
        made = spark.read.parquet(f"file://{out}/{name}")
        found[name] = (docs, made)
        docs = made
    return found


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_columns_stay(stages):
    for name, (given, made) in list(stages.items())[:-1]:
        assert made.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxic_documents_go(spark, stages):
    given, made = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(given, toxicity.fit(given, labels)).collect()}
    assert {r.doc_id for r in made.collect()} == {i for i, s in score.items() if s < corpus_pipeline.TOXIC_FROM}
    assert rows(made) <= rows(given)


def test_bad_documents_go(spark, stages):
    given, made = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.score(given, quality.fit(given, labels)).collect()}
    assert {r.doc_id for r in made.collect()} == {i for i, s in score.items() if s >= corpus_pipeline.GOOD_FROM}


def test_one_of_each_group_stays(stages):
    given, made = stages["simhash"]
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(given).collect()}
    assert sorted(r.doc_id for r in made.collect()) == sorted(set(group.values()))
    assert rows(made) <= rows(given)


def test_repeated_rows_count_once(spark, stages):
    given, made = stages["simhash"]
    assert rows(simhash.one_of_each(given.unionByName(given))) == rows(made)


def test_mix_repeats(stages):
    given, made = stages["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(given).collect()}
    assert collections.Counter(r.doc_id for r in made.collect()) == collections.Counter({i: n for i, n in copies.items() if n})


def test_encoding_is_lossless(stages):
    given, made = stages["byte_bpe"]
    want = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in given.collect())
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in made.collect()) == want
    assert all(hashlib.sha256(r.token_ids).hexdigest() == r.ids_sha256 and len(r.token_ids) == 4 * r.n_tokens for r in made.collect())


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["byte_bpe"][1].count()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_null_empty_and_long_rows_pass_every_stage(spark, tmp_path):
    """Nulls in every column, empty and long texts and repeated rows among documents: no stage fails, drops a
    column or alters a row, and the last counts no token for a text that is null or empty."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "some words of a text", None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0), (10**9 + 2, "word " * 50_000, None, "long", 9), (10**9 + 3, "twice the same row", "en", "s", 1), (10**9 + 3, "twice the same row", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        made = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert made.columns == docs.columns and set(rows(made)) <= set(rows(docs)) and made.count(), name
        docs = made
    counts = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    blank = {r.doc_id for r in docs.where("text IS NULL OR text = ''").collect()}
    assert len(counts) == docs.count() and all((r.n_tokens == 0) == (r.doc_id in blank) for r in counts)
