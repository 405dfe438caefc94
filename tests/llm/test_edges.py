"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardlake.llm import (fingerprints, knn_quality, langid, license_scan, line_dedup,
                          line_frequency, merkle, mixing, packing, secret_owners, simhash, spelling,
                          token_counts)
from wardlake.llm.queries import tokenizer_path
from wardlake.session import scratch_dir

LONG = "\n".join(f"line {i} of a very long text with token=abcdef{i % 7} in it" for i in range(3000))
PROSE = "The quick brown fox jumps over the lazy dog near the river bank and goes on its way home before night falls."
ROWS = [(1, PROSE, "en", "a"), (2, None, None, "a"), (3, "", "en", None), (4, " \n\t\n ", "en", "b"),
        (5, LONG, "en", "b"), (6, PROSE, "en", None), (6, PROSE, "en", None), (7, "Ünïcödé 🙂", "de", "b"),
        (7, "Another text under the same id", "en", "b"), (None, PROSE, "en", "a"),
        (None, None, None, None), (8, "AKIA" + "Z" * 20 + " 🙂 password = hunter22", "en", "c"),
        (9, "\n".join([PROSE] * 4), "en", "c"), (10, PROSE.upper(), "en", "c")]
EXTRA = ("d1", "d2", "fp", "host", "row", "pos", "size", "sid", "bucket", "rank", "length", "found",
         "keys", "sketch", "next", "content", "n_tokens", "block", "slot", "n_chars", "kept", "label")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.select("*", *(F.lit("x").alias(c) for c in EXTRA if c != "n_chars"),
                       F.lit(1).cast("long").alias("n_chars"))


def counts(spark, docs):
    return token_counts.token_counts(docs, tokenizer_path(), f"{scratch_dir(spark)}/cache")


def quality(spark, docs):
    labels = docs.select("doc_id", F.when(F.col("source") == "c", 0).otherwise(1).alias("quality"))
    return knn_quality.predict(docs, knn_quality.train(docs, labels))


OPERATORS = {
    "fingerprints": lambda s, d: fingerprints.edit_likeness(d),
    "quality": quality,
    "rules": lambda s, d: line_frequency.quality_rules(d),
    "rules with rows": lambda s, d: line_frequency.quality_rules(d, with_rows=True),
    "secrets": lambda s, d: secret_owners.secrets(d),
    "mix": lambda s, d: mixing.taken_words(d),
    "counts": counts,
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "similar": lambda s, d: simhash.similar_documents(d),
    "lines": lambda s, d: line_dedup.line_dedup(d),
    "lines with rows": lambda s, d: line_dedup.line_dedup(d, with_rows=True),
    "packing": lambda s, d: packing.pack_documents(d, tokenizer_path()),
    "language": lambda s, d: langid.predict(d, langid.train(d)),
    "licences": lambda s, d: license_scan.license_scan(d),
    "manifest": lambda s, d: merkle.manifest(d),
}


def test_spelling_on_odd_rows(spark, odd):
    """Per word, not per row: repeated rows count twice, empty tables give nothing."""
    from tests.llm.test_new_operators import brute_variants

    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
           for r in spelling.variants(odd).collect()}
    assert got == brute_variants([(r[0], r[1]) for r in ROWS]) and got["quick"][2] == 9
    assert spelling.variants(odd.where("false")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    want = sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert sorted(set(ids)) == sorted(set(want))
    if name != "packing":  # has a row for each piece
        assert ids == want


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.where("false")).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, name, stage):
    out = stage(spark, odd, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
    assert out.count() > 0
    assert stage(spark, odd.where("false"), "").collect() == []


def test_defined_results(spark, odd):
    rules = line_frequency.quality_rules(odd).where("doc_id in (2, 3, 4)").collect()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rules)
    tokens = {r.doc_id: r for r in counts(spark, odd).collect()}
    assert tokens[2].n_tokens == tokens[3].n_tokens == tokens[2].n_bytes == 0
    near = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert near[(2, 0)] == near[(3, 0)] == near[(4, 0)] == near[(None, 0)] == 2
    assert {c for (_, fp), c in near.items() if fp == near_fp(odd, 1)} == {1}
    spans = {r.doc_id: r.spans for r in secret_owners.secrets(odd).collect()}
    assert spans[2] == "" and spans[8] == "access:0:24,assign:27:46"
    mixed = mixing.taken_words(odd).collect()
    assert sum(r.taken for r in mixed) > 0 and all(r.taken <= 3 * r.size for r in mixed)
    langs = {r.doc_id: r for r in langid.predict(odd, langid.train(odd)).collect()}
    assert langs[2].lang_pred == langs[4].lang_pred == "und" and langs[2].score == 0
    like = {r.doc_id: r for r in fingerprints.edit_likeness(odd).collect()}
    assert like[2].near_next == 1.0  # two empty texts


def near_fp(odd, doc_id):
    return simhash.fingerprints(odd.where(F.col("doc_id") == doc_id)).first().fp


def test_no_examples_and_no_languages(spark, odd):
    none = odd.select("doc_id", F.lit(None).cast("int").alias("quality"))
    scores = knn_quality.predict(odd, knn_quality.train(odd, none)).collect()
    assert {r.score for r in scores} == {0.0, 0.5}
    model = langid.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(odd, model).collect()} == {"und"}
