"""The pipeline's stages against plain versions, and on awkward rows."""

import zlib

from pulsemill.llm import common, quality_rules, queries, toxicity

import corpus_pipeline

from .test_operators import ODD, check_pieces, plain_components, plain_fingerprint, plain_similar, plain_stats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_dedup", "packing"]
    all_docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    a = corpus_pipeline.quality(spark, all_docs, SF)
    rules = quality_rules.fit(all_docs, labels)
    judged = {r.doc_id: r for r in quality_rules.judge(all_docs, rules).collect()}
    kept = {r.doc_id for r in a.collect()}
    assert a.columns == all_docs.columns and kept == {d for d, r in judged.items() if r.kept}
    for r in all_docs.collect():
        n, _, _, _, rep = plain_stats(r.text)
        assert judged[r.doc_id].base_failed == (n < 50 or 100 * rep > 50 * n)
    a = common.written(a, "a")
    b = common.written(corpus_pipeline.without_toxic(spark, a, SF), "b")
    scores = {r.doc_id: r.s for r in toxicity.score(a, toxicity.fit(a, labels), out="s").collect()}
    assert b.columns == all_docs.columns and {r.doc_id for r in b.collect()} == {d for d, s in scores.items() if s < 0.3}
    c = corpus_pipeline.without_copies(spark, b, SF)
    fp = {r.doc_id: plain_fingerprint(r.text) for r in b.collect()}
    ids = sorted(fp)
    similar = plain_similar({r.doc_id: r.text for r in b.collect()})
    comp = plain_components(ids, similar + [(x, y) for x in ids for y in ids if x < y and (fp[x] ^ fp[y]).bit_count() <= 3])
    assert c.columns == all_docs.columns and sorted(r.doc_id for r in c.collect()) == [d for d in ids if comp[d] == d]


def test_run_packs_all_that_is_left(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    ids = {d: tok.encode(texts[d], add_special_tokens=False).ids + [0] for d in {r.doc_id for r in pieces}}
    check_pieces(pieces, ids)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s, _ in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    d = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = common.written(stage(spark, d, SF), "odd")
        assert d.columns == rows.columns
    none = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def words(prefix, n=60):
    return " ".join(f"{prefix}{k}" for k in range(n))


def as_documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")


def test_repeated_and_null_ids_stay_defined(spark):
    t = words("w")
    rows = as_documents(spark, [(1, t), (1, t), (2, t), (None, t), (3, t + " and more words here than before " * 9), (4, words("x")), (None, words("y"))])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text[0]) for r in corpus_pipeline.without_copies(spark, rows, SF).collect())
    assert got == [(False, 1, "w"), (False, 4, "x"), (True, 0, "y")]  # row 3 shares 56 of 66 shingles with row 1


def test_rows_with_one_id_and_different_texts_stay(spark):
    rows = as_documents(spark, [(5, words("a")), (5, words("b")), (6, words("a")), (7, words("b") + " end"), (None, words("c")), (8, words("c"))])
    got = sorted((r.doc_id, r.text[0]) for r in corpus_pipeline.without_copies(spark, rows, SF).collect())
    assert got == [(5, "a"), (5, "b"), (8, "c")]
