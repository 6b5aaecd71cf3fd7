"""Each operator against a plain version on small tables with awkward rows; the contract queries over a small test table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.llm import common, embedding_dedup, license_scan, packing, quality_ranking, quality_rules, queries, sentencepiece_codec, sharding, shingle_join, simhash, text_stats, token_counts, toxicity

SF = "/root/testdata/sf0.001"
MODEL = queries.vocabulary("piece_bpe_32k.model")
LONG = " ".join(f"word{k % 997} the," for k in range(30_000))
ODD = [
    (1, None, None, "x"), (2, "", "a", None), (3, "   \n\t ", "a", "x"), (4, "Released under the MIT License.", "a", "x"), (5, "Apache License,\nVersion 2 and under the mit license; CC-BY-NC", "b", "x"),
    (6, LONG, "a", "x"), (7, LONG, "a", "x"), (8, "naïve ÀB ▁x 中文字 😀 </s> <|endoftext|>", "b", "x"), (9, "one two", "b", "x"), (9, "one two", "b", "x"), (None, "a null id", "b", "x"), (10, "a" * 5000, "a", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty and a very long text, repeated rows, and extra columns whose names clash with results."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, score string").withColumns({"ids": F.lit(1), "n_words": F.lit(2), "fp": F.lit(3), "shard": F.lit(4)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def docs(spark):
    return common.table(spark, SF, "documents")


def oracle(sql):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    cols, rows = oracle(queries.ORACLE[name])
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))


# ------------------------------------------------------------------ 1


def plain_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words, places, labels = find(low), [], set()
    for p, label in license_scan.BASE_PHRASES.items():
        at = [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places += at
        labels |= {label} if at else set()
    more, end, reach = set(), 0, license_scan.words_around(license_scan.TEMPLATES)
    for line in low.split("\n"):
        n = len(find(line))
        end += n
        for have in (set(words[end - n : end]), set(words[max(end - n, end - reach) : end + reach])) if n else ():
            for label, t, threshold in license_scan.TEMPLATES:
                if len(have & set(t.split())) >= threshold * len(set(t.split())):
                    more.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


def test_license_scan(spark, odd, none):
    got = license_scan.scan(odd).collect()
    want = [(d, *plain_license(t)) for d, t, _, _ in ODD]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got)
    assert {r.doc_id: r.score for r in got}[5] == 1.0 and license_scan.scan(none).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    cc0 = "To the extent possible under law, the author has waived all copyright and\n\n# related or neighboring rights to this work."
    texts = [mit, bsd, cc0, "before it\n" + "\n".join(bsd.split()) + "\nafter it", "redistribution of binary files\n" + "other words\n" * 40 + "modification is permitted"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(rows).collect()} == {0: "mit", 1: "bsd", 2: "cc0", 3: "bsd", 4: ""}


def test_license_scan_near_misses(spark):
    """A notice with one word replaced is over the threshold; other versions and licenses aren't, and template chunks don't matter."""
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this work and associated documentation files"
    texts = [mit, "this work is licensed under the gnu general public license version 2", "licensed under the gnu license version 2.0", "copyright reserved", mit + " x" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {0: "mit", 1: "", 2: "", 3: "", 4: "mit"}
    assert {r.doc_id: r.labels for r in license_scan.scan(rows).collect()} == want
    assert {r.doc_id: r.labels for r in license_scan.scan(rows, chunk=2).collect()} == want
    assert {r.doc_id: r.score for r in license_scan.scan(rows, chunk=4).collect()}[0] == 18 / 19


def test_license_scan_is_native(spark, odd):
    plan = license_scan.scan(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ 2, 8


def test_codec_equals_library():
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_codec.Codec(MODEL)
    rng = np.random.default_rng(5)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 9))) for _ in range(4000)]
    texts += ["".join(rng.choice(list("abcdeth  ▁_\n\t.,!?01é中😀\x00\xa0{}"), rng.integers(0, 60))) for _ in range(4000)]
    texts += [t or "" for _, t, _, _ in ODD] + [" " * 500, "ab" * 2000 + "." * 700]
    for t in texts:
        ids = np.frombuffer(c.encode(t), np.int32).tolist()
        assert ids == sp.encode(t, add_eos=True) and c.decode(ids) == sp.decode(ids)


def test_encode_decode_documents(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(odd, MODEL), MODEL).select("doc_id", "ids", "text").collect()
    want = [(d, sp.encode(t or "", add_eos=True)) for d, t, _, _ in ODD]
    assert sorted((repr(d), i, sp.decode(i)) for d, i in want) == sorted((repr(r.doc_id), r.ids, r.text) for r in got)
    assert sentencepiece_codec.encode_documents(none, MODEL).count() == 0


def test_op2_digests(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in docs(spark).collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sentencepiece_codec.sha256_hex(" ".join(map(str, ids))), sentencepiece_codec.sha256_hex(sp.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_sentencepiece(spark, SF).collect()} == want


def test_token_counts(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((repr(d), len(sp.encode(t or ""))) for d, t, _, _ in ODD)
    for split in (50, 1000, 1 << 17):
        got = token_counts.count_tokens(odd, MODEL, split_bytes=split, batch_bytes=2000)
        assert sorted((repr(r.doc_id), r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(none, MODEL).count() == 0


def test_safe_pieces_cover():
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = "".join(rng.choice(list("ab  ▁\n"), rng.integers(0, 80)))
        assert " ".join(token_counts.safe_pieces(t, 7)) == t


# ------------------------------------------------------------------ 3, 10


def plain_stats(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count, mark = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            mark |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)


def test_text_stats(spark, odd, none):
    got = text_stats.with_stats(odd, prefix="s_")
    assert sorted((repr(d), *plain_stats(t)) for d, t, _, _ in ODD) == sorted((repr(r.doc_id), *(r[f"s_{c}"] for c in text_stats.COUNTS)) for r in got.collect())
    assert "n_words" in got.columns and text_stats.with_stats(none).count() == 0


def test_rules_are_learned_and_ordered(spark, odd, none):
    rng = np.random.default_rng(3)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    y = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = quality_rules.learn(x, y)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality_rules._covers(r, x)
    assert len(rules) >= 2 and (hit == y).mean() > 0.95
    assert quality_rules.learn(x, np.zeros(900, bool)) == []
    kept = {r.doc_id: r.kept for r in quality_rules.judge(odd, []).collect()}
    assert kept[1] is False and kept[2] is False and kept[10] is False
    assert quality_rules.fit(none, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_judge_equals_plain_rules(spark):
    """The emitted expression decides as the rules do, applied one by one, on every row."""
    d = docs(spark)
    rules = quality_rules.fit(d, common.table(spark, SF, "labels")) + [[("mark_44_per_word", ">=", 0.2), ("n_words", "<=", 90.0)], [("digit_share", ">=", 0.05)]]
    for r in quality_rules.judge(d, rules).collect():
        x = {c: r[c] for c in [*text_stats.RATIOS, *text_stats.COUNTS]}
        hit = any(all(x[n] >= v if op == ">=" else x[n] <= v for n, op, v in rule) for rule in rules)
        n, _, _, _, repeat = plain_stats(r.text)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed and not hit)


def test_a_repeated_label_id_stays_one_row(spark):
    rows = spark.range(5000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    sample = text_stats.one_each(text_stats.with_stats(text_stats.labelled_sample(rows, labels, "quality", None, 100), "__text").drop("__text"))
    assert sample.count() == 1


def test_op3_keeps_good_and_rejects_bad(spark):
    got = queries.op3_quality_rules(spark, "/root/testdata/sf0.01")
    r = got.join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    rate = dict(map(tuple, r))
    assert rate[1] > 0.97 and rate[0] < 0.2


def test_ranking(spark, odd, none):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=600) * 0.3 > -1).astype(int)
    w = quality_ranking.bradley_terry(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])
    got = queries.op10_quality_ranking(spark, "/root/testdata/sf0.01")
    rows = got.join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())
    assert quality_ranking.fit(none, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {r.s_score for r in quality_ranking.rank(odd, None, prefix="s_").collect()} == {0.5}


def test_bradley_terry_equals_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=200) > 0).astype(int)
    w = quality_ranking.bradley_terry(x, y, pairs=500, l2=3.0, seed=5)
    draw = np.random.default_rng(5)
    d = x[draw.choice(np.flatnonzero(y == 1), 500)] - x[draw.choice(np.flatnonzero(y == 0), 500)]
    plain = np.zeros(4)
    for _ in range(20_000):
        plain += 0.002 * (d.T @ (1 / (1 + np.exp(d @ plain))) - 3.0 * plain)
    assert np.abs(w - plain).max() < 1e-3


def test_op10_scores_equal_plain_ones(spark):
    model = quality_ranking.fit(docs(spark), common.table(spark, "/root/testdata/sf0.01", "labels"))
    for r in quality_ranking.rank(docs(spark), model).collect():
        x = text_stats.stats(r.text or "")[1]
        s = sum(min(v, quality_ranking.CAP.get(c, 1.0)) * w for c, v, w in zip(text_stats.RATIOS, x, model["weights"], strict=True)) - model["cut"] + np.log(0.3 / 0.7)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(s, -30, 30)))) < 1e-9


# ------------------------------------------------------------------ 4


def plain_ftrl(rows, alpha, beta, l1, l2, epochs, seed):
    """Coordinate by coordinate, as published."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, l1):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            w = {int(i): weight(int(i), l1) for i in rows[k][0]} | {"one": weight("one", 0.0)}
            g = 1 / (1 + np.exp(-sum(w.values()))) - rows[k][1]
            for i in w:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i, 0.0 if i == "one" else l1) for i in z}


def test_ftrl_equals_plain():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 60, 12)), 0) for _ in range(150)]
    rows = [(f, int(7 in f or 11 in f)) for f, _ in rows]
    at, weights, intercept = toxicity.ftrl(rows, bits=8, alpha=0.5, l1=0.7, epochs=2, seed=3)
    want = plain_ftrl(rows, 0.5, 1.0, 0.7, 0.1, 2, 3)
    assert abs(want.pop("one") - intercept) < 1e-9
    assert {i: w for i, w in want.items() if w} == pytest.approx(dict(zip(at.tolist(), weights.tolist(), strict=True)))


def test_scores_equal_plain_sums(spark, odd):
    h = toxicity.Hasher()
    words = ["the", "mit", "license", "word1"]
    at = np.unique(np.concatenate([h.features(w) for w in words]))
    weights = np.linspace(-1, 1, len(at))
    by = dict(zip(at.tolist(), weights.tolist(), strict=True))
    got = toxicity.score(odd, (at, weights, 0.25)).collect()  # odd has a column score, which is replaced
    text = {repr(d): t for d, t, _, _ in ODD}
    for r in got:
        want = 0.25 + sum(by.get(int(f), 0.0) for f in set(h.features(text[repr(r.doc_id)] or "").tolist()))
        assert abs(r.score - 1 / (1 + np.exp(-want))) < 1e-9


def test_settings_are_chosen_on_rows_aside():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 4000, 80)), 0) for _ in range(300)]
    rows = [(f, int(f.min() < 20)) for f, _ in rows]
    aside = text_stats.inner_split(np.arange(300))
    assert 30 < aside.sum() < 90 and toxicity.choose(rows, aside) in toxicity.SETTINGS
    assert toxicity.choose(rows, np.zeros(300, bool)) == toxicity.SETTINGS[0]


def test_toxicity(spark, odd, none):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.1")
    rows = got.join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.limit(500).collect())
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-9 for r in toxicity.score(odd, model).collect()) and toxicity.score(none, model).count() == 0


# ------------------------------------------------------------------ 5


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def plain_fingerprint(t, width=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def test_simhash_query(spark):
    got = {r.doc_id: r for r in queries.op5_simhash(spark, SF).collect()}
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs(spark).collect()}
    ids = sorted(fp)
    want = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_simhash_odd(spark, odd, none):
    got = collections.defaultdict(set)
    for r in simhash.near_duplicates(odd).collect():
        got[r.doc_id].add((r.fingerprint, r.component_id))
    assert got[1] == got[2] == got[3] == {("0" * 16, 1)} and {c for _, c in got[7]} == {6} and {c for _, c in got[None]} == {None}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("blocks", "most"), [(4, 4096), (6, 4096), (4, 40)])
def test_links_lose_nothing(spark, blocks, most):
    """Random balls around few centres: crowded buckets, which `most` deals out in blocks."""
    rng = np.random.default_rng(9)
    fp = set()
    for c in rng.integers(0, 1 << 63, 12, np.uint64):
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fp.add(simhash.signed(x))
    fp = sorted(fp)
    nodes = spark.createDataFrame(list(zip(fp, range(len(fp)), strict=True)), "fp long, rep long")
    got = {r.node: r.component for r in common.connected_components(simhash.links(nodes, 3, blocks=blocks, most=most)).collect()}
    mask = (1 << 64) - 1
    near = [(a, b) for a in range(len(fp)) for b in range(a) if ((fp[a] ^ fp[b]) & mask).bit_count() <= 3]
    want = plain_components(range(len(fp)), near)
    assert {n: got.get(n, n) for n in want} == want


def test_null_ids_link_others(spark):
    """A chain of fingerprints two bits apart, the middle one under a null id."""
    near = simhash.signed
    fp = {1: 0, None: 3, 2: 15}
    nodes = spark.createDataFrame([(near(f), near(f)) for f in fp.values()], "fp long, rep long")
    got = {r.node: r.component for r in common.connected_components(simhash.links(nodes)).collect()}
    assert got == {0: 0, 3: 0, 15: 0}
    t = " ".join(f"w{k}" for k in range(200))
    rows = spark.createDataFrame([(None, t), (4, t), (3, t + " x"), (None, "other")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows, similarity=0.8).collect()]
    assert sorted(got, key=repr) == [(3, 3), (4, 3), (None, None), (None, None)]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n, m, common_n = rng.integers(1, 900), rng.integers(1, 900), rng.integers(0, 500)
        both = rng.integers(0, 1 << 64, common_n, np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, k, np.uint64)])) for k in (n, m))
        bound = shingle_join.differing_bits([shingle_join.bitmap(a)], [shingle_join.bitmap(b)])[0]
        assert bound <= len(np.setxor1d(a, b))


def test_long_runs_come_in_parts():
    """A shingle of very many sets is passed on whole, in parts; one of a single component is left out if it fits."""
    import pyarrow as pa

    key = np.repeat([1, 2, 3, 4], [3, 25, 4, 2])
    component = np.r_[0, 0, 0, np.repeat([5, 6], [21, 4]), 1, 2, 1, 1, 9, 9]
    cols = {"key": key, "place": key, "set_id": np.arange(len(key)), "n": key, "component": component}
    batches = pa.table({k: pa.array(v.astype(np.int64)) for k, v in cols.items()}).to_batches(max_chunksize=4)
    out = pa.Table.from_batches(list(shingle_join._shared(iter(batches), most=10)))
    assert out.column("key").to_pylist() == [2] * 25 + [3] * 4
    of = dict(zip(range(len(key)), key.tolist(), strict=True))
    assert all(of[h] == of[n] == k for k, h, n in zip(*(out.column(c).to_pylist() for c in ("key", "hub_set_id", "next_set_id")), strict=True))
    whole = [(t.num_rows, r[-1]) for t, r in common.whole_runs(iter(batches), ["key"])]
    assert sum(n for n, _ in whole) == len(key)


def plain_shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def plain_similar(texts, similarity=0.8):
    """Pairs of ids whose five-word shingles have at least this Jaccard similarity."""
    sets = {d: plain_shingles(t) for d, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


@pytest.mark.parametrize("most", [1024, 16])
def test_similar_texts(spark, most, monkeypatch):
    """Edited copies, a crowd of them, and texts that share half: no link below the similarity, and every one above it."""
    rng = np.random.default_rng(4)
    texts = {}
    for k in range(90):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(60, 400))]
        texts[len(texts)] = " ".join(base)
        for _ in range(80 if k == 0 else 2):
            copy = list(base)
            for at in rng.choice(len(copy), max(1, int(len(copy) * rng.choice([0.01, 0.02]))), replace=False):
                copy[at] = "changed"
            texts[len(texts)] = " ".join(copy)
        half = base[: len(base) // 2] + [f"v{x}" for x in rng.integers(0, 3000, len(base) // 2)]
        texts[len(texts)] = " ".join(half)
    inner = shingle_join.similar_links
    monkeypatch.setattr(shingle_join, "similar_links", lambda *a, **k: inner(*a, most=most, **k))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, similarity=0.8).collect()}
    fp = {d: plain_fingerprint(t) for d, t in texts.items()}
    similar = plain_similar(texts)
    want = plain_components(texts, similar + [(a, b) for a in texts for b in texts if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert got == want and sum(want[d] != d for d in texts) > 200


def check_all_links(spark, texts):
    """The components are just those of brute force; returns the pairs that no fingerprints link."""
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fp = {d: plain_fingerprint(t) for d, t in texts.items()}
    similar = plain_similar(texts)
    want = plain_components(texts, similar + [(a, b) for a in texts for b in texts if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, similarity=0.8).collect()} == want
    return [(fp[a] ^ fp[b]).bit_count() for a, b in similar]


def test_similar_long_texts(spark):
    """Sets of more shingles than a row's bitmap has bits: twins around the similarity, and texts that share a long passage."""
    rng = np.random.default_rng(9)
    texts, passage = {}, [f"p{k}" for k in range(900)]
    for k in range(5):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 3000 + 400 * k)] + passage
        texts[len(texts)] = " ".join(base)
        for share in (0.005, 0.02, 0.024, 0.03):  # 0.0225 of the words changed leave about 0.8 of the shingles
            copy = list(base)
            for at in rng.choice(len(copy), int(len(copy) * share), replace=False):
                copy[at] = f"c{rng.integers(0, 1 << 40)}"
            texts[len(texts)] = " ".join(copy)
    assert len(check_all_links(spark, texts)) > 5


def test_bitmaps_are_lower_bounds():
    """Whole and folded ones, also of sets of very different size; a row's never has more than so many bytes."""
    rng = np.random.default_rng(2)
    for n, m, common in ((10, 12, 5), (3000, 2500, 2400), (20_000, 300, 200), (20_000, 19_000, 18_500)):
        every = np.sort(rng.integers(0, 1 << 64, n + m, dtype=np.uint64))
        rng.shuffle(every)
        a, b = np.sort(every[:n]), np.sort(every[n - common : n - common + m])
        differ = len(np.setxor1d(a, b))
        x, y = shingle_join.bitmap(a), shingle_join.bitmap(b)
        whole, folded = (int(shingle_join.differing_bits([p], [q])[0]) for p, q in ((x, y), (shingle_join.brief(x), shingle_join.brief(y))))
        assert folded <= whole <= differ and len(shingle_join.brief(x)) <= shingle_join.BRIEF


def test_similar_repeated_lines(spark):
    """Nearly equal shingle sets whose multisets, and so fingerprints, are far apart; and equal sets."""
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(60):
        body, footer = (" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in (300, 12))
        texts[3 * k] = f"{body}\n{footer}"
        for j, times in ((1, 6), (2, 12)):
            texts[3 * k + j] = body + f"\n{footer}" * times
    texts[180], texts[181] = "a b c d e " * 12, "a b c d e " * 90
    assert sum(d > 14 for d in check_all_links(spark, texts)) > 30


def test_similar_appended_and_replaced(spark):
    """Pairs without a third copy, just above the similarity, that differ in one long passage."""
    rng = np.random.default_rng(6)
    texts = {}
    for k in range(150):
        base, more = ([f"w{x}" for x in rng.integers(0, 30_000, n)] for n in (300, 72))
        texts[4 * k], texts[4 * k + 1] = " ".join(base), " ".join(base + more)
        base = [f"w{x}" for x in rng.integers(0, 30_000, 300)]
        texts[4 * k + 2], texts[4 * k + 3] = " ".join(base), " ".join(base[:150] + more[:28] + base[178:])
    assert len(check_all_links(spark, texts)) == 300


def test_similar_odd(spark, odd, none):
    got = collections.defaultdict(set)
    for r in simhash.near_duplicates(odd, similarity=0.8).collect():
        got[r.doc_id].add(r.component_id)
    assert got[1] == got[3] == {1} and got[7] == {6} and got[9] == {9} and got[None] == {None}
    assert simhash.near_duplicates(none, similarity=0.8).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[1001] == 1000
    assert common.connected_components(edges.limit(0)).count() == 0


# ------------------------------------------------------------------ 6


@pytest.mark.parametrize("most", [4096, 30])
def test_embeddings(spark, most):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 64))
    near = base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 64)) * rng.choice([0.05, 0.2, 0.35, 0.5], (400, 1))
    hot = base[:1] + rng.normal(size=(120, 64)) * 0.03
    x = np.concatenate([base, near, hot, base[:5], 3 * base[:2]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 64), (n + 2, [None] + [1.0] * 63), (n + 3, [float("nan")] + [1.0] * 63), (n + 4, []), (n + 5, [1.0, 0.0]), (n + 6, [1.0, 0.01])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(v, most=most).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = np.triu(u @ u.T >= 0.9, 1)
    true = link.sum()
    found = sum(got[k].n_links for k in range(n)) / 2
    assert len(got) == len(rows) and found <= true and found >= 0.97 * true
    assert all(got[n + k].n_links == 0 and got[n + k].kept and got[n + k].component_id == n + k for k in range(5))
    assert got[n + 5].n_links == got[n + 6].n_links == 1 and not got[n + 6].kept
    want = plain_components(range(n), zip(*map(list, np.nonzero(link)), strict=True))
    assert sum(got[k].component_id == want[k] for k in range(n)) >= 0.97 * n
    assert embedding_dedup.near_duplicates(v.limit(0)).count() == 0


@pytest.mark.parametrize("d", [64, 100, 768])
def test_codes_bound_the_cosine(d):
    """The estimates are unbiased, and the bounds hold as often as they say."""
    rng = np.random.default_rng(d)
    base = rng.normal(size=(400, d))
    x = np.concatenate([base, base + rng.normal(size=(400, d)) * rng.uniform(0.1, 2, (400, 1))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    code = embedding_dedup.Codes(embedding_dedup.Codes.pack(unit, 7), d)
    a, b = np.arange(400), np.arange(400, 800)
    true = (unit[a] * unit[b]).sum(axis=1)
    assert abs((code.upper_bounds(a, b, 0.0) - true).mean()) < 0.02
    assert (code.upper_bounds(a, b, 4.0) >= true).all() and (code.upper_bounds(a, b, 2.0) >= true).mean() > 0.95
    far = code.upper_bounds(a, np.roll(a, 1), 4.0)
    assert (far < 0.9).mean() > 0.99  # unrelated pairs are discarded


@pytest.mark.parametrize("d", [64, 256, 768, 1024])
def test_embeddings_recall_by_dimension(spark, d):
    """Pairs just over the threshold, the hardest ones, are found whatever the dimension."""
    rng = np.random.default_rng(d)
    n, cosine = 1500, 0.9 + 1e-9
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(n, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(v).where("vec_id >= 1500 AND component_id = vec_id - 1500 AND n_links = 1").count()
    assert got >= 0.95 * n


def test_embeddings_repeated_ids(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(v).collect()), key=repr)
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 1, 1)]


# ------------------------------------------------------------------ 7


def test_round_robin_holds_the_mixture():
    taken = packing.round_robin([1000, 500, 37, 0], [1000, 500, 37, 0], 64)
    step = np.diff(taken, axis=0)
    assert taken[-1].tolist() == [1000, 500, 37, 0] and (step >= 0).all() and (step[:-1].sum(1) == 64).all()
    ideal = np.arange(len(taken))[:, None] * 64 * np.array([1000, 500, 37, 0]) / 1537
    assert np.abs(taken[:-1] - ideal[:-1]).max() <= 2
    early = packing.round_robin([100, 900], [0.5, 0.5], 50)
    assert early[-1].tolist() == [100, 900] and np.diff(early, axis=0)[0].tolist() == [25, 25] and (np.diff(early, axis=0)[:-1].sum(1) == 50).all()


def test_tree_of_queues():
    """Positions never fall, windows are full, quotas are held within the tree's depth, and all queues end together."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        totals = [int(x) for x in rng.choice([0, 1, 3, 50, 4000, 90_000], rng.integers(1, 40))]
        sums, total = np.concatenate([[0], np.cumsum(totals)]), sum(totals)
        paths = [packing.path_by_tokens(sums, k) for k in range(len(totals))]
        at = np.array([[packing.dealt(p, min(n, total)) for p, t in zip(paths, totals, strict=True) if t] for n in range(0, total + 512, 512)])
        if not at.size:
            continue
        size = np.array([t for t in totals if t])
        assert (np.diff(at[:, :, 1], axis=0) >= 0).all() and (at[:, :, 1].sum(1) == np.minimum(np.arange(len(at)) * 512, total)).all()
        assert at[-1, :, 1].tolist() == size.tolist() and (at[:, 1:, 0] == at[:, :-1, 0] + at[:, :-1, 1]).all()
        ideal = np.minimum(np.arange(len(at)) * 512, total)[:, None] * size / total
        assert np.abs(at[:, :, 1] - ideal).max() <= 0.5 * np.log2(len(totals) + 1) + 1


def test_packing_many_sources(spark):
    """More sources than are broadcast or than groups; every window of the large one holds its share."""
    n = 200_000
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('source ', id) AS source", "'a' AS text")
    rows = rows.unionByName(spark.range(n, n + 400).selectExpr("id AS doc_id", "'large' AS source", f"'{'word ' * 999}' AS text"))
    pieces = packing.pack(rows, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), with_ids=False)
    pieces = common.written(pieces, "pieces")
    got = pieces.agg(F.sum("length"), F.countDistinct("doc_id"), F.countDistinct("sequence_id"), F.max("sequence_id")).first()
    assert got[1] == n + 400 and got[2] == got[3] + 1 == -(-got[0] // 1024)
    by = pieces.groupBy("window").agg(F.sum("length").alias("all"), F.sum(F.expr("if(source = 'large', length, 0)")).alias("large")).orderBy("window").collect()
    share = sum(r.large for r in by) / got[0]
    assert all(r["all"] == 64 * 1024 for r in by[:-1]) and all(abs(r.large - share * r["all"]) <= 20 for r in by)
    odd = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("starts"), F.count("*").alias("pieces"))
    assert odd.where("n != end OR starts != pieces").count() == 0


def check_pieces(pieces, ids):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for d, want in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    fill = []
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        fill.append(at)
    assert max(fill) <= 1024 and sum(n < 1024 for n in fill) <= 1 and sorted(by_seq) == list(range(len(by_seq)))


def test_packing_query(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs(spark).collect()}
    check_pieces(queries.op7_packing(spark, SF).collect(), ids)


def test_packing_odd(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _, _ in ODD if d is not None}
    path, pattern = queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern()
    pieces = packing.pack(rows, path, pattern).collect()
    check_pieces(pieces, ids)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    check_pieces(packing.pack(rows, path, pattern, shares={"a": 0.2}).collect(), ids)
    assert packing.pack(odd, path, pattern).where("start = 0").count() == len(ODD) and packing.pack(none, path, pattern).count() == 0


# ------------------------------------------------------------------ 9


def test_matrix_has_its_sums():
    blocks = np.array([10, 0, 7, 300, 1])
    m = sharding.matrix(blocks, 4, 1)
    assert m.sum(1).tolist() == blocks.tolist() and max(m.sum(0)) - min(m.sum(0)) <= 1
    mean = np.mean([sharding.matrix(blocks, 4, s)[3] for s in range(400)], axis=0)
    assert np.abs(mean - 75).max() < 1.5
    rng = np.random.default_rng(0)
    big = np.array([sharding.hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(2000)])
    assert abs(big.mean() - 250_000) < 50 and abs(big.std() / np.sqrt(10**6 * 3 / 16) - 1) < 0.08


def test_sharding(spark, odd, none):
    got = sharding.shard(odd.withColumn("slot", F.lit("clash")), 4, 3).collect()  # odd has a column shard, too
    assert sorted(repr(r.text) for r in got) == sorted(repr(t) for _, t, _, _ in ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [3, 3, 3, 3] and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(none).count() == 0
    q = queries.op9_sharding(spark, SF)
    text = {r.doc_id: (r.text or "").encode() for r in docs(spark).collect()}
    rows = q.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in text.items()}
    n = collections.Counter(r.shard for r in rows)
    assert len(n) == 16 and max(n.values()) - min(n.values()) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_sharding_is_uniform(spark):
    """Chi-squares of shard by block of rows and of slot by shard, far from what a bias would give."""
    got = sharding.shard(spark.range(16_000), 8, 500).collect()
    part, shard, slot = (np.array(x) for x in zip(*((r.id // 2000, r.shard, r.slot * 8 // 2000) for r in got), strict=True))
    for a, b in ((part, shard), (part, slot), (shard * 0 + np.array([r.id % 8 for r in got]), shard)):
        table = np.zeros((8, 8))
        np.add.at(table, (a, b), 1)
        chi = ((table - 250) ** 2 / 250).sum()
        assert 15 < chi < 110  # 49 degrees of freedom: beyond these in one of 100,000 draws


def test_matrix_follows_the_hypergeometric_law():
    """Frequencies of a cell of a small matrix against exact probabilities."""
    from math import comb

    draws = collections.Counter(int(sharding.matrix(np.array([4, 6]), 2, s)[0, 0]) for s in range(4000))
    for k in range(5):
        p = comb(5, k) * comb(5, 4 - k) / comb(10, 4)
        assert abs(draws[k] / 4000 - p) < 4 * (p * (1 - p) / 4000) ** 0.5


def test_digest_helper():
    assert sentencepiece_codec.sha256_hex("a") == hashlib.sha256(b"a").hexdigest()
