"""The queries over whole tables that apply the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, hard_negatives, license_scan, packing, prefix_trie, quality_ranking, quality_rules, sentencepiece_codec, sharding, simhash, token_counts, token_files, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="text")
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.text_size().alias("size"), sharding.text_crc32().alias("text_crc32"))
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = quality_ranking.rank(docs, quality_ranking.fit(docs, table(spark, sf_dir, "labels")))
    return ranked.select("doc_id", quality_ranking.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.with_crc32(token_files.read_files(spark, folder))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns, c - c % 5, F.crc32(c.cast("string")) % 9, 8, c % 5 == 0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_sentencepiece, op3_quality_rules, op4_toxicity, op5_simhash,
        op6_embedding_dedup, op7_packing, op8_token_counts, op9_sharding, op10_quality_ranking,
        op11_hard_negatives, op12_token_files, op13_prefix_trie,
    )
}

_OP6 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM e WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(u, v) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id"""

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT vec_id, label, list_transform(e, lambda c: floor(256 * c)) AS x FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS own, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.own AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5"""

_BITS = "list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
_OP13 = f"""
WITH own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, l, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, b: {_BITS}), 4294967295) % 9 AS h FROM own),
seq AS (SELECT h.c, list_concat(coalesce(b.l[1:h.h], []), coalesce(h.l[h.h + 1:], [])) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
pre AS (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seq),
n AS (SELECT d, s[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256 FROM pre GROUP BY d, s[1:d]),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
own_value AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.k[n.d]['text'])) END AS own_saved
  FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k),
up AS (SELECT d, k[1:d] AS k, sum(leaf) AS n_leaves, sum(own_saved) AS saved_tokens FROM (SELECT k, own_saved, CAST(n_children = 0 AS INTEGER) AS leaf, unnest(range(o.d + 1)) AS d FROM own_value o) GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves,
  CAST(up.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM own_value v JOIN up ON up.d = v.d AND up.k = v.k LEFT JOIN n p ON p.d = v.d - 1 AND p.k = v.k[1:v.d - 1]"""

ORACLE = {"op1_license_scan": license_scan.oracle(), "op6_embedding_dedup": _OP6, "op11_hard_negatives": _OP11, "op13_prefix_trie": _OP13}
