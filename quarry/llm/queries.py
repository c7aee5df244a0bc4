"""The operators over their whole tables, with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, conversations, language_model, line_dedup, mixing, pieces, sharding, simhash, suffix, tiff, token_store, topk, toxicity
from quarry.llm.frames import shared_dir


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4, seed=42)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return token_store.TokenStore.write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json")).document_checksums()


#: Sources by domain and the weights of the tree; languages weigh the same in every domain, sources alike.
MIX = mixing.Mix({("crawl",): 0.3, ("curated",): 0.7, ("*", "en"): 0.4, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.2}, share=0.5, max_epochs=2, seed=17)


def domain_of_source() -> Column:
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX, domain_of_source())
    return out.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian 16-bit integers), text_sha256 of the decoded text."""
    model = tokenizer_file("piece_bpe_32k.model")
    decoded = pieces.round_trip(table(spark, sf_dir, "documents"), model, dropout=0.1, seed=11)
    return decoded.select("doc_id", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.page_digests(tiff.media_pages(tiff.store_media(table(spark, sf_dir, "documents"))))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = conversations.repair(conversations.damaged(rows))
    counts, same = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], lambda b: F.col("conv_id").eqNullSafe(b)
    ids = rows.select("conv_id").distinct()
    summary, lines = done.summary.withColumnRenamed("conv_id", "s"), conversations.digests(done.turns).withColumnRenamed("conv_id", "t")
    out = ids.join(summary, same(F.col("s")), "left").join(lines, same(F.col("t")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return language_model.score_documents(table(spark, sf_dir, "documents"), held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_suffix, op3_sharding, op4_token_store, op5_mixing, op6_pieces, op7_topk, op8_line_dedup, op9_toxicity, op10_tiff, op11_conversation_repair, op12_alignment, op13_language_model)}

ORACLE_SQL = {
    "op7_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s)
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
    """,
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
        k AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
        o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
        m AS (SELECT k.*, coalesce(k.doc_id > o.owner, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE t AS (
          SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: if(c % 2 = 1, xor(c >> 1, 3988292384), c >> 1), b)) AS tab),
        keyed AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes
          FROM conversations),
        cased AS (
          SELECT conv_id, turn, role, text,
                 xor(list_reduce(codes, lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS which
          FROM keyed, t),
        d AS (
          SELECT conv_id, turn, if(which = 4, 'user', role) AS role,
                 CASE which WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM (SELECT *, unnest(range(CASE which WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS time FROM cased)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role || ':' || text, 64), text) AS i FROM d),
        judged AS (
          SELECT *, left(role, 1) AS ini, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS later FROM placed),
        f AS (
          SELECT *, body = '' AS is_blank, body <> '' AND later AS is_dup, body <> '' AND NOT later AND right(body, 1) NOT IN ('.', '!', '?') AS is_cut,
                 lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM judged),
        facts AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
                 count(*) FILTER (is_dup) AS duplicate, count(*) FILTER (is_cut) AS truncated,
                 count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        w AS (
          SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': ''} AS o, {'c': 1000000000, 'a': ''} AS s, {'c': 1000000000, 'a': ''} AS u, {'c': 1000000000, 'a': ''} AS a FROM facts
          UNION ALL
          SELECT w.conv_id, f.i, {'c': o.c + 4, 'a': o.a || 'D'},
            list_sort([{'c': s.c + 4, 'a': s.a || 'D'}, {'c': o.c + if(f.is_blank OR f.is_dup OR f.ini <> 's', 1000000000, 0) + if(f.is_cut, 3, 0), 'a': o.a || 'K'}])[1],
            list_sort([{'c': u.c + 4, 'a': u.a || 'D'}] || list_transform([{'c': o.c, 'a': o.a}, {'c': s.c, 'a': s.a}, {'c': a.c, 'a': a.a}, {'c': u.c + 3, 'a': u.a || 'I'}],
              lambda x: {'c': x.c + if(f.is_blank OR f.is_dup, 1000000000, 0) + if(f.ini = 'u', 0, 3) + if(f.is_cut, 3, 0), 'a': x.a || if(f.ini = 'u', 'K', 'R')}))[1],
            list_sort([{'c': a.c + 4, 'a': a.a || 'D'}] || list_transform([{'c': u.c, 'a': u.a}, {'c': o.c + 3, 'a': o.a || 'I'}, {'c': s.c + 3, 'a': s.a || 'I'}, {'c': a.c + 3, 'a': a.a || 'I'}],
              lambda x: {'c': x.c + if(f.is_blank OR f.is_dup, 1000000000, 0) + if(f.ini = 'a', 0, 3) + if(f.is_cut, 3, 0), 'a': x.a || if(f.ini = 'a', 'K', 'R')}))[1]
          FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1),
        won AS (
          SELECT facts.*, list_sort([{'c': o.c, 'a': o.a}, {'c': s.c + 6, 'a': s.a || 'II'}, {'c': u.c + 3, 'a': u.a || 'I'}, {'c': a.c, 'a': a.a}])[1] AS best
          FROM facts JOIN w ON facts.conv_id IS NOT DISTINCT FROM w.conv_id AND facts.n = w.i),
        letters AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS p FROM won),
        spread AS (
          SELECT conv_id, p, audit[p] AS e, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS k FROM letters),
        turned AS (
          SELECT x.conv_id, x.p, x.e, x.k, if(x.e = 'I', '', f.text) AS text, f.role, max(if(x.k = 1 AND x.e = 'K' AND f.ini = 's', 1, 0)) OVER (PARTITION BY x.conv_id) AS led
          FROM spread x LEFT JOIN f ON x.e <> 'I' AND x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i WHERE x.e <> 'D'),
        said AS (
          SELECT conv_id, string_agg(if(e = 'K', role, if((k - led) % 2 = 1, 'user', 'assistant')) || ':' || text, chr(10) ORDER BY p) AS body FROM turned GROUP BY conv_id)
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN won ON ids.conv_id IS NOT DISTINCT FROM won.conv_id LEFT JOIN said ON ids.conv_id IS NOT DISTINCT FROM said.conv_id
    """,
}
