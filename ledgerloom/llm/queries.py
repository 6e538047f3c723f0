"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, gru_lm, near_dedup, quality, sharding, sp_codec, token_counts, token_store


def vocabulary(name: str) -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.proportional_shards(_table(spark, sf_dir, "documents"), n_shards=24)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"), held_out=1)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.15)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_decode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_token_counts,
        op3_quality,
        op4_lm_score,
        op5_exact_dedup,
        op6_decontaminate,
        op7_near_dedup,
        op8_sentencepiece,
        op9_chat_format,
        op10_token_store,
    )
}

def _crc_table() -> str:
    """The checksum's table for half a byte, from its polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return f"[{', '.join(map(str, out))}]"


def _crc_half(c: str) -> str:
    return f"xor({_crc_table()}[({c} & 15) + 1], {c} >> 4)"


#: The unsigned CRC-32 of a text's bytes: a fold over them, half a byte at a time.
_CRC_SQL = f"""xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(t))), lambda i: CAST('0x' || substr(hex(t), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
  lambda c, b: {_crc_half(_crc_half('xor(c, b)'))}, CAST(4294967295 AS BIGINT)))"""

ORACLE_SQL = {
    "op1_sharding": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5('ledgerloom:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw, coalesce('s' || source, 'n') AS stratum FROM documents),
             c AS (SELECT doc_id, source, octet_length(encode(t)) + 8 AS size, {_CRC_SQL} AS text_crc32, draw, stratum FROM d),
             r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id NULLS FIRST, text_crc32) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total FROM c),
             p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * k + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), draw, doc_id NULLS FIRST, text_crc32) - 1 AS rank FROM r),
             s AS (SELECT *, rank * 24 // total AS shard FROM p)
        SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(rank - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op7_near_dedup": r"""
        WITH RECURSIVE w AS (
               SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh
                   FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
             p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                          sha256(string_agg(md5(role) || md5(text), ',') OVER w) AS h
                   FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
             whole AS (SELECT n_turns AS k, h, min(conv_id) AS conv_id FROM p WHERE pos = n_turns - 1 GROUP BY 1, 2),
             stays AS (SELECT conv_id FROM whole WHERE NOT EXISTS
                       (SELECT 1 FROM p WHERE p.pos + 1 = whole.k AND p.h = whole.h AND p.pos < p.n_turns - 1))
        SELECT conv_id, pos // 4096 AS part, max(n_turns) AS n_turns, count(*) AS n_part_turns,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
        FROM p JOIN stays USING (conv_id) GROUP BY conv_id, pos // 4096""",
}
