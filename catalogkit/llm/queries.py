"""The registered queries of the operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.llm import bpe, clustering, decontaminate, langid, mtree, packing, permutation, quality, repair, sharding, simhash, tool_calls, toxicity
from catalogkit.llm.common import table


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, tool_calls.SCHEMAS)
    return linked.withColumn("faults", F.concat_ws(",", "faults"))


def op2_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings")).drop("pages_visited", "entries_scored")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.neighbours(table(spark, sf_dir, "embeddings"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("key")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pca_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tool_call_linking, op2_convolutional_toxicity, op3_quality_trees, op4_mtree_top_k, op5_permutation_index,
        op6_tree_bpe, op7_mixture_packing, op8_covering_simhash, op9_centroid_language, op10_histogram_sharding,
        op11_conversation_repair, op12_benchmark_decontamination, op13_pca_clustering,
    )
}


def _clustering_sql(rounds: int = 10) -> str:
    """The rounds one after another: all distances, the nearest, the floors of the means."""
    nearest = """a{n} AS MATERIALIZED (
        SELECT r, vec_id, q, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster, min(d) AS distance
        FROM (SELECT v.*, c.cluster, list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{n} c) x GROUP BY r, vec_id, q)"""
    means = """c{m} AS MATERIALIZED (
        SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (
            SELECT cluster, list(x ORDER BY i) AS c FROM (
                SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{n}) e GROUP BY cluster, i) s GROUP BY cluster) m ON m.cluster = c.cluster)"""
    steps = [nearest.format(n=0)]
    for n in range(rounds):
        steps += [means.format(n=n, m=n + 1), nearest.format(n=n + 1)]
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, q AS c FROM v QUALIFY cluster < 8
        ), {", ".join(steps)}
        SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_tool_call_linking": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS name FROM conversations WHERE role IN ('user', 'system')
        ), edges AS (
            SELECT c.conv_id, c.turn, n.turn AS need FROM calls c JOIN calls n ON n.conv_id = c.conv_id AND n.turn = c.turn + CASE c.name WHEN 'answer' THEN -2 ELSE 1 END
        ), waits AS (
            SELECT conv_id, turn, turn AS upon FROM calls UNION SELECT e.conv_id, e.turn, w.upon FROM edges e JOIN waits w ON w.conv_id = e.conv_id AND w.turn = e.need
        ), ready AS (
            SELECT conv_id, turn, max(upon) AS ready FROM waits GROUP BY ALL
        ), depth AS (
            SELECT conv_id, turn, 0 AS d FROM calls
            UNION SELECT e.conv_id, e.turn, d + 1 FROM edges e JOIN depth p ON p.conv_id = e.conv_id AND p.turn = e.need
                JOIN ready a ON a.conv_id = e.conv_id AND a.turn = e.turn JOIN ready b ON b.conv_id = e.conv_id AND b.turn = e.need WHERE a.ready = b.ready
        ), placed AS (
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY ready, max(d), turn) - 1 AS position FROM depth JOIN ready USING (conv_id, turn) GROUP BY conv_id, turn, ready
        ), asked AS (
            SELECT *, 'call_' || turn AS call_id FROM calls JOIN placed USING (conv_id, turn)
        ), results AS (
            SELECT conv_id, 'call_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
        )
        SELECT conv_id, call_id, position, name,
               CASE WHEN name IS NULL THEN 'no_call' WHEN content IS NULL THEN 'no_result' ELSE 'linked' END AS status,
               CAST(CASE WHEN name IS NULL THEN 0 ELSE 1 END AS BIGINT) AS calls, CAST(CASE WHEN content IS NULL THEN 0 ELSE 1 END AS BIGINT) AS results,
               CASE WHEN name IS NOT NULL AND (length(text) = 0 OR length(text) > CASE name WHEN 'answer' THEN 300 ELSE 200 END)
                    THEN 'length:prompt' ELSE '' END AS faults,
               CASE WHEN name IS NULL THEN '{"id":"' || call_id || '","result":' || to_json(content)::VARCHAR || '}'
                    ELSE '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || call_id || '","name":"' || name || '"'
                         || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || '}' END AS line
        FROM asked FULL JOIN results USING (conv_id, call_id)
    """,
    "op4_mtree_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_conversation_repair": """
        WITH RECURSIVE bits AS (
            SELECT list(list_reduce(list_prepend(CAST(b AS UINTEGER), [CAST(0 AS UINTEGER) FOR i IN range(8)]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UINTEGER ELSE 0::UINTEGER END)) ORDER BY b) AS t FROM range(256) r(b)
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
        ), hashed AS (
            SELECT keyed.*, xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, [CAST(ascii(x) AS UINTEGER) FOR x IN string_split(k, '')]), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind FROM keyed, bits
        ), rows_ AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed WHERE kind <> 0
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM rows_
        ), judged AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'none' END AS fault,
                   lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1:1] AS pair, role[1:1] AS initial FROM numbered
        ), facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last FROM judged GROUP BY conv_id
        ), inserts(state, ins, after_, price, added) AS (
            VALUES ('e', '', 'e', 0, ''), ('e', 'I', 'u', 2, 'user:'), ('e', 'II', 'a', 4, 'user:' || chr(10) || 'assistant:'), ('s', '', 's', 0, ''), ('s', 'I', 'u', 2, 'user:'), ('s', 'II', 'a', 4, 'user:' || chr(10) || 'assistant:'),
                   ('u', '', 'u', 0, ''), ('u', 'I', 'a', 2, 'assistant:'), ('a', '', 'a', 0, ''), ('a', 'I', 'u', 2, 'user:')
        ), edits(after_, initial, op, state, price) AS (
            SELECT s, CAST(NULL AS VARCHAR), 'D', s, 3 FROM (VALUES ('e'), ('s'), ('u'), ('a')) x(s) UNION ALL VALUES
            ('e', 's', 'K', 's', 0), ('e', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0),
            ('e', NULL, 'R', 'u', 2), ('s', NULL, 'R', 'u', 2), ('a', NULL, 'R', 'u', 2), ('u', NULL, 'R', 'a', 2)
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS n, 'e' AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM facts
            UNION ALL
            SELECT conv_id, n, state, cost, audit, lines FROM (
                SELECT w.conv_id, j.n, e.state, w.cost + i.price + e.price + CASE WHEN e.op <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END AS cost, w.audit || i.ins || e.op AS audit,
                       w.lines || CASE i.ins WHEN '' THEN [] ELSE [i.added] END || CASE e.op WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.state WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END AS lines
                FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1 JOIN inserts i ON i.state = w.state
                JOIN edits e ON e.after_ = i.after_ AND (e.initial IS NULL OR e.initial = j.initial) AND (e.op = 'D' OR j.fault IN ('none', 'truncated'))
            ) x QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
        ), ended AS (
            SELECT w.conv_id, w.cost + i.price AS cost, w.audit || i.ins AS audit, w.lines || CASE i.ins WHEN '' THEN [] ELSE [i.added] END AS lines
            FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.last = w.n JOIN inserts i ON i.state = w.state AND i.after_ IN ('e', 'a')
            QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.price, w.audit || i.ins) = 1
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op12_benchmark_decontamination": """
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item_words WHERE len(w) > 0) x
        ), met AS (
            SELECT d.doc_id, d.i, x.size, x.item_id FROM (
                SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
                FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= size) p
            ) d JOIN windows x ON x.size = d.size AND x.key = d.key
        ), hits AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM met) p GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) p GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op13_pca_clustering": _clustering_sql(),
}
