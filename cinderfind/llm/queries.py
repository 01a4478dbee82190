"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from cinderfind.llm.license_scan import op9_license_scan
from cinderfind.llm.line_dedup import op1_line_dedup
from cinderfind.llm.mixing import op7_mix_sources
from cinderfind.llm.mpeg_audio import op6_mpeg_audio
from cinderfind.llm.packing import op3_best_fit_packing
from cinderfind.llm.quality import op4_quality
from cinderfind.llm.simhash import op10_simhash_near_dedup
from cinderfind.llm.substring_dedup import op5_substring_dedup
from cinderfind.llm.topk import op2_pivot_topk
from cinderfind.llm.warc import op8_warc


def queries():
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_pivot_topk": op2_pivot_topk,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_quality": op4_quality,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_mpeg_audio": op6_mpeg_audio,
        "op7_mix_sources": op7_mix_sources,
        "op8_warc": op8_warc,
        "op9_license_scan": op9_license_scan,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    }


OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, payload, octet_length(payload) AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM h
"""


OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql():
    return {"op2_pivot_topk": OP2, "op8_warc": OP8}
