"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_GROUP = "to_base(CAST('0x' || substr(sha1(coalesce(html, '')), {at}, 10) AS BIGINT), 32, 8)"
_BASE32 = "translate(" + " || ".join(_GROUP.format(at=at) for at in (1, 11, 21, 31)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

ORACLE = {
    "op2_warc": f"""
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
        FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
    """,
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
