"""Queries of JSON that is cut and closed again, and checked against a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.json_checks import closed, violations
from ..sources.tables import table
from .registry import query

TURN = {
    "type": "object",
    "required": ["conv_id", "turn", "role", "text"],
    "additionalProperties": False,
    "properties": {
        "conv_id": {"type": "integer"},
        "turn": {"type": "integer", "maximum": 5},
        "role": {"enum": ["user", "assistant", "system"]},
        "text": {"type": "string", "minLength": 40, "maxLength": 600},
    },
}
_HEAD = r'\{"conv_id":\d+,"turn":\d+'


@query(
    "cut_records",
    rf"""WITH p AS (SELECT conv_id, turn, j, substring(j, 1, n) AS p FROM (SELECT *, least(length(j), floor(1.2 * length(j) * (('0x' || substr(sha256('cut:' || conv_id || '/' || turn), 1, 12))::UBIGINT / 281474976710656.0)))::BIGINT AS n
    FROM (SELECT conv_id, turn, to_json({{'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}})::VARCHAR AS j FROM conversations))),
    c AS (SELECT conv_id, turn, CASE WHEN p = j OR p = '' THEN nullif(p, '') WHEN regexp_matches(p, '^{_HEAD},"role":"[a-z]*","text":"') THEN regexp_extract(p, '^(?:[^\\]|\\[^u]|\\u[0-9a-fA-F]{{4}})*') || '"}}'
    WHEN regexp_matches(p, '"text":null$') THEN p || '}}' WHEN regexp_matches(p, '^{_HEAD},"role":"[a-z]*$') THEN p || '"}}' WHEN regexp_matches(p, '^{_HEAD},"role":"[a-z]*"') THEN regexp_extract(p, '^{_HEAD},"role":"[a-z]*"') || '}}'
    WHEN regexp_matches(p, '^{_HEAD}') THEN regexp_extract(p, '^{_HEAD}') || '}}' WHEN regexp_matches(p, '^\{{"conv_id":\d+') THEN regexp_extract(p, '^\{{"conv_id":\d+') || '}}' ELSE '{{}}' END AS x FROM p)
    SELECT conv_id, turn, md5(x) AS digest, CASE WHEN x IS NOT NULL THEN array_to_string(list_filter([CASE WHEN NOT json_exists(x, '$.conv_id') THEN '$: no field ''conv_id''' END, CASE WHEN NOT json_exists(x, '$.turn') THEN '$: no field ''turn''' END,
    CASE WHEN NOT json_exists(x, '$.role') THEN '$: no field ''role''' END, CASE WHEN NOT json_exists(x, '$.text') THEN '$: no field ''text''' END, CASE WHEN (x->>'$.turn')::BIGINT > 5 THEN '$.turn: over 5' END,
    CASE WHEN json_exists(x, '$.role') AND coalesce(x->>'$.role', '') NOT IN ('user', 'assistant', 'system') THEN '$.role: not one of ["user", "assistant", "system"]' END, CASE WHEN json_type(x, '$.text') = 'NULL' THEN '$.text: not of type string' END,
    CASE WHEN length(x->>'$.text') < 40 THEN '$.text: under 40 characters' END, CASE WHEN length(x->>'$.text') > 600 THEN '$.text: over 600 characters' END], lambda v: v IS NOT NULL), '; ') END AS problems FROM c""",
)
def cut_records(spark, d):
    """Each turn as a JSON record, cut where its ids say (a sixth stay whole), closed again, and checked against a schema."""
    rows = table(spark, d, "conversations")
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    share = tx.bucket(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "cut")
    rows = rows.select("conv_id", "turn", record.alias("j"), share.alias("share"))
    length = F.least(F.length("j"), F.floor(F.lit(1.2) * F.length("j") * F.col("share"))).cast("int")
    back = rows.select("conv_id", "turn", closed(F.substring("j", F.lit(1), length)).alias("x"))
    return back.select("conv_id", "turn", F.md5("x").alias("digest"), F.array_join(violations(F.col("x"), TURN), "; ").alias("problems"))
