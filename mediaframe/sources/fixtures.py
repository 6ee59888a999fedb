"""Media-catalogue tables as views over the generated parquet tables.

The view texts run unchanged in Spark SQL and in DuckDB, so an oracle can start from the same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "embeddings", "documents", "labels", "orders", "lineitem", "customer", "nation", "region", "supplier", "part")

VIEWS = {
    "media": """SELECT 'm' || lpad(CAST(event_id AS STRING), 9, '0') AS media_id, event_id AS n,
 CASE WHEN event_type IN ('purchase','signup') THEN 'GOOGLE_IMPORT' ELSE 'DEVICE' END AS source,
 'vol' || CAST(user_id % 3 AS STRING) AS volume_name, CAST(user_id AS STRING) AS bucket_id,
 'Bucket ' || CAST(user_id % 7 AS STRING) AS bucket_name, 'DCIM/' || CAST(user_id % 5 AS STRING) AS relative_path,
 event_type || '_' || CAST(event_id AS STRING) || '%' AS display_name,
 CASE WHEN event_id % 10 <> 0 THEN ts END AS taken_at,
 CASE WHEN event_id % 50 <> 0 THEN ts + INTERVAL '1' DAY END AS added_at,
 event_id % 4 AS content_revision, 1 + event_id % 3 AS access_epoch,
 CASE WHEN event_id % 20 = 7 THEN 'INACCESSIBLE' WHEN event_id % 20 = 11 THEN 'MISSING'
      WHEN event_id % 20 = 13 AND event_type IN ('purchase','signup') THEN 'TRASHED' ELSE 'AVAILABLE' END AS availability,
 CASE WHEN event_id % 20 = 13 AND event_type IN ('purchase','signup') THEN ts END AS trashed_at
FROM events""",
    "exposure": """SELECT media_id, CASE WHEN n % 17 = 0 THEN content_revision + 1 ELSE content_revision END AS content_revision,
 CASE WHEN n % 5 = 0 THEN 'SENSITIVE' WHEN n % 5 = 1 THEN 'QUARANTINED' ELSE 'SAFE' END AS exposure
FROM media WHERE n % 13 <> 0""",
    "media_tag": "SELECT media_id, CASE n % 3 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' ELSE 'trip' END AS tag_key FROM media WHERE n % 2 = 0",
    "favorite": "SELECT media_id FROM media WHERE n % 9 = 0",
    "album": "SELECT DISTINCT 'a' || CAST(user_id % 45 AS STRING) AS album_id, 'Album ' || CAST(user_id % 45 AS STRING) AS name FROM events",
    "album_media": "SELECT 'a' || CAST(n % 40 AS STRING) AS album_id, media_id FROM media WHERE n % 3 = 0",
    "ai_embedding": """SELECT 'g1' AS generation_id, m.media_id, e.vec_id + 1 AS native_key,
 CASE WHEN m.n % 19 = 0 THEN m.content_revision + 1 ELSE m.content_revision END AS content_revision,
 CASE WHEN m.n % 23 = 0 THEN m.access_epoch + 1 ELSE m.access_epoch END AS access_epoch, e.label
FROM embeddings e JOIN media m ON m.n = e.vec_id""",
    "ai_ocr_result": """SELECT 'g2' AS generation_id, m.media_id, m.content_revision, m.access_epoch, d.text AS display_text, d.lang
FROM documents d JOIN media m ON m.n = d.doc_id""",
    "ai_face_detection": """SELECT 'd' || lpad(CAST(vec_id AS STRING), 9, '0') AS detection_id,
 'm' || lpad(CAST(CAST(floor(vec_id / 2) AS BIGINT) AS STRING), 9, '0') AS media_id,
 'f' || lpad(CAST((vec_id * 7919) % 100003 AS STRING), 6, '0') AS anchor_id,
 'auto:' || CAST(label AS STRING) AS computed_cluster_id
FROM embeddings""",
    "person_face_decision": """SELECT anchor_id, CASE WHEN CAST(substr(detection_id, 2) AS BIGINT) % 29 = 0 THEN 'EXCLUDE' ELSE 'ASSIGN' END AS decision,
 CASE WHEN CAST(substr(detection_id, 2) AS BIGINT) % 29 = 0 THEN NULL
      ELSE 'p' || CAST(CAST(substr(detection_id, 2) AS BIGINT) % 4 AS STRING) END AS person_id
FROM ai_face_detection
WHERE CAST(substr(detection_id, 2) AS BIGINT) % 11 = 0 OR CAST(substr(detection_id, 2) AS BIGINT) % 29 = 0""",
    "person_merge": "SELECT DISTINCT 'p' || CAST(n % 3 + 1 AS STRING) AS from_person_id, 'p' || CAST(n % 3 AS STRING) AS into_person_id FROM media",
    "sensitive_logits": """SELECT l.doc_id, d.lang AS language, l.toxic = 1 AS sensitive,
 CAST(CASE WHEN l.toxic = 1 THEN 50 ELSE -50 END + (l.doc_id * 37) % 100 - 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS nsfw_logit, CAST(0 AS DOUBLE) AS sfw_logit
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "ocr_eval": "SELECT doc_id, lang AS language, text AS expected, replace(text, 'en', 'on') AS actual FROM documents",
}
NEEDS = {
    "media": ("events",), "exposure": ("media",), "media_tag": ("media",), "favorite": ("media",), "album": ("events",), "album_media": ("media",),
    "ai_embedding": ("embeddings", "media"), "ai_ocr_result": ("documents", "media"), "ai_face_detection": ("embeddings",), "person_face_decision": ("ai_face_detection",),
    "person_merge": ("media",), "sensitive_logits": ("labels", "documents"), "ocr_eval": ("documents",),
}


def _order(names) -> list[str]:
    """The named views and what they need, each after its needs."""
    out: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = [f"{x} AS ({VIEWS[x]})" if x in VIEWS else f"{x} AS (SELECT * FROM parquet.`{sf_dir}/{x}.parquet`)" for x in _order([name])]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def oracle(body: str, *views: str, **extra: str) -> str:
    """DuckDB text: the named views, further named queries, then `body`."""
    parts = [f"{x} AS ({VIEWS[x]})" for x in _order(views) if x in VIEWS] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
