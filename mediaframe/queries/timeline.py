"""Fence, timeline and search queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe.functions.numbers import device_identity
from mediaframe.functions.text import ocr_normalize, ocr_search_key, search_key
from mediaframe.functions.time import effective_at, end_of_day, exif_instant, in_date_range, with_periods
from mediaframe.operators import fence, search, timeline as tl
from mediaframe.plans.paging import after, page, page_after
from mediaframe.queries.registry import AT, EL, M, V, Tables, query


def shown(t: Tables):
    return with_periods(fence.visible(t.media, t.exposure))


def live(t: Tables):
    return fence.eligible(t.media, t.exposure)


day = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)


@query("SELECT month_key AS key, count(*) AS items, strftime(max(sort_at), '%Y-%m-%d %H:%M:%S') AS newest FROM v GROUP BY month_key", *M, v=V)
def a1_month_summary(t):
    return tl.period_summary(shown(t), ("month",)).select("key", "items", day("newest", "newest"))


@query("""SELECT level, key, count(*) AS items, strftime(max(sort_at), '%Y-%m-%d %H:%M:%S') AS newest FROM (
 SELECT 'day' AS level, day_key AS key, sort_at FROM v UNION ALL SELECT 'week', week_key, sort_at FROM v UNION ALL SELECT 'month', month_key, sort_at FROM v UNION ALL SELECT 'year', year_key, sort_at FROM v) GROUP BY level, key""", *M, v=V)
def a1_all_levels(t):
    return tl.period_summary(shown(t)).select("level", "key", "items", day("newest", "newest"))


@query("SELECT album.album_id, name, count(m.media_id) AS items FROM album LEFT JOIN album_media am ON am.album_id = album.album_id LEFT JOIN (SELECT * FROM media WHERE availability = 'AVAILABLE') m ON m.media_id = am.media_id LEFT JOIN exposure x ON x.media_id = m.media_id AND x.content_revision = m.content_revision WHERE m.media_id IS NULL OR x.exposure = 'SAFE' GROUP BY 1, 2", "media", "exposure", "album", "album_media")
def a2_albums(t):
    return search.albums(t.album, t.album_media, t.media, t.exposure)


@query("SELECT album.album_id, name, count(m.media_id) AS items FROM album LEFT JOIN album_media am ON am.album_id = album.album_id LEFT JOIN (SELECT * FROM media WHERE availability = 'AVAILABLE') m ON m.media_id = am.media_id GROUP BY 1, 2", "media", "album", "album_media")
def a2_albums_protected(t):
    return search.albums(t.album, t.album_media, t.media, t.exposure, include_protected=True)


@query("SELECT volume_name, coalesce(bucket_id, '') AS bucket_id, coalesce(relative_path, '') AS relative_path, max(bucket_name) AS bucket_name, count(*) AS items FROM v WHERE source = 'DEVICE' GROUP BY 1, 2, 3", *M, v=V)
def a3_folders(t):
    return search.folders(shown(t))


@query("SELECT count(*) AS eligible, count(d.media_id) AS completed, count(f.media_id) AS failed, count(*) = count(d.media_id) AND count(f.media_id) = 0 AS complete FROM el LEFT JOIN (SELECT DISTINCT media_id, content_revision, access_epoch FROM ai_embedding) d USING (media_id, content_revision, access_epoch) LEFT JOIN (SELECT media_id, content_revision, access_epoch FROM media WHERE n % 31 = 0) f USING (media_id, content_revision, access_epoch)", "media", "exposure", "ai_embedding", el=EL)
def a5_progress(t):
    return fence.progress(live(t), t.ai_embedding, t.media.where("n % 31 = 0"))


@query("SELECT count(DISTINCT el.media_id) AS eligible, count(DISTINCT e.media_id) AS search, count(DISTINCT o.media_id) AS ocr FROM el LEFT JOIN ai_embedding e USING (media_id, content_revision, access_epoch) LEFT JOIN ai_ocr_result o USING (media_id, content_revision, access_epoch)", "media", "exposure", "ai_embedding", "ai_ocr_result", el=EL)
def a6_coverage(t):
    return fence.coverage(live(t), {"search": t.ai_embedding, "ocr": t.ai_ocr_result})


@query("SELECT count(*) AS available, count(*) FILTER (WHERE exposure IS NULL OR exposure <> 'SAFE') AS quarantined FROM media m LEFT JOIN exposure x ON x.media_id = m.media_id AND x.content_revision = m.content_revision WHERE availability = 'AVAILABLE'", *M)
def a7_status_counts(t):
    return fence.status_counts(t.media, t.exposure)


@query("SELECT a.media_id, count(*) FILTER (WHERE p.newest > mine.newest OR mine.newest IS NULL AND p.newest IS NOT NULL) AS newer FROM (SELECT media_id, day_key FROM v WHERE n % 10 = 3) a JOIN p mine ON mine.key = a.day_key CROSS JOIN p GROUP BY a.media_id", *M, v=V, p="SELECT day_key AS key, max(sort_at) AS newest FROM v GROUP BY 1")
def a8_period_rank(t):
    v = shown(t)
    anchors = v.where("n % 10 = 3").select("media_id", F.col("day_key").alias("key"))
    return tl.period_rank(v, "day", anchors).select("media_id", "newer")


@query("SELECT media_id, row_number() OVER (ORDER BY sort_at DESC NULLS LAST, media_id DESC) - 1 AS rank FROM v", *M, v=V)
def w1_feed_rank(t):
    return tl.feed_rank(shown(t)).select("media_id", "rank")


@query("SELECT media_id, row_number() OVER (PARTITION BY day_key ORDER BY sort_at DESC NULLS LAST, media_id DESC) - 1 AS day_position, count(*) OVER (PARTITION BY day_key) AS day_size FROM v", *M, v=V)
def w2_day_position(t):
    return tl.day_position(shown(t)).select("media_id", "day_position", "day_size")


@query("SELECT media_id, row_number() OVER w - 1 AS rank, lag(media_id) OVER w AS previous_id, lead(media_id) OVER w AS next_id FROM v WINDOW w AS (ORDER BY sort_at DESC NULLS LAST, media_id DESC)", *M, v=V)
def w3_neighbours(t):
    return tl.neighbours(shown(t))


@query("SELECT key, place, media_id FROM (SELECT month_key AS key, media_id, row_number() OVER (PARTITION BY month_key ORDER BY sort_at DESC NULLS LAST, media_id DESC) AS place FROM v) WHERE place <= 3", *M, v=V)
def w4_covers(t):
    return tl.covers(shown(t), "month")


@query("SELECT key, place, media_id FROM (SELECT week_key AS key, media_id, row_number() OVER (PARTITION BY week_key ORDER BY sort_at ASC NULLS FIRST, media_id) - 1 AS place, count(*) OVER (PARTITION BY week_key) AS size FROM v) WHERE size <= 3 OR place = 0 OR place = (size - 1) // 2 OR place = size - 1", *M, v=V)
def w5_samples(t):
    return tl.samples(shown(t), "week")


@query("SELECT day_key, arg_max(media_id, (coalesce(sort_at, TIMESTAMP '0001-01-01'), media_id)) AS anchor_id FROM v GROUP BY day_key", *M, v=V)
def w6_day_headers(t):
    return tl.day_headers(shown(t))


@query("SELECT media_id, (row_number() OVER (ORDER BY media_id) - 1) // 128 AS chunk FROM v", *M, v=V)
def w11_chunks(t):
    return tl.chunk(shown(t), [F.col("media_id")], 128).select("media_id", "chunk")


@query("SELECT week_key AS key, count(*) AS items, arg_max(media_id, (coalesce(sort_at, TIMESTAMP '0001-01-01'), media_id)) AS cover_id, least(count(*), 3) AS samples FROM v GROUP BY 1", *M, v=V)
def w12_timeline_weeks(t):
    return tl.timeline(shown(t), "week").select("key", "items", "cover_id", "samples")


@query("SELECT day_key AS key, media_id, row_number() OVER (PARTITION BY day_key ORDER BY sort_at DESC NULLS LAST, media_id DESC) = 1 AS header, count(*) OVER (PARTITION BY day_key) AS items FROM v", *M, v=V)
def w12_timeline_photos(t):
    return tl.timeline(shown(t), "photo")


@query(f"SELECT media_id, coalesce(strftime({AT}, '%Y-%m-%d'), 'undated') AS day_key, coalesce(strftime(date_trunc('week', {AT}), '%Y-%m-%d'), 'undated') AS week_key, coalesce(strftime({AT}, '%Y-%m'), 'undated') AS month_key, coalesce(strftime({AT}, '%Y'), 'undated') AS year_key FROM media", "media")
def p3_period_keys(t):
    return with_periods(t.media).select("media_id", "day_key", "week_key", "month_key", "year_key")


@query(f"SELECT media_id, strftime({AT}, '%Y-%m-%d %H:%M:%S') AS sort_at FROM media", "media")
def p4_effective_instant(t):
    return t.media.select("media_id", day(effective_at(F.col("taken_at"), F.col("added_at")), "sort_at"))


@query("SELECT media_id, 'device:' || sha256(length(volume_name) || ':' || volume_name || '2:v1' || length(CAST(n AS VARCHAR)) || ':' || n || length(CAST(content_revision AS VARCHAR)) || ':' || content_revision) AS identity FROM media", "media")
def p5_device_identity(t):
    return t.media.select("media_id", device_identity(F.col("volume_name"), F.lit("v1"), F.col("n"), F.col("content_revision")).alias("identity"))


@query("SELECT doc_id, lower(nfc_normalize(text)) AS key FROM documents")
def p1_search_key(t):
    return t.documents.select("doc_id", search_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[\t ]+', ' ', 'g')), lambda x: x <> ''), chr(10))) AS display FROM documents")
def p2_ocr_display(t):
    return t.documents.select("doc_id", F.sha2(ocr_normalize(F.col("text")), 256).alias("display"))


@query("SELECT media_id, content_revision FROM v", *M, v=V)
def p6_visible(t):
    return fence.visible(t.media, t.exposure).select("media_id", "content_revision")


def _files(t):
    return t.media.withColumn("uri", F.expr("CASE WHEN n % 4 <> 0 THEN 'content://' || n END")).withColumn("file", F.expr("CASE WHEN n % 6 <> 0 THEN n || '.image' END"))


FILES = "SELECT *, CASE WHEN n % 4 <> 0 THEN 'content://' || n END AS uri, CASE WHEN n % 6 <> 0 THEN n || '.image' END AS file FROM media"


@query("SELECT media_id, availability = 'AVAILABLE' AS organize, availability = 'AVAILABLE' AND CASE WHEN source = 'DEVICE' THEN uri IS NOT NULL ELSE file IS NOT NULL END AS share, availability = 'AVAILABLE' AND source <> 'DEVICE' AND file IS NOT NULL AS delete FROM f", "media", f=FILES)
def p7_capabilities(t):
    m = _files(t)
    return m.select("media_id", *[fence.allows(m, o).alias(o.lower()) for o in ("ORGANIZE", "SHARE", "DELETE")])


@query("SELECT f.media_id, coalesce(exposure = 'SAFE' AND availability = 'AVAILABLE' AND trashed_at IS NULL, false) AS can_compare, coalesce(exposure = 'SAFE' AND availability = 'AVAILABLE' AND trashed_at IS NULL, false) AND source <> 'DEVICE' AND file IS NOT NULL AS can_trash FROM f LEFT JOIN exposure x ON x.media_id = f.media_id AND x.content_revision = f.content_revision", *M, f=FILES)
def p8_comparison_capabilities(t):
    return fence.comparison_capabilities(fence.with_exposure(_files(t), t.exposure)).select("media_id", "can_compare", "can_trash")


@query("SELECT media_id FROM media WHERE contains(lower(display_name), '_1') AND contains(display_name, '%')", "media")
def p9_literal_match(t):
    from mediaframe.functions.text import contains_literal

    return t.media.where(contains_literal(search_key(F.col("display_name")), "_1") & contains_literal(F.col("display_name"), "%")).select("media_id")


@query(f"SELECT media_id FROM media WHERE {AT} >= TIMESTAMP '2024-01-05 00:00:00' AND {AT} < TIMESTAMP '2024-01-20 00:00:00'", "media")
def p10_date_range(t):
    m = with_periods(t.media)
    return m.where(in_date_range(F.col("sort_at"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")).select("media_id")


@query("SELECT media_id FROM (SELECT v.* FROM v WHERE contains(lower(nfc_normalize(display_name)), lower('C')) AND sort_at >= TIMESTAMP '2024-01-02' AND sort_at < TIMESTAMP '2024-01-30' AND EXISTS (SELECT 1 FROM media_tag g WHERE g.media_id = v.media_id AND tag_key = 'dog') ORDER BY sort_at DESC NULLS LAST, media_id DESC LIMIT 60)", "media", "exposure", "media_tag", v=V)
def p11_catalog_search(t):
    return search.catalog_search(t, search.CatalogSearch(name="C", start="2024-01-02 00:00:00", until="2024-01-30 00:00:00", tag=" Dog ")).select("media_id")


#: Search text of recognised text: NFC, lines trimmed and joined by a blank, runs of blanks made one, lower case.
OCR_KEY = r"lower(replace(array_to_string(list_filter(list_transform(string_split(nfc_normalize(display_text), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[\t ]+', ' ', 'g')), lambda x: x <> ''), chr(10)), chr(10), ' '))"


@query(f"SELECT media_id FROM media m WHERE availability = 'AVAILABLE' AND EXISTS (SELECT 1 FROM ai_ocr_result o WHERE o.media_id = m.media_id AND o.generation_id = 'g2' AND o.content_revision = m.content_revision AND o.access_epoch = m.access_epoch AND contains({OCR_KEY}, 'the th')) ORDER BY {AT} DESC NULLS LAST, media_id DESC LIMIT 50 OFFSET 3", "media", "ai_ocr_result")
def p11_catalog_search_text(t):
    """Recognised text of protected rows too, typed with capitals and blanks, past the first three."""
    return search.catalog_search(t, search.CatalogSearch(ocr=" The  TH", ocr_generation="g2", include_protected=True, limit=50, offset=3)).select("media_id")


@query("SELECT media_id FROM (SELECT v.* FROM v WHERE source = 'DEVICE' AND volume_name = 'vol1' AND EXISTS (SELECT 1 FROM favorite g WHERE g.media_id = v.media_id) AND EXISTS (SELECT 1 FROM album_media a WHERE a.media_id = v.media_id AND album_id = 'a9') ORDER BY sort_at DESC NULLS LAST, media_id DESC LIMIT 120)", "media", "exposure", "favorite", "album_media", v=V + " AND volume_name = 'vol1'")
def p11_catalog_search_album(t):
    tables = {n: t[n] for n in ("media", "exposure", "media_tag", "favorite", "album_media", "ai_ocr_result")}
    tables["media"] = tables["media"].where("volume_name = 'vol1'")
    return search.catalog_search(tables, search.CatalogSearch(source="DEVICE", favorite=True, album_id="a9", limit=120)).select("media_id")


@query("SELECT media_id FROM v WHERE source = 'DEVICE' AND volume_name = 'vol0' AND bucket_id = '3' AND relative_path = 'DCIM/3' ORDER BY sort_at DESC NULLS LAST, media_id DESC LIMIT 60", *M, v=V)
def p14_folder_search(t):
    return search.catalog_search(t, search.CatalogSearch(folder=("vol0", "3", "DCIM/3"))).select("media_id")


@query("SELECT media_id, content_revision, access_epoch FROM el", *M, el=EL)
def p12_eligible(t):
    return live(t).select(*fence.FENCE)


@query("SELECT native_key, e.media_id FROM ai_embedding e JOIN el USING (media_id, content_revision, access_epoch)", "media", "exposure", "ai_embedding", el=EL)
def p13_current(t):
    return fence.current(t.ai_embedding, live(t)).select("native_key", "media_id")


@query("SELECT m.media_id, exposure FROM media m LEFT JOIN exposure x ON x.media_id = m.media_id AND x.content_revision = m.content_revision", *M)
def j1_exposure(t):
    return fence.with_exposure(t.media, t.exposure).select("media_id", "exposure")


@query("SELECT v.media_id FROM v WHERE EXISTS (SELECT 1 FROM media_tag g WHERE g.media_id = v.media_id AND tag_key = 'cat')", "media", "exposure", "media_tag", v=V)
def j4_having_tag(t):
    return search.having_tag(shown(t), t.media_tag, " Cat ").select("media_id")


@query("SELECT v.media_id FROM v SEMI JOIN favorite USING (media_id)", "media", "exposure", "favorite", v=V)
def j4_favourites(t):
    return search.favourites(shown(t), t.favorite).select("media_id")


@query("SELECT el.media_id FROM el WHERE NOT EXISTS (SELECT 1 FROM ai_embedding d WHERE d.media_id = el.media_id AND d.content_revision = el.content_revision AND d.access_epoch = el.access_epoch) AND n % 31 <> 0", "media", "exposure", "ai_embedding", el=EL)
def j5_pending(t):
    return fence.pending(live(t), t.ai_embedding, t.media.where("n % 31 = 0")).select("media_id")


@query("SELECT native_key FROM ai_embedding d WHERE NOT EXISTS (SELECT 1 FROM el WHERE d.media_id = el.media_id AND d.content_revision = el.content_revision AND d.access_epoch = el.access_epoch)", "media", "exposure", "ai_embedding", el=EL)
def j6_stale(t):
    return fence.stale(t.ai_embedding, live(t)).select("native_key")


@query("SELECT native_key FROM ai_embedding JOIN el USING (media_id, content_revision, access_epoch) WHERE native_key % 7 = 0", "media", "exposure", "ai_embedding", el=EL)
def j13_by_keys(t):
    return search.by_keys(fence.current(t.ai_embedding, live(t)), t.ai_embedding.where("native_key % 7 = 0"), "native_key").select("native_key")


@query("SELECT a.event_id, v.media_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT sort_at, max(media_id) AS media_id FROM v WHERE sort_at IS NOT NULL GROUP BY sort_at) v ON a.ts >= v.sort_at", *M, v=V)
def j14_asof(t):
    return tl.asof_row(t.events.where("event_type = 'error'").select("event_id", "ts"), shown(t), "ts").select("event_id", "media_id")


@query("SELECT media_id FROM v WHERE sort_at IS NOT NULL AND (sort_at < TIMESTAMP '2024-01-15 12:00:00' OR sort_at = TIMESTAMP '2024-01-15 12:00:00' AND media_id < 'm5')", *M, v=V)
def j15_keyset(t):
    v = shown(t).withColumn("sort_at", F.col("sort_at").cast("timestamp"))
    import datetime

    return v.where(after([("sort_at", True), ("media_id", True)], {"sort_at": datetime.datetime(2024, 1, 15, 12), "media_id": "m5"})).select("media_id")


@query("SELECT media_id, (SELECT count(*) FROM v) > 100 AS has_next FROM v ORDER BY sort_at DESC NULLS LAST, media_id DESC LIMIT 60 OFFSET 40", *M, v=V)
def t1_feed_page(t):
    return page(shown(t), tl.newest_first(), 60, 40).select("media_id", "has_next")


@query("SELECT native_key, (SELECT count(*) FROM ai_embedding WHERE native_key > 100) > 50 AS has_next FROM ai_embedding WHERE native_key > 100 ORDER BY native_key LIMIT 50", "ai_embedding")
def t2_keyset_page(t):
    return page_after(t.ai_embedding, [("native_key", False)], {"native_key": 100}, 50).select("native_key", "has_next")


@query("SELECT media_id, (SELECT count(*) FROM media WHERE availability = 'TRASHED') > 40 AS has_next FROM media WHERE availability = 'TRASHED' ORDER BY trashed_at DESC, media_id LIMIT 40", "media")
def t3_trash_page(t):
    return page(t.media.where("availability = 'TRASHED'"), [F.col("trashed_at").desc(), F.col("media_id")], 40).select("media_id", "has_next")


@query("SELECT key, (SELECT count(*) FROM p) > 12 AS has_next FROM p ORDER BY newest DESC NULLS LAST, key DESC LIMIT 10 OFFSET 2", *M, v=V, p="SELECT day_key AS key, max(sort_at) AS newest FROM v GROUP BY 1")
def t7_period_page(t):
    return page(tl.period_summary(shown(t), ("day",)), [F.col("newest").desc_nulls_last(), F.col("key").desc()], 10, 2).select("key", "has_next")


@query(f"SELECT media_id FROM ai_ocr_result JOIN el USING (media_id, content_revision, access_epoch) WHERE ai_ocr_result.generation_id = 'g2' AND contains({OCR_KEY}, 'tion the')", "media", "exposure", "ai_ocr_result", el=EL)
def o1_ocr_search(t):
    return search.ocr_search(t.ai_ocr_result, live(t), "Tion  THE", "g2").select("media_id")


@query("SELECT count(DISTINCT el.media_id) AS eligible, count(DISTINCT o.media_id) AS indexed FROM el LEFT JOIN ai_ocr_result o USING (media_id, content_revision, access_epoch)", "media", "exposure", "ai_ocr_result", el=EL)
def o2_ocr_coverage(t):
    return fence.ocr_coverage(live(t), t.ai_ocr_result)


@query("SELECT media_id, tag_key FROM media_tag UNION SELECT media_id, 'new' FROM v WHERE n % 5 = 2", "media", "exposure", "media_tag", v=V)
def l5_organise(t):
    return search.organise(shown(t), t.media.where("n % 5 = 2"), t.media_tag, "tag_key", "new")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS instant FROM events")
def s28_exif_instant(t):
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    return t.events.select("event_id", day(exif_instant(text, F.lit(None).cast("string"), "UTC"), "instant"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL '1' DAY, '%Y-%m-%d %H:%M:%S') AS until FROM orders")
def s28_end_of_day(t):
    return t.orders.select("o_orderkey", day(end_of_day(F.col("o_orderdate").cast("date"), "UTC"), "until"))
