"""Evaluation, recognised text, tokens and stream queries."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from mediaframe.functions import numbers as nx, text as tx
from mediaframe.operators import dedup, evaluate as ev, fence, vector_search as vs
from mediaframe.operators.tokens import tokenize_corpus
from mediaframe.plans.lineage import shared_folder, spread
from mediaframe.queries.catalogue import TOP, hundredths
from mediaframe.queries.registry import M, V, Tables, query
from mediaframe.queries.timeline import live, shown
from mediaframe.sources import catalog
from mediaframe.sources.buckets import BucketStore
from mediaframe.streaming import jobs

# --- evaluation ---------------------------------------------------------------------------------
QUERY = "SELECT vec_id AS query_id, CASE vec_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'de' END AS language, label, vec_id // 500 AS part FROM embeddings WHERE vec_id % 100 = 0"
RANKING = f"SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ({TOP.format(v='embeddings', n=100)}) WHERE rank <= 50 AND vec_id <> query_id"
RELEVANT = "SELECT query_id, vec_id AS id FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id // 500 = q.part AND e.vec_id <> q.query_id"


def _retrieval(t: Tables):
    """Every hundredth vector as a query, its nearest fifty as the ranking, those of its label among the five hundred around it as relevant: so many at any size."""
    e = t.embeddings.select("vec_id", "label", F.expr("vec_id div 500").alias("part"))
    q = e.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "CASE vec_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'de' END AS language", "label", "part")
    found = vs.search_exact(t.embeddings, hundredths(t), 50).where("vec_id <> query_id")
    ranking = found.select("query_id", F.col("vec_id").alias("id"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))
    return q.select("query_id", "language"), ranking, q.join(e, ["label", "part"]).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("id"))


@query("""SELECT language, round(avg(coalesce(h1 / rel, 0)), 6) AS recall_1, round(avg(coalesce(h5 / rel, 0)), 6) AS recall_5, round(avg(coalesce(1 / first, 0)), 6) AS mrr
 FROM q LEFT JOIN (SELECT query_id, count(*) AS rel FROM r GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 5) AS h5, min(rank) AS first FROM k JOIN r USING (query_id, id) GROUP BY 1) USING (query_id) GROUP BY language""", q=QUERY, k=RANKING, r=RELEVANT)
def e1_retrieval_metrics(t):
    return ev.retrieval_metrics(*_retrieval(t))


#: 'en' became 'on': no fewer edits can take away so many e's, nor so many words with 'en', and so many do.
@query("SELECT language, CAST(sum(n) AS BIGINT) AS edits, CAST(sum(length(expected)) AS BIGINT) AS characters, round(sum(n) / sum(length(expected)), 6) AS cer FROM (SELECT *, (length(expected) - length(replace(expected, 'en', ''))) // 2 AS n FROM ocr_eval) GROUP BY language", "ocr_eval")
def e3_character_errors(t):
    return ev.character_errors(spread(t.ocr_eval))


@query("SELECT language, CAST(sum(len(list_filter(w, lambda x: contains(x, 'en')))) AS BIGINT) AS edits, CAST(sum(len(w)) AS BIGINT) AS words, round(sum(len(list_filter(w, lambda x: contains(x, 'en')))) / sum(len(w)), 6) AS wer FROM (SELECT language, list_filter(string_split_regex(expected, '\\s+'), lambda x: x <> '') AS w FROM ocr_eval) GROUP BY language", "ocr_eval")
def e4_word_errors(t):
    return ev.word_errors(spread(t.ocr_eval))


@query("SELECT round(count(*) FILTER (WHERE score >= 0.4 AND NOT same) / count(*) FILTER (WHERE NOT same), 6) AS far, round(count(*) FILTER (WHERE score < 0.4 AND same) / count(*) FILTER (WHERE same), 6) AS frr FROM (SELECT vec_id % 3 = 0 AS same, (vec_id * 37 % 100) / CAST(100 AS DOUBLE) AS score FROM embeddings)")
def e5_face_metrics(t):
    return ev.face_metrics(t.embeddings.selectExpr("vec_id % 3 = 0 AS same", "CAST(vec_id * 37 % 100 AS DOUBLE) / 100 AS score"), 0.4)


@query("SELECT language, round(count(*) FILTER (WHERE s >= 0.6 AND NOT sensitive) / nullif(count(*) FILTER (WHERE NOT sensitive), 0), 6) AS fpr, round(count(*) FILTER (WHERE s < 0.6 AND sensitive) / nullif(count(*) FILTER (WHERE sensitive), 0), 6) AS fnr FROM (SELECT *, 1 / (1 + exp(sfw_logit - nsfw_logit)) AS s FROM sensitive_logits) GROUP BY language", "sensitive_logits")
def e6_sensitive_metrics(t):
    s = t.sensitive_logits.withColumn("score", nx.softmax_first(F.col("nsfw_logit"), F.col("sfw_logit")))
    return ev.sensitive_metrics(s, 0.6)


@query("SELECT count(*) FILTER (WHERE c > 1) AS repeated, CAST(0 AS BIGINT) AS unknown, (SELECT count(*) FROM labels WHERE doc_id % 10 = 3) AS out_of_range FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 4 = 0 AND doc_id % 10 <> 3) GROUP BY doc_id)")
def e7_bad_inputs(t):
    scores = t.labels.selectExpr("doc_id", "CASE WHEN doc_id % 10 = 3 THEN 1.5D ELSE 0.5D END AS score")
    return ev.bad_inputs(scores.union(scores.where("doc_id % 4 = 0 AND doc_id % 10 <> 3")), t.documents, "doc_id", "score")


@query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def j12_aligned(t):
    return ev.aligned(t.labels.select("doc_id", "quality"), t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", "lang"), "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels")
def e8_validate_run(t):
    """The run's rows, which carry the digests of the inputs that they were made from."""
    dataset = t.labels.agg(F.md5(F.sum(F.xxhash64("doc_id", "quality", "toxic").cast("decimal(38,0)")).cast("string")).alias("dataset_sha"), F.md5(F.count("*").cast("string")).alias("catalogue_sha"))
    run = t.labels.join(F.broadcast(dataset), F.lit(True))  # one row
    return ev.validate_run(dataset, run).select("doc_id", "quality", "toxic")


EDITS3 = "SELECT language, CAST(sum(n) AS BIGINT) AS edits, CAST(sum(length(expected)) AS BIGINT) AS characters, round(sum(n) / sum(length(expected)), 6) AS cer FROM (SELECT *, (length(expected) - length(replace(expected, 'en', ''))) // 2 AS n FROM ocr_eval) GROUP BY language"


@query("""SELECT stage, coalesce(status, 'not-run') AS status, metric, value FROM (SELECT unnest(['retrieval', 'ocr', 'faces', 'sensitive']) AS stage) LEFT JOIN (
 SELECT 'ocr' AS stage, 'ok' AS status, language || '.' || m AS metric, v AS value FROM (SELECT language, unnest(['edits', 'characters', 'cer']) AS m, unnest([edits, characters, cer]::DOUBLE[]) AS v FROM o)
 UNION ALL SELECT 'faces', 'ok', m, v FROM (SELECT unnest(['far', 'frr']) AS m, unnest([far, frr]::DOUBLE[]) AS v FROM f)) USING (stage)""", "ocr_eval", o=EDITS3,
       f="SELECT round(count(*) FILTER (WHERE score >= 0.4 AND NOT same) / count(*) FILTER (WHERE NOT same), 6) AS far, round(count(*) FILTER (WHERE score < 0.4 AND same) / count(*) FILTER (WHERE same), 6) AS frr FROM (SELECT vec_id % 3 = 0 AS same, (vec_id * 37 % 100) / CAST(100 AS DOUBLE) AS score FROM embeddings)")
def s11_eval_report(t):
    """The report's stages with each of their metrics, read back from its JSON."""
    told = ev.eval_report(t.spark, {"faces": e5_face_metrics(t), "ocr": e3_character_errors(t)})
    row = F.from_json("m", "language string, edits double, characters double, cer double, far double, frr double")
    lines = told.select("stage", "status", F.explode_outer(F.split("metrics", "\n")).alias("m")).select("stage", "status", row.alias("r"))
    named = F.array(*[F.struct(F.when(F.col("r.language").isNull(), F.lit(c)).otherwise(F.concat("r.language", F.lit(f".{c}"))).alias("metric"), F.col(f"r.{c}").alias("value")) for c in ("edits", "characters", "cer", "far", "frr")])
    known = F.filter(named, lambda x: x["value"].isNotNull())
    return lines.select("stage", "status", F.explode_outer(F.when(F.size(known) > 0, known)).alias("x")).select("stage", "status", "x.metric", "x.value")


@query("SELECT doc_id, lang FROM documents")
def s10_eval_dataset(t):
    """Rows written as JSON datasets of a hundred photos each, and read back as tables."""
    path = f"{shared_folder(t.spark)}/dataset-{uuid.uuid4().hex}"
    photo = F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    # A number of partitions of its own: rows this small would be put together, and then one task writes all files.
    sets = t.documents.select(F.expr("doc_id div 100").alias("k"), photo.alias("photo")).repartition(4 * t.spark.sparkContext.defaultParallelism, "k")
    sets.groupBy("k").agg(F.collect_list("photo").alias("photos")).select("photos").write.option("maxRecordsPerFile", 1).json(path)
    return ev.read_eval_dataset(t.spark, path, "photos array<struct<id:bigint,language:string>>")["photos"].select(F.col("id").alias("doc_id"), F.col("language").alias("lang"))


# --- recognised text ----------------------------------------------------------------------------
STEPS = "SELECT doc_id AS id, s AS step, CASE WHEN s % 4 = 3 THEN 0 ELSE 1 + (doc_id + s // 2) % 4 END AS best FROM documents, range(12) t(s)"


@query("SELECT id, string_agg(substr('abcd', CAST(best AS INTEGER), 1), '' ORDER BY step) AS text FROM (SELECT *, lag(best) OVER (PARTITION BY id ORDER BY step) AS before FROM st) WHERE best <> 0 AND (before IS NULL OR before <> best) GROUP BY id", st=STEPS)
def w8_ctc_collapse(t):
    steps = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step")).withColumn("best", F.expr("CASE WHEN step % 4 = 3 THEN 0 ELSE 1 + (id + step div 2) % 4 END"))
    probabilities = steps.select("id", "step", "best", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class")).select("id", "step", "class", F.when(F.col("class") == F.col("best"), 0.96).otherwise(0.01).alias("probability"))
    symbols = t.spark.createDataFrame([(i, "abcd"[i - 1]) for i in range(1, 5)], "class int, symbol string")
    return ev.ctc_collapse(probabilities, symbols).select("id", "text")


@query("SELECT doc_id // 8 AS media_id, sha256(string_agg(source || doc_id, chr(10) ORDER BY doc_id % 7, doc_id)) AS text, round(avg(n_chars % 100 / CAST(100 AS DOUBLE)), 6) AS confidence FROM documents GROUP BY 1")
def a10_assemble_ocr(t):
    regions = t.documents.selectExpr("doc_id div 8 AS media_id", "CAST(doc_id % 7 AS DOUBLE) AS top", "CAST(doc_id AS DOUBLE) AS left", "source || doc_id AS text", "CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence")
    out = ev.assemble_ocr(regions)
    return out.select("media_id", F.sha2("text", 256).alias("text"), F.round("confidence", 6).alias("confidence"))


#: Boxes of an image in the order of confidence, one a step: a box is kept if it overlaps no kept one by more than 0.3.
BOXES = "SELECT vec_id // 40 AS image_id, vec_id AS box_id, (vec_id % 37)::DOUBLE AS l, (vec_id % 23)::DOUBLE AS t, 0.85 + (vec_id % 97) / CAST(650 AS DOUBLE) AS confidence FROM embeddings"
NMS = """SELECT image_id, unnest(kept).b AS box_id FROM (SELECT image_id, arg_max(kept, k) AS kept FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS r FROM boxes WHERE confidence >= 0.9),
 w(image_id, k, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(b BIGINT, l DOUBLE, t DOUBLE)[] FROM o UNION ALL
  SELECT w.image_id, o.r, CASE WHEN len(list_filter(kept, lambda x: greatest(0, 8 - abs(x.l - o.l)) * greatest(0, 8 - abs(x.t - o.t)) > 0.3 * (128 - greatest(0, 8 - abs(x.l - o.l)) * greatest(0, 8 - abs(x.t - o.t))))) = 0 THEN list_append(kept, {b: o.box_id, l: o.l, t: o.t}) ELSE kept END
  FROM w JOIN o ON o.image_id = w.image_id AND o.r = w.k + 1) SELECT * FROM w) GROUP BY image_id)"""


@query("SELECT image_id, box_id FROM nms", boxes=BOXES, nms=NMS)
def o3_nms(t):
    boxes = t.embeddings.selectExpr("vec_id div 40 AS image_id", "vec_id AS box_id", "CAST(vec_id % 37 AS DOUBLE) AS left", "CAST(vec_id % 23 AS DOUBLE) AS top", "CAST(vec_id % 37 + 8 AS DOUBLE) AS right", "CAST(vec_id % 23 + 8 AS DOUBLE) AS bottom", "0.85D + (vec_id % 97) / 650.0D AS confidence")
    return ev.nms(boxes).select("image_id", "box_id")


#: Cosine weights summed over the four samples that fall on one of the eight rows, low coefficients, and their bits against the median.
DCT = "SELECT u, s // 4 AS a, sum(cos(u * (2 * s + 1) * pi() / 64) * CASE WHEN u = 0 THEN sqrt(CAST(1 AS DOUBLE) / 32) ELSE sqrt(CAST(2 AS DOUBLE) / 32) END) AS d FROM range(8) t(u), range(32) r(s) GROUP BY 1, 2"
LUMA = "SELECT event_id, i // 8 AS a, i % 8 AS b, (event_id * 31 + i * i * (user_id % 7 + 1)) % 256 AS x FROM events, range(64) t(i)"
LOW = "SELECT event_id, p.u * 8 + q.u - 1 AS i, round(sum(p.d * q.d * x), 6) AS c FROM luma l JOIN dct p ON p.a = l.a JOIN dct q ON q.a = l.b WHERE p.u + q.u > 0 GROUP BY 1, 2"


@query("SELECT event_id, CAST(sum(CASE WHEN c >= m THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END) AS BIGINT) AS bits FROM (SELECT *, list_sort(list(c) OVER (PARTITION BY event_id))[32] AS m FROM low) GROUP BY event_id", dct=DCT, luma=LUMA, low=LOW)
def d2_dct_hash(t):
    luma = t.events.select("event_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.pmod(F.col("event_id") * 31 + i * i * (F.col("user_id") % 7 + 1), F.lit(256))).cast("int")).alias("luma"))
    return luma.select("event_id", dedup.dct_hash("luma", F.lit(8), F.lit(8)).alias("bits"))


#: Words of each document; and how each distinct word is cut, a piece a step, always by the longest piece that fits next.
WORDS = r"SELECT doc_id, lang, unnest(list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(text)), '([\p{P}\p{S}\p{Han}])', ' \1 ', 'g'), '\s+'), lambda x: x <> '')) AS word FROM documents"
STEPS7 = "SELECT word, p AS pos, max(n) AS n FROM (SELECT DISTINCT word FROM words), unnest(range(1, length(word) + 1)) t(p), unnest(range(1, least(length(word) - p + 1, (SELECT max(length(piece)) FROM vocab)) + 1)) s(n) WHERE substr(word, p, n) IN (SELECT piece FROM vocab) GROUP BY word, p"
CUT = """SELECT word, CASE WHEN max(pos) > length(word) THEN max(k) END AS pieces FROM (WITH RECURSIVE c(word, pos, k) AS (SELECT DISTINCT word, 1::BIGINT, 0 FROM words UNION ALL SELECT c.word, c.pos + s.n, k + 1 FROM c JOIN steps s ON s.word = c.word AND s.pos = c.pos) SELECT * FROM c) GROUP BY word"""
PIECES = r"SELECT DISTINCT piece FROM (SELECT unnest([substr(word, 1, 1), substr(word, 1, 2), substr(word, 2, 1), substr(word, 2, 2), substr(word, 3, 2)]) AS piece FROM letters UNION ALL SELECT word FROM letters GROUP BY word HAVING count(*) >= 20) WHERE piece <> ''"
LETTERS = r"SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents"


def _vocab(t: Tables):
    """Pieces of one or two characters from the words' beginnings, and the words that occur twenty times."""
    letters = spread(t.documents.select("text")).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = letters.groupBy("word").agg(F.count("*").alias("n"))
    parts = F.array(F.substring("word", 1, 1), F.substring("word", 1, 2), F.substring("word", 2, 1), F.substring("word", 2, 2), F.substring("word", 3, 2))
    return counted.select(F.explode(F.concat(parts, F.when(F.col("n") >= 20, F.array("word")).otherwise(F.array().cast("array<string>")))).alias("piece")).where("piece <> ''").distinct()


@query("SELECT doc_id, lang, sum(coalesce(pieces, 1))::BIGINT AS tokens, sum(coalesce(pieces, 1)) > 77 AS truncated FROM words JOIN cut USING (word) GROUP BY doc_id, lang", letters=LETTERS, vocab=PIECES, words=WORDS, steps=STEPS7, cut=CUT)
def n7_token_report(t):
    return tokenize_corpus(spread(t.documents.select("doc_id", "lang", "text")), _vocab(t))[0]


#: Where all pieces are single characters, a word is known if all of its characters are.
@query("SELECT lang, count(*) AS words, round(count(*) FILTER (WHERE unknown) / count(*), 6) AS unknown_rate FROM words JOIN (SELECT word, len(list_filter(string_split(word, ''), lambda c: NOT list_contains(v, c))) > 0 AS unknown FROM (SELECT DISTINCT word FROM words), (SELECT list(piece) AS v FROM vocab)) USING (word) GROUP BY lang",
       vocab="SELECT DISTINCT unnest(string_split(lower(text), '')) AS piece FROM documents WHERE lang = 'en'", words=WORDS)
def n7_unknown_rates(t):
    docs = spread(t.documents.select("doc_id", "lang", "text"))
    vocab = docs.where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "")).alias("piece")).distinct()
    return tokenize_corpus(docs, vocab)[1]


@query("SELECT doc_id, 1 + doc_id % 3 AS regions, source || '0' AS first_text, (doc_id % 3) * (1 + doc_id % 3) / CAST(8 AS DOUBLE) AS lefts, false AS broken FROM documents")
def s28_regions_json(t):
    region = lambda i: F.struct(F.concat("source", i.cast("string")).alias("text"), F.lit(0.5).alias("confidence"), *[(i / 4 + k).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))])
    stored = t.documents.select("doc_id", tx.regions_to_json(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), region)).alias("json"))
    read = stored.select("doc_id", tx.regions_from_json(F.col("json")).alias("r"), tx.regions_from_json(F.concat(F.lit("{"), "json")).isNotNull().alias("broken"))
    return read.select("doc_id", F.size("r").cast("long").alias("regions"), F.col("r")[0]["text"].alias("first_text"), F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x["left"]).alias("lefts"), "broken")


@query("SELECT media_id FROM v WHERE n % 3 = 0", *M, v=V)
def g8_published(t):
    """Two generations published one after the other; readers see the last."""
    path = f"{shared_folder(t.spark)}/published-{uuid.uuid4().hex}"
    for k in (2, 3):
        catalog.publish(shown(t).where(F.col("n") % k == 0).select("media_id"), path, f"g{k}", keep=1)
    return catalog.read_published(t.spark, path)


# --- stores and streams -------------------------------------------------------------------------
def _store(t: Tables, **options) -> BucketStore:
    return BucketStore(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}", **options)


@query("SELECT event_id % 500 AS media_id, max(event_id) AS content_revision FROM events GROUP BY 1")
def x1_stored_revisions(t):
    """Three batches of two streams folded into a store, one of them twice; the second stream numbers its batches from 0 again."""
    e, store = t.events.selectExpr("event_id % 500 AS media_id", "event_id AS content_revision", "1L AS access_epoch"), _store(t)
    for stream, number, part in (("a", 0, 0), ("a", 1, 1), ("a", 1, 1), ("b", 0, 2)):
        last = Window.partitionBy("media_id").orderBy(F.col("content_revision").desc())
        store.fold(e.where(F.col("content_revision") % 3 == part).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r"), jobs.latest_revisions, stream, number)
    return store.read().select("media_id", "content_revision")


@query("SELECT n % 3 AS batch, count(*) AS changes FROM o JOIN m USING (media_id) WHERE m.content_revision > o.content_revision GROUP BY 1", "media", o="SELECT media_id, content_revision - n % 2 AS content_revision FROM media", m="SELECT media_id, n, content_revision FROM media")
def x8_stored_changes(t):
    """Changes counted batch by batch while they are folded into a store."""
    store, m = _store(t), t.media.select("media_id", "content_revision", "access_epoch", "n")
    store.upsert(m.withColumn("content_revision", F.col("content_revision") - F.col("n") % 2).drop("n"))
    for number in range(3):
        jobs.fold_counting(m.where(F.col("n") % 3 == number).drop("n"), store, f"{store.path}/changes", ["content_revision"], "s", number)
    return t.spark.read.parquet(f"{store.path}/changes").select(F.col("batch").cast("long").alias("batch"), "changes")


@query("SELECT media_id, CASE WHEN n % 4 = 1 THEN 'changed' ELSE display_name END AS display_name FROM media UNION ALL SELECT 'new' || media_id, 'new' FROM media WHERE n % 10 = 0", "media")
def s8_stored_upsert(t):
    store, m = _store(t, buckets=8), t.media
    store.upsert(m.select("media_id", "display_name"))
    store.upsert(m.where("n % 4 = 1").selectExpr("media_id", "'changed' AS display_name").union(m.where("n % 10 = 0").selectExpr("'new' || media_id", "'new'")))
    return store.read()


@query("SELECT media_id, content_revision, 2::BIGINT AS attempts FROM media WHERE n % 2 = 0", "media")
def g3_scan_retried(t):
    """A scan during which a volume moves once: the first try is discarded, the second committed."""
    store, asked = _store(t, buckets=4), iter([1, 2, 2, 2])
    states = lambda: t.media.select(F.col("volume_name").alias("volume"), F.lit("v").alias("version"), F.lit(next(asked)).cast("long").alias("generation")).distinct()
    tries = store.scan(states, lambda _: t.media.where("n % 2 = 0").select("media_id", "content_revision"), lambda old, new: catalog.upsert(old, new, ["media_id"]))
    return store.read().withColumn("attempts", F.lit(tries).cast("long"))


# --- streams, as their batch twins --------------------------------------------------------------
@query("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS started, count(*) AS events FROM (SELECT ts, sum(new) OVER (ORDER BY ts, event_id) AS s FROM (SELECT event_id, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL '60' SECOND THEN 0 ELSE 1 END AS new FROM events)) GROUP BY s")
def x3_bursts(t):
    return jobs.bursts(t.events, gap="60 seconds").select(F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSS").alias("started"), "events")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day_key, count(*) AS items FROM events GROUP BY 1")
def x4_live_periods(t):
    return jobs.live_periods(t.events)


@query("SELECT sha256(text) AS sha FROM documents GROUP BY 1")
def x5_dedup(t):
    return jobs.stream_dedup(t.documents.select(F.sha2("text", 256).alias("sha"), F.timestamp_seconds("doc_id").alias("ts")), "sha").select("sha")


@query("SELECT media_id, n, 1 + coalesce(sum(b) OVER (PARTITION BY media_id ORDER BY n), 0)::BIGINT AS access_epoch FROM (SELECT *, CASE WHEN a = 'AVAILABLE' AND lag(a) OVER (PARTITION BY media_id ORDER BY n) <> 'AVAILABLE' THEN 1 ELSE 0 END AS b FROM (SELECT 'u' || user_id AS media_id, event_id AS n, CASE WHEN event_id % 3 = 0 THEN 'MISSING' ELSE 'AVAILABLE' END AS a FROM events))")
def x2_access_epochs(t):
    return jobs.epochs_batch(t.events.selectExpr("'u' || user_id AS media_id", "event_id AS n", "CASE WHEN event_id % 3 = 0 THEN 'MISSING' ELSE 'AVAILABLE' END AS availability"))


@query("SELECT event_id % 500 AS media_id, max(event_id) AS content_revision FROM events GROUP BY 1")
def x1_latest_revisions(t):
    e = t.events.selectExpr("event_id % 500 AS media_id", "event_id AS content_revision", "1L AS access_epoch")
    return jobs.latest_revisions(e.where("content_revision % 2 = 0"), e.where("content_revision % 2 = 1")).select("media_id", "content_revision")


@query("SELECT native_key FROM ai_embedding JOIN (SELECT m.* FROM media m JOIN exposure x ON x.media_id = m.media_id AND x.content_revision = m.content_revision WHERE availability = 'AVAILABLE' AND exposure = 'SAFE' AND trashed_at IS NULL) el USING (media_id, content_revision, access_epoch)", "media", "exposure", "ai_embedding")
def x7_publish_fence(t):
    return fence.current(t.ai_embedding, live(t)).select("native_key")


@query("SELECT media_id, epoch_us(max(ts)) // 1000 AS trashed_ms FROM (SELECT 'u' || user_id AS media_id, ts, event_id % 4 <> 0 AS other FROM events) GROUP BY media_id HAVING NOT max(struct_pack(t := ts, o := other)).o AND epoch_us(max(ts)) // 1000 + 86400000 < (SELECT epoch_us(max(ts)) // 1000 FROM events)")
def x6_retention(t):
    rows = t.events.selectExpr("'u' || user_id AS media_id", "ts", "CASE WHEN event_id % 4 = 0 THEN 'TRASHED' ELSE 'AVAILABLE' END AS availability")
    now = t.events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] or 0
    return jobs.retention_batch(rows, now, days=1)


@query("SELECT n % 3 AS batch, count(*) AS changes FROM o JOIN m USING (media_id) WHERE m.content_revision > o.content_revision GROUP BY 1", "media", o="SELECT media_id, content_revision - n % 2 AS content_revision FROM media", m="SELECT media_id, n, content_revision FROM media")
def x8_revision_changes(t):
    m = t.media.select("media_id", "content_revision", "access_epoch", (F.col("n") % 3).alias("batch"))
    old = t.media.selectExpr("media_id", "content_revision - n % 2 AS content_revision", "access_epoch", "n % 3 AS batch")
    new = jobs.latest_revisions(old, m)
    changed = dedup.snapshot_diff(old, new, "media_id", ["content_revision"])
    return changed.join(m.select("media_id", "batch"), "media_id").groupBy("batch").agg(F.count("*").alias("changes"))
