"""Every registered query of the article and audience operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html
from ..functions import text as X
from ..operators import backlog, brief, report, similarity
from ..params import DEFAULT as P
from ..params import SEGMENT_OF
from ..sources import tables as S
from ..streaming import windows

END = P.day + report.DAY
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def day(column: str) -> str:
    return f"{column} >= TIMESTAMP '{P.day}' AND {column} < TIMESTAMP '{END}'"


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN floor({n} * 1000.0::DOUBLE / {d} + 0.5) / 10.0::DOUBLE ELSE 0.0::DOUBLE END"


USERS = S.users_sql(END)
STATS = f"""SELECT count(*) AS events, count(*) FILTER (kind = 'useful') AS useful, count(*) FILTER (kind = 'noise') AS noise,
  count(*) FILTER (kind = 'anxious') AS anxious, count(DISTINCT user_id) AS users FROM feedback WHERE {day("occurred_at")}"""
DELIVERED = f"SELECT count(*) AS delivered FROM users WHERE {day('last_delivery_at')}"
INTENT = f"SELECT count(*) AS intent_events, count(DISTINCT user_id) AS intent_users FROM intents WHERE {day('occurred_at')}"


def retention_sql(n: int, cohort: str = "cohort", retained: str = "retained") -> str:
    start = END - (n + 1) * report.DAY
    return f"""SELECT count(*) AS {cohort}, count(*) FILTER (EXISTS (SELECT 1 FROM feedback f WHERE f.user_id = u.user_id
      AND f.occurred_at >= TIMESTAMP '{start + report.DAY}' AND f.occurred_at < TIMESTAMP '{END}')) AS {retained}
      FROM users u WHERE onboarded_at >= TIMESTAMP '{start}' AND onboarded_at < TIMESTAMP '{start + report.DAY}'"""


@register(f"WITH {S.FEEDBACK_SQL} {STATS}")
def feedback_stats_daily(spark, d):
    return report.feedback_stats(S.feedback(spark, d), P.day, END)


@register(f"WITH {USERS} {DELIVERED}")
def delivered_users(spark, d):
    return report.delivered_users(S.users(spark, d, END), P.day, END)


@register(f"WITH {S.INTENTS_SQL} {INTENT}")
def premium_intent_stats(spark, d):
    return report.intent_stats(S.intents(spark, d), P.day, END)


BY_SEGMENT = f"""SELECT coalesce(nullif(trim(segment), ''), 'general') AS segment, count(*) AS intent_events,
  count(DISTINCT user_id) AS intent_users FROM intents WHERE {day("occurred_at")} GROUP BY 1"""


@register(f"WITH {S.INTENTS_SQL} {BY_SEGMENT}")
def premium_intent_by_segment(spark, d):
    return report.intent_by_segment(S.intents(spark, d), P.day, END)


@register(f"WITH {USERS}, {S.FEEDBACK_SQL} {retention_sql(1)}")
def retention_d1(spark, d):
    return report.retention(S.users(spark, d, END), S.feedback(spark, d), END, 1)


@register(f"WITH {USERS}, {S.FEEDBACK_SQL} {retention_sql(7)}")
def retention_d7(spark, d):
    return report.retention(S.users(spark, d, END), S.feedback(spark, d), END, 7)


@register(f"""WITH {USERS}, {S.user_topics_sql()} SELECT u.user_id, coalesce(string_agg(topic_slug, ',' ORDER BY topic_slug), '') AS topics
  FROM users u LEFT JOIN user_topics t ON t.user_id = u.user_id GROUP BY u.user_id""")
def user_topics_csv(spark, d):
    return report.topics_csv(S.users(spark, d, END), S.user_topics(spark, d))


_bucket = " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in SEGMENT_OF.items())
SEGMENTS = f"""segments AS (SELECT u.user_id, CASE WHEN count(b) = 0 THEN 'general' WHEN count(DISTINCT b) > 1 THEN 'mixed'
  ELSE min(b) END AS segment FROM users u LEFT JOIN (SELECT user_id, CASE topic_slug {_bucket} END AS b FROM user_topics) t
  ON t.user_id = u.user_id WHERE {day("last_delivery_at")} GROUP BY u.user_id)"""


@register(f"""WITH {USERS}, {S.user_topics_sql()}, {S.INTENTS_SQL}, {SEGMENTS},
  a AS (SELECT segment, count(*) AS delivered FROM segments GROUP BY 1), b0 AS ({BY_SEGMENT}),
  b AS (SELECT lower(trim(segment)) AS segment, intent_events, intent_users FROM b0),
  j AS (SELECT coalesce(a.segment, b.segment) AS segment, coalesce(delivered, 0) AS delivered, coalesce(intent_users, 0) AS intent_users,
    coalesce(intent_events, 0) AS intent_events FROM a FULL JOIN b ON a.segment = b.segment)
  SELECT *, {pct("intent_users", "delivered")} AS intent_pct FROM j""")
def premium_segment_report(spark, d):
    return report.segment_report(S.users(spark, d, END), S.user_topics(spark, d), S.intents(spark, d), P.day, END)


@register(f"""WITH {USERS}, {S.FEEDBACK_SQL}, {S.INTENTS_SQL}, a AS ({STATS}), b AS ({DELIVERED}), c AS ({INTENT}),
  r1 AS ({retention_sql(1, "d1_cohort", "d1_retained")}), r7 AS ({retention_sql(7, "d7_cohort", "d7_retained")})
  SELECT *, {pct("useful", "(useful + noise + anxious)")} AS useful_rate, {pct("noise", "(useful + noise + anxious)")} AS noise_rate,
  {pct("users", "delivered")} AS ctr, {pct("intent_users", "delivered")} AS intent_pct, {pct("d1_retained", "d1_cohort")} AS d1_pct,
  {pct("d7_retained", "d7_cohort")} AS d7_pct FROM a, b, c, r1, r7""")
def product_daily_report(spark, d):
    return report.daily_report(S.users(spark, d, END), S.feedback(spark, d), S.intents(spark, d), P.day)


ASOF = f"TIMESTAMP '{P.as_of}'"


@register(f"""WITH {S.users_sql(P.as_of)} SELECT user_id, chat_id, frequency, least(greatest(coalesce(
    floor(epoch(({ASOF} - last_delivery_at)) / 3600), 24), 6), 168)::BIGINT AS lookback_hours
  FROM users WHERE enabled AND trim(chat_id) <> '' AND CASE WHEN last_delivery_at IS NULL THEN onboarded_at IS NOT NULL
  ELSE last_delivery_at + to_days(CASE frequency WHEN 'DAILY' THEN 1 WHEN 'EVERY_2_DAYS' THEN 2 ELSE 3 END) <= {ASOF} END""")
def digest_due_users(spark, d):
    return report.due_users(S.users(spark, d, P.as_of), P.as_of)


def vectors_as_news(spark, d) -> DataFrame:
    return S.read(spark, d, "labels").select(F.col("doc_id").alias("id"))


STALE = f"(claimed_at IS NULL OR claimed_at < TIMESTAMP '{P.as_of - P.lease}')"


def waiting(stage: str) -> str:
    return f"(status_{stage} = 'PENDING' OR status_{stage} = 'IN_PROGRESS' AND {STALE})"


TEXT = "trim(content_clean, ' ') <> ''"
LOST = "(status_embedding = 'DONE' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = id))"


@register(f"WITH {S.NEWS_SQL} SELECT id, event_at FROM news WHERE {waiting('content')} ORDER BY event_at, id LIMIT {P.batch_content}")
def claim_content(spark, d):
    return backlog.claim_content(S.news(spark, d), P.as_of, P.lease, P.batch_content)


@register(f"""WITH {S.NEWS_SQL} SELECT id, event_at FROM news WHERE status_content = 'DONE' AND {TEXT}
  AND ({waiting("embedding")} OR {LOST}) ORDER BY event_at, id LIMIT {P.batch_embedding}""")
def claim_embedding(spark, d):
    return backlog.claim_embedding(S.news(spark, d), vectors_as_news(spark, d), P.as_of, P.lease, P.batch_embedding)


@register(f"""WITH {S.NEWS_SQL} SELECT id, event_at FROM news WHERE status_content = 'DONE' AND status_embedding = 'DONE' AND {TEXT}
  AND event_at <= TIMESTAMP '{P.as_of - P.maturity}' AND {waiting("summary")} ORDER BY event_at, id LIMIT {P.batch_summary}""")
def claim_summary(spark, d):
    return backlog.claim_summary(S.news(spark, d), P.as_of, P.lease, P.maturity, P.batch_summary)


@register(f"""WITH {S.NEWS_SQL}, c AS (SELECT count(*) FILTER (status_content = 'PENDING') AS content_pending,
  count(*) FILTER (status_content = 'IN_PROGRESS') AS content_active, count(*) FILTER (status_content = 'FAILED') AS content_failed,
  count(*) FILTER (status_content = 'DONE' AND {TEXT} AND (status_embedding = 'PENDING' OR {LOST})) AS embedding_pending,
  count(*) FILTER (status_embedding = 'IN_PROGRESS') AS embedding_active, count(*) FILTER (status_embedding = 'FAILED') AS embedding_failed,
  count(*) FILTER (status_content = 'DONE' AND {TEXT} AND status_embedding = 'DONE' AND status_summary = 'PENDING') AS summary_pending,
  count(*) FILTER (status_summary = 'IN_PROGRESS') AS summary_active, count(*) FILTER (status_summary = 'FAILED') AS summary_failed FROM news)
  SELECT *, content_pending + content_active + embedding_pending + embedding_active + summary_pending + summary_active AS outstanding FROM c""")
def pipeline_backlog(spark, d):
    return backlog.backlog(S.news(spark, d), vectors_as_news(spark, d))


LATEST = """latest AS (SELECT news_id, version, lang, summary FROM summaries
  QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY lang = 'en' DESC, version DESC) = 1)"""


@register(f"WITH {S.SUMMARIES_SQL}, {LATEST} SELECT * FROM latest")
def latest_summary_per_item(spark, d):
    return backlog.latest_summary(S.summaries(spark, d), "en")


@register(f"""WITH {S.SUMMARIES_SQL} SELECT * FROM summaries QUALIFY row_number() OVER (PARTITION BY news_id, lang ORDER BY version DESC) = 1""")
def last_wins_summary(spark, d):
    return backlog.last_wins(S.summaries(spark, d), ["news_id", "lang"], "version")


@register(f"""WITH {S.NEWS_SQL}, {S.SUMMARIES_SQL} SELECT n.id, m.id AS "of", version, (n.id = m.id)::INT AS own FROM news n JOIN news m
  ON n.id = m.id OR n.content_hash = m.content_hash JOIN summaries s ON s.news_id = m.id WHERE s.lang = 'en'
  QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY n.id = m.id DESC, version DESC, m.id) = 1""")
def reusable_summary(spark, d):
    return backlog.reusable_summary(S.news(spark, d), S.summaries(spark, d), "en")


PROBES = "probes AS (SELECT id AS probe, id * 7 % (1 + (SELECT max(id) FROM news)) AS id, url, content_hash FROM news)"


@register(f"""WITH {S.NEWS_SQL}, {PROBES}, s AS (SELECT probe, n.id AS found, 3 * (n.id = p.id)::INT + 2 * (n.url = p.url)::INT
  + (n.content_hash = p.content_hash)::INT AS score FROM probes p JOIN news n ON n.id = p.id OR n.url = p.url OR n.content_hash = p.content_hash)
  SELECT probe, found, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, found) = 1""")
def natural_key_resolution(spark, d):
    n = S.news(spark, d)
    size = n.agg((F.max("id") + 1).alias("size"))  # one row
    probes = n.join(F.broadcast(size)).select(F.col("id").alias("probe"), (F.col("id") * 7 % F.col("size")).alias("id"), "url", "content_hash")
    return backlog.resolve_natural_keys(probes, n)


NEW = """fresh AS (SELECT url, upper(media) AS media, CASE WHEN id % 2 = 0 THEN 'xx' END AS language FROM news WHERE id % 5 = 0
  UNION ALL SELECT url || '/new', media, NULL FROM news WHERE id % 5 = 1)"""


@register(f"""WITH {S.NEWS_SQL}, {NEW} SELECT coalesce(f.url, n.url) AS url, CASE WHEN f.url IS NOT NULL THEN f.media ELSE n.media END AS media,
  coalesce(f.language, n.language) AS language FROM news n FULL JOIN fresh f ON n.url = f.url""")
def upsert_merge(spark, d):
    n = S.news(spark, d).select("id", "url", "media", "language")
    known = n.where("id % 5 = 0").select("url", F.upper("media").alias("media"), F.when(F.col("id") % 2 == 0, "xx").alias("language"))
    added = n.where("id % 5 = 1").select(F.concat("url", F.lit("/new")).alias("url"), "media", F.lit(None).cast("string").alias("language"))
    return backlog.upsert(n.drop("id"), known.unionByName(added), "url", ["media"], ["language"])


@register(f"WITH {S.NEWS_SQL} SELECT content_hash, min(id) AS id, count(*) AS copies FROM news GROUP BY 1")
def content_hash_dedup(spark, d):
    return backlog.first_by_content(S.news(spark, d))


@register(f"""WITH {S.NEWS_SQL}, {S.SUMMARIES_SQL}, r AS (SELECT n.*, EXISTS (SELECT 1 FROM summaries s WHERE s.news_id = n.id) AS hit,
  n.id % 4 = 0 AS top, event_at <= TIMESTAMP '{P.as_of - P.maturity}' AS mature, CAST(event_at AS DATE) AS day FROM news n
  WHERE status_content = 'DONE' AND status_embedding = 'DONE'),
  k AS (SELECT id AS kid, row_number() OVER (PARTITION BY day ORDER BY event_at, id) AS nth FROM r WHERE NOT hit AND mature AND top)
  SELECT id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN hit THEN 'REUSE_CACHED' WHEN NOT mature THEN 'DEFER' WHEN NOT top THEN 'USE_FALLBACK'
    WHEN nth > 12 THEN 'USE_FALLBACK' ELSE 'USE_PROVIDER' END AS plan FROM r LEFT JOIN k ON kid = id""")
def daily_budget_planner(spark, d):
    n = S.news(spark, d)
    cached = S.summaries(spark, d).select(F.col("news_id").alias("id")).distinct()
    plan = backlog.plan_summaries(n, cached, n.where("id % 4 = 0").select("id"), P.as_of, P.maturity, 12)
    return plan.withColumn("day", F.col("day").cast("string"))


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"


@register(f"""SELECT doc_id, coalesce(nullif({squeeze_sql(r"string_split(regexp_replace(" + squeeze_sql("text") + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]")}, ''), '') AS first
  FROM documents""".replace("AS first", "AS sentence"))
def first_sentence(spark, d):
    part = F.trim(F.get(F.split(X.clean(F.col("text")), r"(?<=[.!?])\s+"), F.lit(0)))
    return S.read(spark, d, "documents").select("doc_id", part.alias("sentence"))


@register("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), '[^\\p{L}\\p{Nd} ]', '', 'g'),
  ' +', ' ', 'g'), ' ') AS key FROM documents""")
def dedup_keys(spark, d):
    return S.read(spark, d, "documents").select("doc_id", X.dedup_key(F.col("text")).alias("key"))


def _any(words) -> str:
    return "(" + " OR ".join("contains(lower(text), '{}')".format(w.replace("'", "''")) for w in words) + ")"


@register("SELECT doc_id, " + ", ".join(f"{_any(X.TOPIC_KEYWORDS[t])} AS {t}" for t in X.TOPIC_KEYWORDS) + " FROM documents")
def topic_match(spark, d):
    return S.read(spark, d, "documents").select("doc_id", *[X.matches_topics(F.col("text"), (t,)).alias(t) for t in X.TOPIC_KEYWORDS])


def _hits(words) -> str:
    return "(" + " + ".join("contains(lower(c), '{}')::INT".format(w.replace("'", "''")) for w in words) + ")"


@register(f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace({squeeze_sql("text")}, '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g') AS c FROM documents)
  SELECT doc_id, least(3, {_hits(X.HYPE_EN)}) + least(4, 2 * {_hits(X.CLICKBAIT_EN)}) + regexp_matches(c, '[!?]{{2,}}')::INT
    + regexp_matches(c, '\\b\\p{{Lu}}{{4,}}\\b')::INT AS tone FROM t""")
def tone_score(spark, d):
    return S.read(spark, d, "documents").select("doc_id", X.tone_score(X.calm(F.col("text"))).alias("tone"))


@register(f"""WITH t AS (SELECT doc_id, source, {squeeze_sql("text")} AS c FROM documents),
  f AS (SELECT *, trim(left(regexp_extract(c, '^[^.!?]*[.!?]?'), 220), ' ') AS s FROM t)
  SELECT doc_id, CASE WHEN s = '' OR lower(s) = lower(source) THEN source ELSE source || '. ' || s END AS summary FROM f""")
def summary_fallback(spark, d):
    return S.read(spark, d, "documents").select("doc_id", X.fallback_summary(F.col("source"), F.col("text")).alias("summary"))


TOKENS = """tok AS (SELECT doc_id, list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(
  text, '\\s+', ' ', 'g'), ' ')), '[^\\p{L}\\p{Nd} ]', '', 'g'), ' +', ' ', 'g'), ' '), ' '), lambda w: length(w) >= 4),
  lambda w: left(w, 6))) AS t FROM documents)"""


@register(f"""WITH {TOKENS} SELECT a.doc_id, len(list_intersect(a.t, b.t)) AS common, CASE WHEN least(len(a.t), len(b.t)) > 0
  THEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))::DOUBLE ELSE 0.0::DOUBLE END AS ratio
  FROM tok a JOIN tok b ON b.doc_id = a.doc_id + 1""")
def fingerprint_overlap(spark, d):
    t = S.read(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("t"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("o"))
    common = F.size(F.array_intersect("t", "o")).cast("long").alias("common")
    return t.join(n, "doc_id").select("doc_id", common, X.overlap_ratio(F.col("t"), F.col("o")).alias("ratio"))


EDGES = f"""edges AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {P.similar_min})"""


@register(f"""SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b
  WHERE a.vec_id = 7 AND b.vec_id <> 7 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.0 ORDER BY score DESC, 1 LIMIT {P.similar_top}""")
def knn_top5(spark, d):
    found = similarity.most_similar(S.read(spark, d, "embeddings"), 7, 0.0, P.similar_top)
    return found.select("vec_id", F.round("score", 6).alias("score"))


def _edges(spark, d) -> DataFrame:
    return similarity.similarity_edges(S.read(spark, d, "embeddings"), P.similar_min)


@register(f"WITH {EDGES} SELECT src, dst, round(score, 6) AS score FROM edges")
def similarity_edges(spark, d):
    return _edges(spark, d).select("src", "dst", F.round("score", 6).alias("score"))


COMPONENTS = f"""{EDGES}, reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT e.dst, reach.r FROM reach JOIN edges e ON e.src = reach.id),
  comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


@register(f"WITH RECURSIVE {COMPONENTS} SELECT * FROM comp")
def similarity_components(spark, d):
    nodes = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return similarity.connected(nodes, _edges(spark, d))


@register(f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1),
  t AS (SELECT c.component, src, sum(score) AS total FROM edges JOIN comp c ON c.id = src GROUP BY 1, 2)
  SELECT t.component, size, src AS representative FROM t JOIN s ON s.component = t.component
  QUALIFY row_number() OVER (PARTITION BY t.component ORDER BY round(total, 12) DESC, src) = 1""")
def cluster_representatives(spark, d):
    edges = _edges(spark, d)
    nodes = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return similarity.representatives(similarity.connected(nodes, edges), edges)


@register("""WITH n AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS l FROM embeddings),
  p AS (SELECT label, i - 1 AS place, avg((embedding[i]::DOUBLE / l)::FLOAT::DOUBLE) AS x FROM n, range(1, 65) r(i) GROUP BY 1, 2)
  SELECT label, place::INT AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM p""")
def mean_pooled_vectors(spark, d):
    return similarity.mean_pooled(S.read(spark, d, "embeddings"), "label").select("label", "place", F.round("x", 5).alias("x"))


def _candidates(spark, d) -> DataFrame:
    latest = backlog.latest_summary(S.summaries(spark, d), "en")
    rows = brief.candidates(S.news(spark, d), latest, P.as_of, P.window_hours, P.brief_limit)
    return brief.ranked(brief.first_seen(rows))


@register(f"""WITH {S.NEWS_SQL}, {S.SUMMARIES_SQL}, {LATEST} SELECT id, event_at, media, version FROM news JOIN latest ON news_id = id
  WHERE status_summary = 'DONE' AND event_at >= TIMESTAMP '{P.as_of}' - INTERVAL {P.window_hours} HOUR
  ORDER BY event_at DESC, id LIMIT {8 * P.brief_limit}""")
def brief_candidates(spark, d):
    latest = backlog.latest_summary(S.summaries(spark, d), "en").withColumnRenamed("version", "v")
    rows = brief.candidates(S.news(spark, d), latest, P.as_of, P.window_hours, P.brief_limit)
    return rows.join(latest.select(F.col("news_id").alias("id"), F.col("v").alias("version")), "id").select("id", "event_at", "media", "version")


@register()
def daily_brief_select(spark, d):
    rows = _candidates(spark, d)
    near = similarity.edges_from(S.read(spark, d, "embeddings"), rows.select("id"), P.similar_min, P.neighbours)
    near = near.join(F.broadcast(rows.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst")
    return brief.select_digest(rows, near, P.brief_limit)


def _batches(rows: DataFrame, kind: str, make) -> DataFrame:
    """Arrow batches of ``rows`` through ``make``, which gives the rows (tuples of ``kind``) of one row."""
    names = rows.columns
    schema = T.StructType.fromDDL(kind)

    def run(batches):
        arrow = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in schema])
        for b in batches:
            made = [x for r in zip(*(b.column(n).to_pylist() for n in names), strict=True) for x in make(*r)]
            columns = list(zip(*made, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, kind)


@register()
def article_text(spark, d):
    pages = S.read(spark, d, "pages").select("page_id", "html")
    return _batches(pages, "page_id long, article string", lambda i, x: [(i, html.article_text(x))])


@register()
def clean_content(spark, d):
    n = S.read(spark, d, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), "text")
    return _batches(n, "doc_id long, content string", lambda i, title, x: [(i, html.clean_article(title, "", x))])


@register()
def sentence_chunks(spark, d):
    n = S.read(spark, d, "documents").select("doc_id", "text")
    return _batches(n, "doc_id long, place long, chunk string", lambda i, x: [(i, k, c) for k, c in enumerate(html.chunks(x))])


@register()
def message_parts(spark, d):
    n = S.read(spark, d, "documents").select("doc_id", "text")
    return _batches(n, "doc_id long, place long, part string", lambda i, x: [(i, k, c) for k, c in enumerate(html.message_parts(x or ""))])


@register("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, count(*) / 300.0::DOUBLE AS rate FROM events GROUP BY 1, 2""")
def rate_5m(spark, d):
    out = windows.rate(S.read(spark, d, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT hour, event_type, n, max(n) OVER w AS peak, avg(n) OVER w AS mean FROM h
  WINDOW w AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)""")
def backlog_peak(spark, d):
    return windows.peak(S.read(spark, d, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@register("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS share FROM events GROUP BY 1),
  l AS (SELECT *, lag(share) OVER (ORDER BY hour) AS last, lag(hour) OVER (ORDER BY hour) AS last_hour FROM h)
  SELECT hour, share FROM l WHERE share > 0.2 AND last > 0.2 AND last_hour = hour - INTERVAL 1 HOUR""")
def error_ratio_alert(spark, d):
    return windows.error_alert(S.read(spark, d, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@register("""SELECT event_type, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.5), 6) AS p50 FROM events GROUP BY 1""")
def p95_by_type(spark, d):
    q = windows.quantiles(S.read(spark, d, "events"))
    return q.select("event_type", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"))


@register("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS ts FROM events GROUP BY 1, 2""")
def last_over_time(spark, d):
    return windows.last_values(S.read(spark, d, "events"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, d):
    out = windows.sessions(S.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _schema(spark, d) -> T.StructType:
    return S.read(spark, d, "events").schema


@register("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return windows.run_stream(spark, d, _schema(spark, d), windows.daily_counts, "complete")


@register("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return windows.run_stream(spark, d, _schema(spark, d), windows.first_of_key, "append")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more  # noqa: F401  registers its queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return dict(_sql)
