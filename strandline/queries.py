"""One query per operator over the synthetic tables, with the SQL that checks it.

Messages come from events: a channel per event_type, ids built of the time and the event's number. Conversations give
replies and per-channel listings, pages attachments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, text
from .operators import dedup, normalize, shards, windows
from .plans import decisions, progress

#: The moment that plans are made for (2024-02-01 UTC), where the archive ends, and where the incoming batch begins.
NOW = 1706745600000
CUT, FROM = 1705708800000, 1705622400000
CHUNK = 500
DAY = 86_400_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

M = f"""m AS (
    SELECT event_id AS seq, event_type AS channel_id, user_id, value, props, epoch_us(ts) // 1000 AS ms,
           (epoch_us(ts) // 1000 - {ids.EPOCH_MS}) * 4194304 + event_id % 4194304 AS id_num
    FROM events
)"""
ARCHIVE = f"""archive AS (
    SELECT *, CAST((rn - 1) // {CHUNK} + 1 AS INTEGER) AS part, CAST((rn - 1) % {CHUNK} AS INTEGER) AS row_seq
    FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id_num) AS rn FROM m WHERE ms < {CUT})
)"""
INCOMING = f"""incoming AS (SELECT * FROM m WHERE ms >= {FROM} UNION ALL SELECT * FROM m WHERE ms >= {FROM} AND seq % 10 = 0)"""
CHANNELS = f"channels AS (SELECT channel_id, (min(ms) - {DAY} - {ids.EPOCH_MS}) * 4194304 AS channel FROM m GROUP BY channel_id)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    e = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel_id"), "user_id", "value", "props", ms.alias("ms"))
    num = (F.col("ms") - ids.EPOCH_MS) * (1 << ids.TIME_SHIFT) + F.col("seq") % (1 << ids.TIME_SHIFT)
    return e.withColumn("id_num", num).withColumn("id", F.col("id_num").cast("string"))


def archive(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).where(F.col("ms") < CUT)
    none = spark.createDataFrame([], "channel_id string, part int, rows bigint")
    return dedup.deal_parts(rows, none, CHUNK)


def incoming(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).where(F.col("ms") >= FROM)
    return rows.unionByName(rows.where("seq % 10 = 0"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).groupBy("channel_id").agg(((F.min("ms") - DAY - ids.EPOCH_MS) * (1 << ids.TIME_SHIFT)).alias("channel"))


def rows_of(spark: SparkSession, values: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(values, ddl)


# Scans

LOW, HIGH = (1705000000000 - ids.EPOCH_MS) << 22, (1706000000000 - ids.EPOCH_MS) << 22


@query(f"WITH {M} SELECT channel_id, id_num FROM m WHERE id_num >= {LOW} AND id_num < {HIGH}")
def window_scan(spark, d):
    return messages(spark, d).where(windows.in_window(F.col("id_num"), LOW, HIGH)).select("channel_id", "id_num")


@query(f"WITH {M} SELECT id_num, channel_id FROM m WHERE id_num < {HIGH} ORDER BY id_num DESC LIMIT 100")
def page_before(spark, d):
    return windows.page_before(messages(spark, d), HIGH).select("id_num", "channel_id")


SEGMENTS = """segments AS (
    SELECT channel_id, user_id % 2 AS index, min(id_num) AS after, user_id % 2 = 0 AS after_inclusive, max(id_num) + 1 AS before, CASE WHEN count(*) % 2 = 0 THEN max(id_num) END AS cursor
    FROM m GROUP BY channel_id, user_id % 2
), span AS (SELECT channel_id, min(after) AS after, max(coalesce(cursor, before)) AS before, arg_min(after_inclusive, after) AS after_inclusive FROM segments GROUP BY channel_id)"""


def _segments(spark, d):
    """Two pending windows a channel; those of an even number of messages are fetched down to their last one."""
    g = messages(spark, d).groupBy("channel_id", (F.col("user_id") % 2).alias("index")).agg(F.min("id_num").alias("after"), (F.max("id_num") + 1).alias("before"), F.when(F.count("*") % 2 == 0, F.max("id_num")).alias("cursor"))
    return g.withColumn("after_inclusive", F.col("index") == 0)


@query(f"WITH {M}, {SEGMENTS} SELECT channel_id, after, before, after_inclusive FROM span")
def sweep_span(spark, d):
    return windows.sweep_span(_segments(spark, d), "channel_id")


@query(f"WITH {M}, {SEGMENTS} SELECT m.channel_id, m.seq FROM m JOIN span USING (channel_id) WHERE id_num < before AND (CASE WHEN after_inclusive THEN id_num >= after ELSE id_num > after END)")
def sweep_window(spark, d):
    span = windows.sweep_span(_segments(spark, d), "channel_id")
    rows = messages(spark, d).join(span, "channel_id")
    return rows.where(windows.in_window(rows.id_num, span.after, span.before, span.after_inclusive)).select("channel_id", "seq")


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, part, row_seq, id_num FROM archive")
def archive_scan(spark, d):
    return archive(spark, d).select("channel_id", "part", "row_seq", "id_num").orderBy("channel_id", "part", "row_seq")


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, id_num, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY id_num) AS INTEGER) AS position FROM archive")
def load_sorted(spark, d):
    rows = dedup.numbered(archive(spark, d), "position").withColumn("position", (F.col("position") + 1).cast("int"))
    return rows.select("channel_id", "id_num", "position").orderBy("channel_id", "id_num")


PROGRESS = f"""progress AS (
    SELECT channel_id, count(*) AS total, max(ms) AS updated_ms, CAST(max(id_num) AS VARCHAR) AS newest,
           CASE WHEN count(*) % 3 = 0 THEN 'extracting' ELSE 'done' END AS status
    FROM m GROUP BY channel_id
)"""


def _progress(spark, d):
    g = messages(spark, d).groupBy("channel_id").agg(F.count("*").alias("total"), F.max("ms").alias("updated_ms"), F.max("id_num").cast("string").alias("newest"))
    return g.withColumn("status", F.when(F.col("total") % 3 == 0, "extracting").otherwise("done"))


@query(f"WITH {M}, {PROGRESS} SELECT * FROM progress ORDER BY updated_ms DESC")
def progress_scan(spark, d):
    return _progress(spark, d).orderBy(F.desc("updated_ms"))


@query("WITH landed AS (SELECT conv_id, count(*) AS turns, conv_id % 20 AS guild, conv_id % 7 AS type FROM conversations GROUP BY conv_id) SELECT guild, count(*) AS channels, sum(turns)::BIGINT AS turns FROM landed WHERE type IN (0, 5, 15) GROUP BY guild")
def list_channels(spark, d):
    landed = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    landed = landed.withColumns({"guild": F.col("conv_id") % 20, "type": F.col("conv_id") % 7})
    return landed.where(F.col("type").isin(0, 5, 15)).groupBy("guild").agg(F.count("*").alias("channels"), F.sum("turns").alias("turns"))


# Sinks


@query(f"WITH {M}, {ARCHIVE}, {INCOMING} SELECT DISTINCT channel_id, id_num FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM archive a WHERE a.channel_id = i.channel_id AND a.id_num = i.id_num)")
def append_new(spark, d):
    batch = dedup.first_of_each(incoming(spark, d), ["channel_id", "id"], "seq")
    return dedup.new_rows(batch, dedup.guard_ids(archive(spark, d))).select("channel_id", "id_num")


def _tails(a: DataFrame) -> DataFrame:
    sizes = a.groupBy("channel_id", "part").agg(F.count("*").alias("n"))
    return sizes.groupBy("channel_id").agg(F.max("part").alias("part"), F.max_by("n", "part").alias("rows"))


PARTS_SQL = f"""WITH {M}, {ARCHIVE}, {INCOMING}, fresh AS (
    SELECT DISTINCT channel_id, id_num FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM archive a WHERE a.channel_id = i.channel_id AND a.id_num = i.id_num)
), tails AS (
    SELECT channel_id, max(part) AS part, arg_max(n, part) AS n FROM (SELECT channel_id, part, count(*) AS n FROM archive GROUP BY channel_id, part) GROUP BY channel_id
)
SELECT f.channel_id, f.id_num,
       CAST(coalesce(t.part, 1) + (coalesce(t.n, 0) + row_number() OVER w - 1) // {CHUNK} AS INTEGER) AS part,
       CAST((coalesce(t.n, 0) + row_number() OVER w - 1) % {CHUNK} AS INTEGER) AS row_seq
FROM fresh f LEFT JOIN tails t USING (channel_id) WINDOW w AS (PARTITION BY f.channel_id ORDER BY f.id_num)"""


@query(PARTS_SQL)
def part_assign(spark, d):
    old = archive(spark, d)
    fresh = dedup.new_rows(dedup.first_of_each(incoming(spark, d), ["channel_id", "id"], "seq"), dedup.guard_ids(old))
    return dedup.deal_parts(fresh, _tails(old), CHUNK).select("channel_id", "id_num", "part", "row_seq")


@query(f"""WITH {M} SELECT '{{"id":"' || id_num || '","channel_id":"' || channel_id || '","content":' || to_json(props)::VARCHAR || '}}' AS value FROM m""")
def export_jsonl(spark, d):
    return messages(spark, d).select(F.to_json(F.struct("id", "channel_id", F.col("props").alias("content"))).alias("value"))


@query(f"WITH {M}, {INCOMING} SELECT channel_id, count(*) AS lines, count(DISTINCT id_num) AS ids FROM incoming GROUP BY channel_id")
def jsonl_log(spark, d):
    """The running log holds every processed row, also those that the archive then skips."""
    return incoming(spark, d).groupBy("channel_id").agg(F.count("*").alias("lines"), F.countDistinct("id").alias("ids"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'out-' || doc_id || '.jsonl' WHEN 1 THEN 'out.jsonl' WHEN 2 THEN 'x/' || doc_id || '/y.json' WHEN 3 THEN 'folder/' || doc_id || '.jsonl' ELSE 'a.b/c/' || doc_id || '.jsonl' END AS path FROM documents""")
def jsonl_path(spark, d):
    k = F.col("doc_id") % 5
    template = F.when(k < 2, "out.jsonl").when(k == 2, "x/{channel}/y.json").when(k == 3, "folder").otherwise("a.b/c")
    return table(spark, d, "documents").select("doc_id", text.output_path_col(template, F.col("doc_id").cast("string"), k == 1).alias("path"))


# Projections


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Raw messages made of pages and conversations: attachments from a page's links, authors and replies from the turn before."""
    p = table(spark, d, "pages")
    url = F.split("url", "[?#]").getItem(0)
    kind = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/html")
    attachment = lambda k: F.struct(F.concat("page_id", F.lit(f"-{k}")).alias("id"), F.concat(F.lit(f"f{k}"), F.lit(".bin")).alias("filename"), F.concat(url, F.lit(f"/{k}")).alias("url"), F.concat(F.lit("p:"), url).alias("proxy_url"), kind.alias("content_type"), F.lit(k).alias("width"), F.lit(None).cast("int").alias("height"), F.lit(1).cast("bigint").alias("size"))
    image = lambda x, on: F.when(on, F.struct(x.alias("url"), F.lit(None).cast("string").alias("proxy_url"), F.lit(1).alias("width"), F.lit(1).alias("height")))
    embed = F.struct(image(F.concat(url, F.lit("/i")), F.col("page_id") % 2 == 0).alias("image"), image(F.concat(url, F.lit("/t")), F.col("page_id") % 5 == 0).alias("thumbnail"))
    author = F.struct(F.concat(F.lit("u"), F.col("page_id") % 9).alias("id"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("name"), F.col("page_id") % 9)).otherwise("").alias("username"), F.when(F.col("page_id") % 5 != 0, F.lit("0001")).alias("discriminator"), (F.col("page_id") % 6 == 0).alias("bot"))
    reply = F.struct(F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise((F.col("page_id") - 1).cast("string")).alias("message_id"), F.lit(None).cast("string").alias("channel_id"), F.lit(None).cast("string").alias("guild_id"))
    replied = F.struct(F.struct(F.lit("r").alias("id"), F.when(F.col("page_id") % 8 == 0, F.lit("")).otherwise("reader").alias("username"), F.lit("0").alias("discriminator")).alias("author"), F.lit("x").alias("content"))
    return p.select(
        F.col("page_id").cast("string").alias("id"),
        F.when(F.col("page_id") % 10 != 0, F.col("url")).alias("content"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.concat(F.lit("c"), F.col("page_id") % 5).alias("channel_id"),
        F.when(F.col("page_id") % 11 == 0, F.lit("w")).otherwise("").alias("webhook_id"),
        author.alias("author"),
        F.when(F.col("page_id") % 2 == 0, reply).alias("message_reference"),
        F.when(F.col("page_id") % 3 == 0, replied).alias("referenced_message"),
        F.when(F.col("page_id") % 4 != 3, F.array(attachment(1), attachment(2))).alias("attachments"),
        F.when(F.col("page_id") % 6 != 5, F.array(embed)).alias("embeds"),
        F.when(F.col("page_id") % 13 == 0, F.struct(F.lit("t1").alias("id"), F.lit("n").alias("name"))).alias("thread"),
    )


RAW = """raw AS (
    SELECT page_id, CAST(page_id AS VARCHAR) AS id, regexp_split_to_array(url, '[?#]')[1] AS u, CASE WHEN page_id % 10 <> 0 THEN url ELSE '' END AS content,
           (CASE WHEN page_id % 4 <> 0 THEN 'name' || (page_id % 9) ELSE 'unknown' END) || '#' || (CASE WHEN page_id % 5 <> 0 THEN '0001' ELSE '0' END) || ' (u' || (page_id % 9) || ')' AS author,
           CASE WHEN page_id % 2 = 0 AND page_id % 7 <> 0 THEN CAST(page_id - 1 AS VARCHAR) END AS reply_to,
           CASE WHEN page_id % 3 = 0 AND page_id % 8 <> 0 THEN 'reader' END AS reply_to_author,
           CASE WHEN page_id % 13 = 0 THEN 't1' END AS thread_id,
           page_id % 4 <> 3 AS attached, page_id % 6 <> 5 AS embedded
    FROM pages
)"""
URLS = "CASE WHEN attached THEN u || '/1,' || u || '/2' ELSE '' END"
IMAGES = "concat_ws(',', CASE WHEN attached AND page_id % 3 = 0 THEN u || '/1,' || u || '/2' END, CASE WHEN embedded AND page_id % 2 = 0 THEN u || '/i' END, CASE WHEN embedded AND page_id % 5 = 0 THEN u || '/t' END)"
DETAILS = "CASE WHEN attached THEN concat_ws(',', 'f1.bin|' || coalesce(CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' END, '-') || '|1', 'f2.bin|' || coalesce(CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' END, '-') || '|2') ELSE '' END"


def _details(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda a: F.concat_ws("|", a.filename, F.coalesce(a.contentType, F.lit("-")), a.width.cast("string"))), ",")


@query(f"WITH {RAW} SELECT id, author, content, reply_to, reply_to_author, thread_id, CASE WHEN attached THEN 2 ELSE 0 END AS attachments, {URLS} AS urls, {IMAGES} AS images, {DETAILS} AS details FROM raw")
def q_normalize(spark, d):
    r = normalize.to_rows(raw_messages(spark, d))
    return r.select("id", "author", "content", F.col("replyTo").alias("reply_to"), F.col("replyToAuthor").alias("reply_to_author"), F.col("threadId").alias("thread_id"), "attachments", F.array_join("attachmentUrls", ",").alias("urls"), F.array_join("imageUrls", ",").alias("images"), _details(F.col("attachmentsDetailed")).alias("details"))


@query(f"WITH {RAW} SELECT id, author FROM raw")
def author_fmt(spark, d):
    return raw_messages(spark, d).select("id", normalize.author_label(F.col("author.username"), F.col("author.discriminator"), F.col("author.id")).alias("author"))


@query(f"WITH {RAW} SELECT id, {URLS} AS urls FROM raw")
def attach_urls(spark, d):
    return raw_messages(spark, d).select("id", F.array_join(normalize.attachment_urls(F.col("attachments")), ",").alias("urls"))


@query(f"WITH {RAW} SELECT id, {IMAGES} AS images FROM raw")
def image_urls(spark, d):
    return raw_messages(spark, d).select("id", F.array_join(normalize.image_urls(F.col("attachments"), F.col("embeds")), ",").alias("images"))


@query(f"WITH {RAW} SELECT id, {DETAILS} AS details FROM raw")
def attach_detail(spark, d):
    return raw_messages(spark, d).select("id", _details(normalize.attachment_details(F.col("attachments"))).alias("details"))


@query(f"WITH {RAW} SELECT id, CASE WHEN attached THEN 2 ELSE 0 END AS attachments FROM raw")
def attach_count(spark, d):
    return normalize.to_rows(raw_messages(spark, d)).select("id", "attachments")


@query(f"WITH {RAW} SELECT id, content, reply_to, reply_to_author, thread_id FROM raw")
def reply_fields(spark, d):
    return normalize.to_rows(raw_messages(spark, d)).select("id", "content", F.col("replyTo").alias("reply_to"), F.col("replyToAuthor").alias("reply_to_author"), F.col("threadId").alias("thread_id"))


@query(f"WITH {M} SELECT id_num, (id_num >> 22) + {ids.EPOCH_MS} AS back_ms FROM m")
def sf_to_ts(spark, d):
    return messages(spark, d).select("id_num", ids.to_ms(F.col("id_num")).alias("back_ms"))


@query(f"WITH {M} SELECT ms, (ms - {ids.EPOCH_MS}) * 4194304 AS first_id FROM m")
def ts_to_sf(spark, d):
    return messages(spark, d).select("ms", ids.from_ms(F.col("ms")).alias("first_id"))


@query("SELECT doc_id, (CASE WHEN n = '' THEN 'unknown' ELSE n END) || '-' || CASE WHEN doc_id * 37 < 1000000 THEN lpad(CAST(doc_id * 37 AS VARCHAR), 6, '0') ELSE CAST(doc_id * 37 AS VARCHAR) END || '.json' AS name FROM (SELECT doc_id, regexp_replace(source || '/' || lang || '.' || doc_id, '[^a-zA-Z0-9-_]', '_', 'g') AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)")
def q_chunk_name(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return rows.select("doc_id", text.chunk_name(F.concat("source", F.lit("/"), "lang", F.lit("."), "doc_id"), F.col("doc_id") * 37).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id * 1000 + 100000 ELSE -1 END AS part FROM documents")
def part_from_name(spark, d):
    digits = (F.col("doc_id") * 1000 + 100000).cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("chan-"), digits, F.lit(".json"))).when(F.col("doc_id") % 3 == 1, F.lit("chan-12.json")).otherwise(F.concat(digits, F.lit(".json")))
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.part_of_name(name), F.lit(-1)).alias("part"))


TRIM = "regexp_replace(regexp_replace(printf('%.2f', round({0}, 2)), '0+$', ''), '\\.$', '')"


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN {TRIM.format('n')} || ' B' WHEN n < 1048576 THEN {TRIM.format('n / 1024.0::DOUBLE')} || ' KB' WHEN n < 1073741824 THEN {TRIM.format('n / 1048576.0::DOUBLE')} || ' MB' ELSE {TRIM.format('n / 1073741824.0::DOUBLE')} || ' GB' END AS size
FROM (SELECT doc_id, CAST(n_chars * (CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1024 ELSE 333333 END) AS DOUBLE) AS n FROM documents)""")
def q_fmt_bytes(spark, d):
    n = F.col("n_chars") * F.when(F.col("doc_id") % 4 == 0, 0).when(F.col("doc_id") % 4 == 1, 1).when(F.col("doc_id") % 4 == 2, 1024).otherwise(333333)
    return table(spark, d, "documents").select("doc_id", text.fmt_bytes(n).alias("size"))


@query("""SELECT doc_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' ELSE (ms // 3600000) || 'h ' || (ms // 60000 % 60) || 'm' END AS took
FROM (SELECT doc_id, n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 300 ELSE 5000 END) AS ms FROM documents)""")
def q_fmt_duration(spark, d):
    ms = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 300).otherwise(5000)
    return table(spark, d, "documents").select("doc_id", text.fmt_duration(ms).alias("took"))


@query("SELECT doc_id, CASE WHEN n >= 1000000 THEN printf('%.1f', round(n / 1000000::DOUBLE, 1)) || 'M' WHEN n >= 1000 THEN printf('%.1f', round(n / 1000::DOUBLE, 1)) || 'K' ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT doc_id, n_chars * (CASE doc_id % 2 WHEN 0 THEN 1 ELSE 997 END) AS n FROM documents)")
def q_fmt_count(spark, d):
    n = F.col("n_chars") * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(997)
    return table(spark, d, "documents").select("doc_id", text.fmt_count(n).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 0.0::DOUBLE ELSE floor(n_chars::DOUBLE / (doc_id % 50) * 1000 * 100 + 0.5) / 100 END AS rate FROM documents")
def msg_rate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.rate(F.col("n_chars"), F.col("doc_id") % 50).alias("rate"))


@query("SELECT doc_id, CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 17) || '...' END AS short FROM documents")
def q_ellipsis(spark, d):
    return table(spark, d, "documents").select("doc_id", text.ellipsis(F.col("text"), 20).alias("short"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END, 'none') AS k FROM events")
def json_safe(spark, d):
    broken = F.when(F.col("event_id") % 4 == 0, F.lit("{not json")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", text.json_or(broken, "$.k", "none").alias("k"))


#: Saved states by the remainder of a conversation's number: none (0 to 2), all shards done, one partly fetched (version 2), a catch-up of this baseline and of another one, broken text, an unknown version.
WINDOW = """{"index":%d,"after":"%s","before":"%s","afterInclusive":false,"cursor":%s,"done":%s}"""
STATES = {
    3: """{"version":3,"parallelism":2,"updatedAt":"t","segments":[""" + WINDOW % (1, "900", "950", "null", "true") + "," + WINDOW % (0, "1", "900", "null", "true") + "]}",
    4: """{"version":2,"parallelism":2,"updatedAt":"t","segments":[""" + WINDOW % (0, "1", "900", '"500"', "false") + "," + WINDOW % (1, "900", "950", "null", "false") + "]}",
    5: """{"version":3,"parallelism":1,"segments":[{"index":0,"after":"@","before":"900","done":false}]}""",
    6: """{"version":3,"parallelism":1,"segments":[{"index":0,"after":"0@","before":"900","done":false}]}""",
    7: "{broken",
    8: """{"version":7,"parallelism":2,"updatedAt":"t","segments":[""" + WINDOW % (0, "1", "900", "null", "true") + "]}",
}
STATES_SQL = """states AS (SELECT conv_id, conv_id % 9 AS k, CAST(conv_id AS VARCHAR) AS baseline FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _states(spark, d):
    """A state and a baseline for each conversation."""
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("k", F.col("conv_id") % 9)
    saved = F.lit(None).cast("string")
    for k, state in STATES.items():
        saved = F.when(F.col("k") == k, F.replace(F.lit(state), F.lit("@"), F.col("conv_id").cast("string"))).otherwise(saved)
    c = c.withColumns({"baseline": F.when(F.col("k") != 2, F.col("conv_id").cast("string")), "saved": saved, "archive_complete": F.col("k").isin(0, 2, 4, 7)})
    return c.withColumn("state", decisions.parse_resume(F.col("saved")))


@query(f"WITH {STATES_SQL} SELECT conv_id, CASE k WHEN 3 THEN '2/2 shards done, 0 partial, 0 pending' WHEN 4 THEN '0/2 shards done, 1 partial, 1 pending' WHEN 5 THEN '0/1 shards done, 0 partial, 1 pending' WHEN 6 THEN '0/1 shards done, 0 partial, 1 pending' END AS summary FROM states")
def q_resume_summary(spark, d):
    return _states(spark, d).select("conv_id", decisions.resume_summary(F.col("state.segments")).alias("summary"))


@query(f"WITH {STATES_SQL} SELECT conv_id, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'unknown-state' WHEN 2 THEN 'no-baseline' WHEN 3 THEN 'ok' WHEN 4 THEN 'pending-shards' WHEN 5 THEN 'ok' WHEN 6 THEN 'pending-shards' WHEN 7 THEN 'ok' ELSE 'unknown-state' END AS reason, k IN (0, 3, 5, 7) AS use, k = 5 AS reuse FROM states")
def q_window_decision(spark, d):
    return _states(spark, d).select("conv_id", decisions.window_decision(F.col("baseline"), F.col("state"), F.col("archive_complete")).alias("x")).select("conv_id", "x.reason", "x.use", "x.reuse")


@query(f"""WITH {STATES_SQL} SELECT conv_id, CASE k WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS parallelism,
    CASE k WHEN 3 THEN 'true,true' WHEN 4 THEN 'false,false' ELSE 'false' END AS done, CASE k WHEN 3 THEN 'false,false' WHEN 4 THEN 'true,true' ELSE 'false' END AS inclusive FROM states WHERE k BETWEEN 3 AND 6""")
def resume_parse(spark, d):
    each = lambda f: F.array_join(F.transform("state.segments", lambda s: s[f].cast("string")), ",")
    return _states(spark, d).where("state IS NOT NULL").select("conv_id", "state.parallelism", each("done").alias("done"), each("afterInclusive").alias("inclusive"))


def _windows_text(state: Column) -> Column:
    return F.array_join(F.transform(state.segments, lambda s: F.concat_ws("|", s.index.cast("string"), s.after, s.before, F.coalesce(s.cursor, F.lit("-")), s.done.cast("string"))), ",")


@query(f"""WITH {STATES_SQL} SELECT conv_id, k IN (3, 4) AS reused, CASE k WHEN 3 THEN '0|1|900|-|true,1|900|950|-|true' WHEN 4 THEN '0|1|900|500|false,1|900|950|-|false'
    ELSE '0|' || baseline || '|' || (conv_id + 10) || '|-|false,1|' || (conv_id + 10) || '|' || (conv_id + 20) || '|-|false' END AS windows FROM (SELECT conv_id, k, CAST(conv_id AS VARCHAR) AS baseline FROM states)""")
def resolve_segments(spark, d):
    """Saved windows are resumed where their number is the one asked for, in order; else fresh ones are taken."""
    at = lambda n: (F.col("conv_id") + n).cast("string")
    fresh = F.array(*[F.struct(at(a).alias("after"), at(a + 10).alias("before"), F.lit(True).alias("afterInclusive")) for a in (0, 10)])
    state = decisions.resolve_segments(F.col("state"), F.lit(2), fresh, F.lit("t"))
    return _states(spark, d).select("conv_id", decisions.has_reusable_windows(F.col("state"), F.lit(2)).alias("reused"), state.alias("r")).select("conv_id", "reused", _windows_text(F.col("r")).alias("windows"))


@query(f"""WITH {STATES_SQL} SELECT conv_id, CASE k WHEN 3 THEN '1|900|950|-|true,0|1|900|77|true' WHEN 4 THEN '0|1|900|77|false,1|900|950|-|true' ELSE '0|' || (CASE k WHEN 6 THEN '0' ELSE '' END) || baseline || '|900|77|false,1|||-|true' END AS windows, CASE k WHEN 3 THEN 0 ELSE 1 END AS pending FROM states WHERE k BETWEEN 3 AND 6""")
def segment_cursors(spark, d):
    """A cursor is set in the first shard and the second is marked done; a shard that is missing is added."""
    state = decisions.mark_done(decisions.set_cursor(F.col("state"), 0, F.lit("77"), F.lit("t1")), 1, F.lit("t2"))
    rows = _states(spark, d).where("state IS NOT NULL").select("conv_id", state.alias("s"))
    return rows.select("conv_id", _windows_text(F.col("s")).alias("windows"), decisions.pending_count(F.col("s.segments")).alias("pending"))


def _short(x: str) -> str:
    return f"CASE WHEN {x} >= 1000000 THEN printf('%.1f', {x} / 1000000::DOUBLE) || 'M' WHEN {x} >= 1000 THEN printf('%.1f', {x} / 1000::DOUBLE) || 'K' ELSE CAST({x} AS VARCHAR) END"


@query(f"""WITH c AS (SELECT conv_id, conv_id % 4 AS k, count(*) * 100 AS low, count(*) * 100 + 5000 AS high FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN k = 1 THEN 'equal-time (no density estimate)' WHEN k = 2 THEN 'density (no density estimate)' WHEN k = 3 THEN 'density, 2 shards, ~' || ({_short("low")}) || '-' || ({_short("high")}) || ' msgs/shard, imbalance 12%, 21 probes' END AS line FROM c""")
def balance_summary(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") * 100).cast("double").alias("low")).withColumn("k", F.col("conv_id") % 4)
    low, high = F.col("low"), F.col("low") + 5000
    loads = F.when(F.col("k") == 3, F.array(low, high))
    balance = F.when(F.col("k") > 0, F.struct(F.when(F.col("k") == 1, "equal-time").otherwise("density").alias("strategy"), F.lit(0.12).alias("imbalance"), loads.alias("loads"), low.alias("minLoad"), high.alias("maxLoad"), F.lit(21).alias("probes"), F.lit("t").alias("measuredAt")))
    return c.withColumn("balance", balance).select("conv_id", decisions.describe_balance(F.col("balance")).alias("line"))


# Filters and look-ups


@query(f"WITH {M}, {ARCHIVE}, base AS (SELECT channel_id, max(id_num) AS b FROM archive GROUP BY channel_id) SELECT m.channel_id, m.id_num FROM m JOIN base USING (channel_id) WHERE m.id_num > b")
def catchup(spark, d):
    base = archive(spark, d).groupBy("channel_id").agg(F.max("id_num").alias("baseline"))
    return messages(spark, d).join(base, "channel_id").where(F.col("id_num") > F.col("baseline")).select("channel_id", "id_num")


@query(f"WITH {M} SELECT channel_id, id_num FROM m WHERE channel_id <> 'click' AND (channel_id <> 'view' OR id_num > {LOW})")
def live_floor(spark, d):
    from .streaming.live import above_floor

    targets = rows_of(spark, [(c, str(LOW) if c == "view" else "") for c in _other_channels(spark, d, "click")], "channel_id string, floor string")
    return above_floor(messages(spark, d), targets).select("channel_id", "id_num")


def _other_channels(spark, d, without):
    """Event types are a handful: the channels of one capture."""
    return sorted(r.channel_id for r in messages(spark, d).select("channel_id").distinct().collect() if r.channel_id != without)


@query("SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE page_id % 6 <> 0 AND page_id % 11 <> 0")
def exclude_bots(spark, d):
    from .streaming.live import not_automated

    return raw_messages(spark, d).where(not_automated()).select("id")


@query(f"WITH {M} SELECT channel_id, seq FROM m WHERE channel_id IN ('view', 'click')")
def live_targets(spark, d):
    targets = rows_of(spark, [("view",), ("click",)], "channel_id string")
    return messages(spark, d).join(F.broadcast(targets), "channel_id", "left_semi").select("channel_id", "seq")


@query(f"WITH {M} SELECT id_num, length(CAST(id_num // (CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 1000 END) AS VARCHAR)) BETWEEN 17 AND 19 AS valid FROM m")
def valid_ids(spark, d):
    cut = F.expr("cast(id_num div (case seq % 3 when 0 then 1 when 1 then 10 else 1000 end) as string)")
    return messages(spark, d).select("id_num", ids.valid_id(cut).alias("valid"))


@query("SELECT conv_id AS channel_id, count(*) AS turns FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def enabled_channels(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("channel_id")).agg(F.count("*").alias("turns")).withColumn("enabled", F.col("channel_id") % 3 != 0)
    return c.where("enabled").drop("enabled")


@query(f"WITH {M} SELECT channel_id, CASE channel_id WHEN 'view' THEN 'Views' WHEN 'click' THEN 'Clicks' ELSE channel_id END AS name, CASE WHEN channel_id IN ('view', 'click') THEN 'g1' ELSE '' END AS guild, count(*) AS n FROM m GROUP BY channel_id")
def channel_names(spark, d):
    names = rows_of(spark, [("view", "Views", "g1"), ("click", "Clicks", "g1")], "channel_id string, name string, guild string")
    c = messages(spark, d).groupBy("channel_id").agg(F.count("*").alias("n")).join(names, "channel_id", "left")
    return c.select("channel_id", F.coalesce("name", "channel_id").alias("name"), F.coalesce("guild", F.lit("")).alias("guild"), "n")


def _conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct()


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'live' WHEN conv_id % 3 = 0 THEN 'in-progress' WHEN conv_id % 5 > 1 OR conv_id % 7 = 0 THEN 'due' ELSE 'no-baseline' END AS plan FROM (SELECT DISTINCT conv_id FROM conversations)")
def q_catchup_plan(spark, d):
    c = F.col("conv_id")
    status = F.when(c % 3 == 0, "extracting").when(c % 3 == 1, "done").otherwise("error")
    newest = F.when(c % 5 == 1, "").when(c % 5 > 1, c.cast("string"))
    return _conversations(spark, d).select(c, decisions.catchup_plan(c % 4 == 0, status, newest, c % 7 == 0).alias("plan"))


@query("SELECT conv_id, (conv_id & 63) = 0 AS auto FROM (SELECT DISTINCT conv_id FROM conversations)")
def q_auto_incremental(spark, d):
    c, on = F.col("conv_id"), lambda bit: F.col("conv_id").bitwiseAND(F.lit(bit)) > 0
    return _conversations(spark, d).select(c, decisions.auto_incremental(on(1), on(2), ~on(4), F.when(on(8), "error").otherwise("done"), F.when(~on(16), F.lit("t")), F.when(on(32), "").otherwise("1")).alias("auto"))


@query("SELECT conv_id, CASE WHEN conv_id % 5 <> 0 AND conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'done' ELSE 'error' END AS status FROM (SELECT DISTINCT conv_id FROM conversations)")
def q_final_status(spark, d):
    c = F.col("conv_id")
    return _conversations(spark, d).select(c, decisions.final_status(c % 5 == 0, c % 3, c % 2 == 0).alias("status"))


@query("""SELECT page_id, code, CASE WHEN code = 429 THEN 'rate_limit' WHEN code IN (401, 403) THEN 'auth' WHEN code = 404 THEN 'not_found' WHEN code IN (408, 425) OR code >= 500 THEN 'server' WHEN code >= 400 THEN 'client' ELSE 'unknown' END AS kind,
    code IN (408, 425, 429) OR code >= 500 AS retryable FROM (SELECT page_id, 200 + page_id * 7 % 400 AS code FROM pages)""")
def q_classify_status(spark, d):
    pages = table(spark, d, "pages").select("page_id", (200 + F.col("page_id") * 7 % 400).alias("code"))
    return pages.select("page_id", "code", decisions.classify_status(F.col("code")).alias("x")).select("page_id", "code", "x.*")


@query(f"""WITH {M}, {ARCHIVE}, {PROGRESS}, totals AS (SELECT channel_id, count(*) AS archived, max(part) AS parts, min(id_num) AS first_id FROM archive GROUP BY channel_id)
SELECT p.channel_id, p.status, p.total, t.archived, t.parts, t.first_id FROM progress p LEFT JOIN totals t USING (channel_id)""")
def status_report(spark, d):
    totals = archive(spark, d).groupBy("channel_id").agg(F.count("*").alias("archived"), F.max("part").alias("parts"), F.min("id_num").alias("first_id"))
    return progress.report(_progress(spark, d), totals).select("channel_id", "status", "total", "archived", "parts", "first_id")


# Aggregates


@query(f"WITH {M}, {ARCHIVE}, {INCOMING}, o AS (SELECT channel_id, max(id_num) b FROM archive GROUP BY channel_id), n AS (SELECT channel_id, max(id_num) b FROM incoming GROUP BY channel_id) SELECT channel_id, greatest(o.b, n.b) AS baseline FROM o FULL JOIN n USING (channel_id)")
def baseline(spark, d):
    top = lambda df, name: df.groupBy("channel_id").agg(F.max("id_num").alias(name))
    return top(archive(spark, d), "old").join(top(incoming(spark, d), "new"), "channel_id", "full").select("channel_id", F.greatest("old", "new").alias("baseline"))


@query(f"WITH {M} SELECT channel_id, arg_max(id_num, seq) AS last_id FROM m GROUP BY channel_id")
def last_id(spark, d):
    return messages(spark, d).groupBy("channel_id").agg(F.max_by("id_num", "seq").alias("last_id"))


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, count(*) AS messages, max(part) AS parts FROM archive GROUP BY channel_id")
def archive_totals(spark, d):
    return archive(spark, d).groupBy("channel_id").agg(F.count("*").alias("messages"), F.max("part").alias("parts"))


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, part, count(*) AS messages, CAST(arg_min(id_num, row_seq) AS VARCHAR) AS start_id, CAST(arg_max(id_num, row_seq) AS VARCHAR) AS end_id, min(id_num) AS min_id, max(id_num) AS max_id FROM archive GROUP BY channel_id, part")
def q_part_meta(spark, d):
    return dedup.part_meta(archive(spark, d), "channel_id")


@query(f"WITH {M}, {PROGRESS} SELECT sum(total)::BIGINT AS messages, count(*) FILTER (status <> 'done') AS failures, count(*) AS channels FROM progress")
def cycle_totals(spark, d):
    return _progress(spark, d).agg(F.sum("total").alias("messages"), F.count_if(F.col("status") != "done").alias("failures"), F.count("*").alias("channels"))


@query(f"WITH {M}, l AS (SELECT channel_id, user_id, count(*) AS n FROM m GROUP BY channel_id, user_id) SELECT channel_id, (max(n) - min(n)) / avg(n) AS imbalance FROM l GROUP BY channel_id")
def q_imbalance(spark, d):
    return messages(spark, d).groupBy("channel_id", "user_id").count().groupBy("channel_id").agg(shards.imbalance(F.col("count")).alias("imbalance"))


@query(f"WITH {M}, {ARCHIVE}, {INCOMING} SELECT channel_id, count(DISTINCT id_num) AS accepted FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM archive a WHERE a.channel_id = i.channel_id AND a.id_num = i.id_num) GROUP BY channel_id")
def live_counts(spark, d):
    return append_new(spark, d).groupBy("channel_id").agg(F.count("*").alias("accepted"))


@query(f"WITH {M}, {ARCHIVE}, t AS (SELECT channel_id, count(*) AS n, max(part) AS parts FROM archive GROUP BY channel_id) SELECT channel_id, least(n, {2 * CHUNK}) AS ids, n AS archived, parts, least(n, {2 * CHUNK}) * 56 AS bytes, least(n, {2 * CHUNK}) <= 900 AS affordable FROM t")
def dedup_cost(spark, d):
    t = archive(spark, d).groupBy("channel_id").agg(F.count("*").alias("n"), F.max("part").alias("p"))
    return t.select("channel_id", *[c.alias(k) for k, c in dedup.cost(F.col("n"), F.col("p"), False, 2, CHUNK, 900).items()])


# Windows, order, limits, sets

PROBES = f"probes AS (SELECT channel_id, k, start + (span * k) // 13 AS t FROM (SELECT channel_id, (channel >> 22) + {ids.EPOCH_MS} AS start, {NOW} - ((channel >> 22) + {ids.EPOCH_MS}) AS span FROM channels), range(1, 13) r(k))"
RATES = f"""rates AS (
    SELECT p.channel_id, p.k, p.t, CASE WHEN count(x.ms) = 0 THEN 0.0::DOUBLE ELSE count(x.ms) / greatest(1, CASE WHEN p.t > min(x.ms) THEN p.t - min(x.ms) ELSE 1000 END)::DOUBLE END AS rate, count(x.ms) AS samples
    FROM probes p LEFT JOIN LATERAL (SELECT ms FROM m WHERE m.channel_id = p.channel_id AND m.ms < p.t ORDER BY ms DESC LIMIT 100) x ON true
    GROUP BY p.channel_id, p.k, p.t
)"""


def _rates(spark, d):
    c = channels(spark, d)
    times = shards.probe_times(c, NOW, 12)
    return shards.local_rates(times, messages(spark, d), "channel_id"), c


@query(f"WITH {M}, {CHANNELS}, {PROBES}, {RATES} SELECT channel_id, CAST(k AS INTEGER) AS k, t, rate, samples FROM rates")
def density_probe(spark, d):
    return _rates(spark, d)[0]


CURVE = f"""points AS (
    SELECT channel_id, t, rate FROM rates UNION ALL SELECT c.channel_id, (c.channel >> 22) + {ids.EPOCH_MS}, r.rate FROM channels c JOIN rates r ON r.channel_id = c.channel_id AND r.k = 1
), curve AS (SELECT channel_id, t, lead(t, 1, {NOW + 60000}) OVER (PARTITION BY channel_id ORDER BY t) AS next_t, rate FROM points)"""


def _curve_inputs(spark, d):
    rates, c = _rates(spark, d)
    return rates.join(c, "channel_id").select("channel", "channel_id", "t", "rate", F.col("k").alias("seq")), c


@query(f"WITH {M}, {CHANNELS}, {PROBES}, {RATES}, {CURVE} SELECT channel_id, sum(rate * greatest(0, least(next_t, {FROM}) - greatest(t, {FROM - 5 * DAY}))) AS mass FROM curve GROUP BY channel_id")
def q_mass_between(spark, d):
    probes, c = _curve_inputs(spark, d)
    curve = shards.density_curve(probes, NOW).join(c, "channel")
    return shards.mass_between(curve, F.lit(FROM - 5 * DAY), F.lit(FROM), "channel_id")


DENSE = f"""{M}, {CHANNELS}, {PROBES}, {RATES}, {CURVE}, cum AS (
    SELECT *, sum(m) OVER (PARTITION BY channel_id ORDER BY t) AS cum, sum(m) OVER (PARTITION BY channel_id) AS total FROM (SELECT *, rate * (next_t - t) AS m FROM curve) WHERE m > 0
), cuts AS (
    SELECT channel_id, k, arg_min(floor(t + least(1.0, greatest(0.0, share - (cum - m)) / m) * (next_t - t) + 0.5), t)::BIGINT AS cut
    FROM (SELECT *, total / 4 * k AS share FROM cum, range(1, 4) r(k)) WHERE cum >= share GROUP BY channel_id, k
), bounds AS (
    SELECT channel_id, channel, list_concat([(channel >> 22) + {ids.EPOCH_MS}], (SELECT list(cut ORDER BY k) FROM cuts WHERE cuts.channel_id = channels.channel_id), [{NOW + 60000}]) AS b FROM channels
), shards AS (
    SELECT channel_id, CAST(s AS INTEGER) AS shard, CASE WHEN s = 0 THEN channel ELSE (b[s + 1] - {ids.EPOCH_MS}) * 4194304 END AS after, (b[s + 2] - {ids.EPOCH_MS}) * 4194304 AS before FROM bounds, range(0, 4) r(s)
)"""


def _dense(spark, d):
    probes, c = _curve_inputs(spark, d)
    return shards.density_shards(c, probes, NOW, 4).join(c, "channel").select("channel_id", "strategy", "shard", "after", "before")


@query(f"WITH {DENSE} SELECT channel_id, 'density' AS strategy, shard, after, before FROM shards")
def q_density_shards(spark, d):
    return _dense(spark, d)


@query(f"WITH {DENSE} SELECT s.channel_id, s.shard, count(*) AS messages FROM m JOIN shards s ON m.channel_id = s.channel_id AND m.id_num >= s.after AND m.id_num < s.before GROUP BY s.channel_id, s.shard")
def assign_shard(spark, d):
    return shards.assign(messages(spark, d), _dense(spark, d), "channel_id").groupBy("channel_id", "shard").agg(F.count("*").alias("messages"))


@query(f"WITH {DENSE} SELECT channel_id, count(*) AS shards, 0::BIGINT AS gaps, 0::BIGINT AS overlaps FROM shards GROUP BY channel_id")
def shard_contiguity(spark, d):
    return shards.contiguity(_dense(spark, d), "channel_id")


@query(f"WITH {DENSE}, inside AS (SELECT m.seq FROM m JOIN shards s ON m.channel_id = s.channel_id AND m.id_num >= s.after AND m.id_num < s.before) SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM inside) AS placed, (SELECT count(DISTINCT seq) FROM inside) AS once")
def coverage(spark, d):
    placed = shards.assign(messages(spark, d), _dense(spark, d), "channel_id").agg(F.count("*").alias("placed"), F.countDistinct("seq").alias("once"))
    return messages(spark, d).agg(F.count("*").alias("messages")).join(F.broadcast(placed))  # one row each


@query(f"""WITH {M}, {CHANNELS}, s AS (SELECT channel_id, channel, (channel >> 22) + {ids.EPOCH_MS} AS start, {NOW} - ((channel >> 22) + {ids.EPOCH_MS}) AS span FROM channels)
SELECT channel_id, CAST(i AS INTEGER) AS shard, (start + i * (span // 6) - {ids.EPOCH_MS}) * 4194304 AS after, CASE WHEN i = 5 THEN ({NOW + 60000} - {ids.EPOCH_MS}) * 4194304 ELSE (start + (i + 1) * (span // 6) - {ids.EPOCH_MS}) * 4194304 END AS before FROM s, range(0, 6) r(i)""")
def q_equal_shards(spark, d):
    return shards.equal_shards(channels(spark, d), NOW, 6).select("channel_id", "shard", "after", "before")


@query("""SELECT doc_id, CAST(CASE WHEN o > 0 THEN greatest(1, least(floor(o + 0.5), 36)) ELSE least(greatest(4, 3 * p), 36) END AS INTEGER) AS probes
    FROM (SELECT doc_id, doc_id % 14 AS p, CASE WHEN doc_id % 4 > 0 THEN doc_id % 83 * 0.5::DOUBLE END AS o FROM documents)""")
def q_probe_count(spark, d):
    override = F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 83 * 0.5)
    return table(spark, d, "documents").select("doc_id", shards.probe_count((F.col("doc_id") % 14).cast("int"), override).alias("probes"))


@query(f"""WITH {M}, b AS (SELECT user_id AS batch, seq, CASE WHEN user_id % 3 = 0 AND seq % 40 = 0 THEN 'x' || seq ELSE CAST(seq * 7919 % 100003 AS VARCHAR) END AS id FROM m),
    o AS (SELECT *, bool_or(id LIKE 'x%') OVER (PARTITION BY batch) AS odd FROM b)
    SELECT batch, seq, CAST(row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN NOT odd THEN CAST(id AS BIGINT) END, CASE WHEN odd THEN id END, seq) AS INTEGER) AS position FROM o""".replace("CAST(id AS BIGINT)", "TRY_CAST(id AS BIGINT)"))
def sort_ids(spark, d):
    """Ids of a batch in numeric order, but as text where one of them is no number."""
    rows = messages(spark, d).select(F.col("user_id").alias("batch"), "seq", F.when((F.col("user_id") % 3 == 0) & (F.col("seq") % 40 == 0), F.concat(F.lit("x"), "seq")).otherwise((F.col("seq") * 7919 % 100003).cast("string")).alias("id"))
    return ids.order_position(rows, ["batch"], "seq").select("batch", "seq", "position")


@query(f"WITH {M} SELECT user_id AS session_id, max(ms) AS started_ms, count(*) AS n FROM m GROUP BY user_id ORDER BY started_ms DESC, session_id LIMIT 10")
def top_sessions(spark, d):
    return messages(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ms").alias("started_ms"), F.count("*").alias("n")).orderBy(F.desc("started_ms"), "session_id").limit(10)


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, CAST(id_num AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY part DESC, row_seq DESC) AS k FROM archive) WHERE k <= 700")
def dedup_ceiling(spark, d):
    return dedup.guard_ids(archive(spark, d), max_ids=700)


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, CAST(id_num AS VARCHAR) AS id FROM (SELECT *, dense_rank() OVER (PARTITION BY channel_id ORDER BY part DESC) AS k FROM archive) WHERE k <= 2")
def dedup_windowed(spark, d):
    return dedup.guard_ids(archive(spark, d), "windowed", 2)


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, CAST(id_num AS VARCHAR) AS id FROM archive")
def dedup_exact(spark, d):
    return dedup.guard_ids(archive(spark, d))


@query(f"WITH {M}, {ARCHIVE}, {INCOMING} SELECT channel_id, count(*) AS rows, count(DISTINCT id_num) AS ids FROM (SELECT channel_id, id_num FROM archive UNION ALL SELECT channel_id, id_num FROM incoming) GROUP BY channel_id")
def merge_sources(spark, d):
    both = archive(spark, d).select("channel_id", "id_num").unionByName(incoming(spark, d).select("channel_id", "id_num"))
    return both.groupBy("channel_id").agg(F.count("*").alias("rows"), F.countDistinct("id_num").alias("ids"))


@query(f"WITH {M}, {INCOMING} SELECT channel_id, CAST(id_num AS VARCHAR) AS id, min(seq) AS seq FROM incoming GROUP BY channel_id, id_num")
def run_dedup(spark, d):
    return dedup.first_of_each(incoming(spark, d).select("channel_id", "id", "seq"), ["channel_id", "id"], "seq").select("channel_id", "id", "seq")


@query(f"WITH {M}, {INCOMING} SELECT channel_id, count(DISTINCT id_num) AS kept FROM incoming GROUP BY channel_id")
def live_dedup(spark, d):
    return dedup.first_of_each(incoming(spark, d).select("channel_id", "id", "seq"), ["channel_id", "id"], "seq").groupBy("channel_id").agg(F.count("*").alias("kept"))


@query(f"WITH {M} SELECT channel_id, count(*) AS n, min(id_num) AS least FROM m WHERE id_num > {LOW} GROUP BY channel_id")
def live_late(spark, d):
    """Late rows count like any other: only what lies at or below the floor is dropped."""
    from .streaming.live import above_floor

    floors = messages(spark, d).select("channel_id").distinct().withColumn("floor", F.lit(str(LOW)))
    return above_floor(messages(spark, d), floors).groupBy("channel_id").agg(F.count("*").alias("n"), F.min("id_num").alias("least"))


@query(f"WITH {M}, i AS (SELECT channel_id, ms // {DAY} AS day, min(id_num) AS after, max(id_num) + 1 AS before FROM m WHERE ms // {DAY} % 5 <> 0 GROUP BY channel_id, ms // {DAY}), r AS (SELECT *, max(before) OVER (PARTITION BY channel_id ORDER BY after, before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i) SELECT channel_id, reached AS after, after AS before FROM r WHERE after > reached")
def q_coverage_gaps(spark, d):
    day = F.expr(f"ms div {DAY}")
    i = messages(spark, d).where(day % 5 != 0).groupBy("channel_id", day.alias("day")).agg(F.min("id_num").alias("after"), (F.max("id_num") + 1).alias("before"))
    return windows.coverage_gaps(i)


@query(f"WITH {M} SELECT user_id, arg_max(channel_id, seq) AS channel_id, max(seq) AS seq FROM m GROUP BY user_id")
def upsert_latest(spark, d):
    return progress.latest(messages(spark, d).select("user_id", "channel_id", "seq"), ["user_id"], "seq")


@query(f"""WITH {M}, u AS (SELECT user_id, count(*) AS n, max(seq) AS last FROM m GROUP BY user_id),
    old AS (SELECT CAST(user_id AS VARCHAR) AS channel_id, CASE user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'done' ELSE 'error' END AS status, CASE WHEN user_id % 4 > 0 THEN 't0' END AS started_at, CASE WHEN user_id % 4 > 1 THEN 't0' END AS completed_at, n AS total_extracted, 't0' AS updated_at FROM u WHERE user_id % 3 <> 0),
    new AS (SELECT CAST(user_id AS VARCHAR) AS channel_id, CASE user_id % 5 WHEN 0 THEN 'extracting' WHEN 1 THEN 'done' WHEN 2 THEN 'error' END AS s, CASE WHEN user_id % 7 > 0 THEN last END AS t FROM u WHERE user_id % 2 = 0)
    SELECT coalesce(o.channel_id, n.channel_id) AS channel_id, coalesce(s, status, 'pending') AS status, CASE WHEN s = 'extracting' THEN coalesce(started_at, 't1') ELSE started_at END AS started_at,
           CASE WHEN s IN ('done', 'error') THEN 't1' ELSE completed_at END AS completed_at, coalesce(t, total_extracted, 0) AS total_extracted, CASE WHEN n.channel_id IS NOT NULL THEN 't1' ELSE updated_at END AS updated_at
    FROM old o FULL JOIN new n ON o.channel_id = n.channel_id""")
def progress_update(spark, d):
    u = messages(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    k, name = F.col("user_id"), F.col("user_id").cast("string").alias("channel_id")
    old = u.where(k % 3 != 0).select(name, F.when(k % 4 == 0, "pending").when(k % 4 == 1, "extracting").when(k % 4 == 2, "done").otherwise("error").alias("status"), F.when(k % 4 > 0, F.lit("t0")).alias("started_at"), F.when(k % 4 > 1, F.lit("t0")).alias("completed_at"), F.col("n").alias("total_extracted"), F.lit("t0").alias("updated_at"))
    new = u.where(k % 2 == 0).select(name, F.when(k % 5 == 0, "extracting").when(k % 5 == 1, "done").when(k % 5 == 2, "error").alias("status"), F.when(k % 7 > 0, F.col("last")).alias("total_extracted"))
    return progress.update(old, new, F.lit("t1"))


@query(f"WITH {M}, c AS (SELECT user_id AS channel_id, count(*) AS n, max(seq) AS last FROM m GROUP BY user_id) SELECT channel_id, CASE WHEN channel_id % 3 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN channel_id % 3 = 0 THEN last ELSE n END AS mark FROM c WHERE channel_id % 2 = 0 OR channel_id % 3 = 0")
def channel_upsert(spark, d):
    """Channels of even numbers, and then those that 3 divides in place of what was there."""
    c = messages(spark, d).groupBy(F.col("user_id").alias("channel_id")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    old = c.where("channel_id % 2 = 0").select("channel_id", F.lit("old").alias("name"), F.col("n").alias("mark"))
    return progress.upsert(old, c.where("channel_id % 3 = 0").select("channel_id", F.lit("new").alias("name"), F.col("last").alias("mark")), ["channel_id"])


# Archives on disk, streams, views


def _on_disk(spark, d):
    from .sources.archive import Archive, scratch

    a = Archive(spark, scratch(spark), chunk=CHUNK)
    rows = messages(spark, d).select("channel_id", "id", F.col("props").alias("content"))
    a.append(rows.join(archive(spark, d).select("channel_id", "id"), ["channel_id", "id"], "left_semi"))
    a.append(incoming(spark, d).select("channel_id", "id", F.col("props").alias("content")))
    return a


@query(f"WITH {M} SELECT channel_id, count(*) AS messages, CAST(ceil(count(*) / {CHUNK}.0) AS INTEGER) AS parts, true AS distinct_ids FROM m WHERE ms < {CUT} OR ms >= {FROM} GROUP BY channel_id")
def storage_stats(spark, d):
    """Two appends that overlap, on disk: every id once, parts filled one after the other."""
    a = _on_disk(spark, d)
    ids_ = a.read().groupBy("channel_id").agg((F.count("*") == F.countDistinct("id")).alias("distinct_ids"))
    return a.totals().select("channel_id", "messages", "parts").join(ids_, "channel_id")


ON_DISK = f"""whole AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id_num) AS rn FROM m WHERE ms < {CUT} OR ms >= {FROM}),
stored AS (SELECT channel_id, CAST(id_num AS VARCHAR) AS id, id_num, props AS content, CAST((rn - 1) // {CHUNK} + 1 AS INTEGER) AS part, CAST((rn - 1) % {CHUNK} AS INTEGER) AS row_seq FROM whole)"""


@query(f"WITH {M}, {ON_DISK}, p AS (SELECT channel_id, part, count(*) AS messages, min(id_num) AS min_id, max(id_num) AS max_id FROM stored GROUP BY channel_id, part) SELECT channel_id, part, messages, min_id, max_id, messages < {CHUNK} AND part = max(part) OVER (PARTITION BY channel_id) AS open FROM p")
def rebuild_manifest(spark, d):
    """The manifest is lost; the next read makes it again from the files, the last part still open."""
    a = _on_disk(spark, d)
    a.forget_manifest()
    return a.meta().groupBy("channel_id", "part").agg(F.sum("messages").alias("messages"), F.min("min_id").cast("bigint").alias("min_id"), F.max("max_id").cast("bigint").alias("max_id"), F.bool_or("open").alias("open"))


@query(f"WITH {M}, {ON_DISK} SELECT channel_id, part, row_seq, id, content FROM stored")
def compact(spark, d):
    a = _on_disk(spark, d)
    a.finalize()
    return a.read().select("channel_id", "part", "row_seq", "id", "content")


@query(f"WITH {M}, {ON_DISK} SELECT channel_id, part, row_seq, id FROM stored WHERE channel_id <> 'view'")
def reset(spark, d):
    a = _on_disk(spark, d)
    a.reset("view")
    return a.read().select("channel_id", "part", "row_seq", "id")


@query(f"WITH {M}, {ON_DISK} SELECT channel_id, part, row_seq, id FROM stored WHERE channel_id = 'view' AND id_num BETWEEN {LOW} AND {HIGH}")
def archive_range(spark, d):
    """One channel's ids between bounds: only the parts that can hold them are read."""
    return _on_disk(spark, d).read("view", LOW, HIGH).select("channel_id", "part", "row_seq", "id")


@query(f"WITH {M}, {ON_DISK} SELECT channel_id, count(*) AS messages, max(part) AS parts, channel_id = 'view' AS complete FROM stored GROUP BY channel_id")
def mark_complete(spark, d):
    a = _on_disk(spark, d)
    a.complete("view")
    return a.totals().select("channel_id", "messages", "parts", F.col("completed_at").isNotNull().alias("complete"))


@query(f"WITH {M}, {ON_DISK} SELECT id, content FROM stored")
def dump_json(spark, d):
    from .sources import jsonfiles

    a = _on_disk(spark, d)
    path = f"{a.root}/dump"
    jsonfiles.dump(a.read(), path)
    return jsonfiles.read_dump(spark, path).select("id", "content")


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, part, row_seq, CAST(id_num AS VARCHAR) AS id, props AS content FROM archive")
def read_sealed(spark, d):
    from .sources import jsonfiles
    from .sources.archive import scratch

    root = scratch(spark)
    jsonfiles.write_sealed(archive(spark, d).select("channel_id", "part", "row_seq", "id", F.col("props").alias("content")), root)
    return jsonfiles.read_parts(spark, root).where("layout = 'sealed'").select("channel_id", "part", "row_seq", "row.id", "row.content")


@query(f"WITH {M}, {ARCHIVE} SELECT channel_id, part, row_seq, CAST(id_num AS VARCHAR) AS id, props AS content FROM archive")
def read_open(spark, d):
    from .sources import jsonfiles
    from .sources.archive import scratch

    root = scratch(spark)
    jsonfiles.write_open(archive(spark, d).select("channel_id", "part", "row_seq", "id", F.col("props").alias("content")), root)
    return jsonfiles.read_parts(spark, root).where("layout = 'open'").select("channel_id", "part", "row_seq", "row.id", "row.content")


@query(f"WITH {RAW} SELECT 'c' || (page_id % 5) AS channel_id, id, {DETAILS} AS details, {IMAGES} AS images FROM raw")
def read_details(spark, d):
    """Attachments' details and addresses of images survive a sealed part."""
    from .sources import jsonfiles
    from .sources.archive import scratch

    root = scratch(spark)
    rows = normalize.to_rows(raw_messages(spark, d), "channel_id").withColumn("id_num", F.col("id").cast("decimal(20,0)"))
    none = spark.createDataFrame([], "channel_id string, part int, rows bigint")
    jsonfiles.write_sealed(dedup.deal_parts(rows, none, CHUNK), root)
    back = jsonfiles.read_parts(spark, root)
    return back.select("channel_id", "row.id", _details(F.coalesce("row.attachmentsDetailed", F.array().cast(back.schema["row"].dataType["attachmentsDetailed"].dataType))).alias("details"), F.array_join("row.imageUrls", ",").alias("images"))


@query(f"WITH {M} SELECT channel_id, count(DISTINCT id_num) AS captured FROM m WHERE channel_id <> 'click' AND (channel_id <> 'view' OR id_num > {LOW}) GROUP BY channel_id")
def live_capture(spark, d):
    """The events as a file stream into an archive on disk, restarted once over the same checkpoint."""
    from .sources.archive import Archive, scratch
    from .streaming.live import LiveCapture

    root = scratch(spark)
    a = Archive(spark, f"{root}/archive", chunk=CHUNK)
    targets = rows_of(spark, [(c, str(LOW) if c == "view" else "") for c in _other_channels(spark, d, "click")], "channel_id string, floor string")
    raw = messages(spark, d).select("id", F.col("props").alias("content"), F.lit(None).cast("string").alias("timestamp"), "channel_id", F.lit(None).cast("string").alias("webhook_id"), F.struct(F.col("user_id").cast("string").alias("id"), F.lit("u").alias("username"), F.lit("0").alias("discriminator"), F.lit(False).alias("bot")).alias("author"))
    for _ in range(2):
        raw.write.mode("append").json(f"{root}/landing")
        LiveCapture(a, targets).drain(f"{root}/landing", f"{root}/checkpoint")
    return a.totals().select("channel_id", F.col("messages").alias("captured"))


# What arbitrary SQL over the registered views reaches; the same text runs on both sides.

SQL = {
    "sql_filter": "SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 2) THEN 'near' ELSE 'far' END AS kind FROM nation WHERE n_name LIKE '%A%' AND n_nationkey BETWEEN 2 AND 20",
    "sql_join_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_join_theta": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey",
    "sql_join_self": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_join_cross": "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region",
    "sql_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 1000) AS large FROM orders GROUP BY o_orderstatus",
    "sql_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100",
    "sql_window_rank": "SELECT n_nationkey, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS dr FROM nation",
    "sql_window_lag": "SELECT o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS next FROM orders",
    "sql_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "sql_setops": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT * FROM (VALUES (100), (101)) v(x)",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 1000000) SELECT count(*) AS n FROM top",
    "sql_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 10) SELECT n, f FROM r",
    "sql_string": "SELECT n_nationkey, upper(substring(n_name, 1, 3)) AS u, replace(lower(n_name), 'a', '-') AS r, trim(n_name) AS t, CAST(length(n_name) AS BIGINT) AS n FROM nation",
    "sql_math": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, abs(l_quantity - 25) AS off, CAST(floor(l_tax * 100) AS BIGINT) AS tax, sqrt(l_quantity) AS root FROM lineitem",
    "sql_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders",
}


def _sql(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(SQL[name])

    QUERIES[name], ORACLES[name] = run, SQL[name]


for _name in SQL:
    _sql(_name)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def sql_json(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT event_id, get_json_object(props, '$.k') AS k FROM events")
