"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators import chunks as ch
from chatlake.operators import history as hist
from chatlake.operators import transcripts as trs
from chatlake.plans import sqltext as sq
from chatlake.plans.registry import query
from chatlake.sources import views
from chatlake.sources.tables import read_table
from chatlake.sources.views import with_views

BOT_ROLE = "assistant"    # sender name of the bot in chat_text
WS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TOKENS_SQL = sq.TOKENS_SQL
TOKEN_RE_SQL = "@?[\\p{L}\\p{N}]+(?:[._''-][\\p{L}\\p{N}]+)*"


@query("normalize_message", with_views(f"""
    SELECT id, array_to_string(regexp_extract_all(lower(message), '{TOKEN_RE_SQL}'), ' ') AS normalized
    FROM chat_text""", "chat_text"))
def normalize_message(spark, sf):
    return views.chat_text(spark, sf).select("id", tx.normalize("message").alias("normalized"))


@query("token_counts", f"""
    SELECT doc_id, {TOKENS_SQL.format(x='text')} AS n_tokens, length(text) AS n_chars,
           len(string_split(text, chr(10))) AS n_lines FROM documents""")
def token_counts(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", tx.token_count("text").alias("n_tokens"),
                    F.length("text").alias("n_chars"),
                    F.size(tx.split_lines("text")).alias("n_lines"))


@query("clean_text", with_views(f"""
    SELECT id, trim(message, {WS_SQL}) AS stripped, replace(message, chr(10), '') AS one_line,
           array_to_string(regexp_extract_all(message, '[^\\s]+'), ', ') AS label_list
    FROM chat_text""", "chat_text"))
def clean_text(spark, sf):
    """Strip, newline removal and comma-joined lists (STR-9, STR-14)."""
    words = F.regexp_extract_all("message", F.lit(tx.NON_WS_RUN), 0)
    return views.chat_text(spark, sf).select(
        "id", tx.strip("message").alias("stripped"),
        tx.remove_newlines("message").alias("one_line"),
        F.array_join(words, ", ").alias("label_list"))


_CMD_SQL = """CASE WHEN sender = 'user' THEN '!primercheck ' || message ELSE message END"""


@query("parse_command", with_views(f"""
    WITH w AS (SELECT id, regexp_extract_all({_CMD_SQL}, '[^\\s]+') AS words FROM chat_text),
    r AS (SELECT id, CASE WHEN len(words) >= 2 AND starts_with(words[1], '!')
                          THEN words[3:] ELSE words END AS rest FROM w)
    SELECT id, rest[1] AS user_name,
           CASE WHEN len(rest) >= 2 THEN array_to_string(rest[2:], ' ') ELSE '' END AS question
    FROM r""", "chat_text"))
def parse_command(spark, sf):
    """'!cmd user question...' -> user name and question (STR-10; D8: NULL user)."""
    cmd = F.when(F.col("sender") == "user", F.concat(F.lit("!primercheck "), "message"))\
        .otherwise(F.col("message"))
    t = views.chat_text(spark, sf).select("id", cmd.alias("cmd"))
    return t.select("id", tx.parse_command_user("cmd").alias("user_name"),
                    tx.command_rest("cmd").alias("question"))


_TRANSCRIPT_SQL = """SELECT channel, string_agg(sender || ': ' || message, chr(10) ORDER BY id) AS transcript
    FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS rn FROM chat_text)
    WHERE rn <= 40 GROUP BY channel"""
_LINES_SQL = f"""tl AS (SELECT channel, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line
    FROM (SELECT channel, string_split(trim(transcript, {WS_SQL}), chr(10)) AS ls FROM ({_TRANSCRIPT_SQL})))"""


def _transcripts(spark, sf):
    return hist.channel_transcripts(views.chat_text(spark, sf), 40)


@query("transcript_lines", with_views(f"WITH {_LINES_SQL} SELECT * FROM tl", "chat_text"))
def transcript_lines(spark, sf):
    """The transcript written one line per row (SNK-8)."""
    return trs.transcript_lines(_transcripts(spark, sf))


@query("parse_transcript", with_views(f"""WITH {_LINES_SQL},
    p AS (SELECT channel, line_no, trim(substr(line, 1, instr(line, ':') - 1), {WS_SQL}) AS who,
                 trim(substr(line, instr(line, ':') + 1), {WS_SQL}) AS what
          FROM tl WHERE instr(line, ':') > 0)
    SELECT channel, line_no, CASE WHEN who = '{BOT_ROLE}' THEN 'ai' ELSE 'human' END AS role,
           CASE WHEN who = '{BOT_ROLE}' THEN what ELSE who || ': ' || what END AS content
    FROM p""", "chat_text"))
def parse_transcript(spark, sf):
    """Transcript lines -> role-tagged memory rows (CMD-9, STR-5, STR-11, PF-24)."""
    return trs.parse_transcript(_transcripts(spark, sf), BOT_ROLE)


@query("timestamp_formats", with_views("""
    SELECT id, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, epoch_us(ts) // 1000000 AS epoch,
           true AS roundtrip FROM chat_event""", "chat_event"))
def timestamp_formats(spark, sf):
    """ISO and plain text forms, epoch seconds, ISO parse-back (DT-1..3)."""
    e = views.chat_event(spark, sf)
    iso = tx.iso_text("ts")
    return e.select("id", iso.alias("iso"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("plain"),
                    F.unix_timestamp("ts").alias("epoch"),
                    (F.try_to_timestamp(iso) == F.col("ts")).alias("roundtrip"))


@query("reply_pieces", """
    SELECT doc_id, pos, substr(text, pos * 2000 + 1, 2000) AS piece FROM (
      SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2000.0) AS BIGINT)))) AS pos
      FROM documents)""")
def reply_pieces(spark, sf):
    return ch.reply_pieces(views.long_text(spark, sf), ["doc_id"], "text")


_DOCS = "docs_rt AS (SELECT doc_id AS request_id, text FROM documents)"


def _bisect_cte(limit: int) -> str:
    return f"""WITH RECURSIVE {_DOCS}, {sq.bisect_ctes('docs_rt', limit, 'bs')},
    leaves AS (SELECT request_id AS doc_id, path, piece FROM bs_leaves)"""


def _bisect_sql(limit: int) -> str:
    return _bisect_cte(limit) + " SELECT * FROM leaves"


def _pack_cte(limit: int) -> str:
    return f"""WITH RECURSIVE {_DOCS}, {sq.pack_ctes('docs_rt', limit, 'pk')},
    packed AS (SELECT request_id AS doc_id, chunk_no, chunk, n_tokens FROM pk_packed)"""


def _pack_sql(limit: int) -> str:
    return _pack_cte(limit) + " SELECT * FROM packed"


def _register_bisect(name, limit):
    @query(name, _bisect_sql(limit))
    def run(spark, sf):
        return ch.bisect_chunks(views.long_text(spark, sf), ["doc_id"], "text", limit)
    return run


def _register_pack(name, limit):
    @query(name, _pack_sql(limit))
    def run(spark, sf):
        return ch.pack_lines(views.long_text(spark, sf), ["doc_id"], "text", limit)
    return run


# the reference's limits, and small limits so the test texts exercise the splits
bisect_chunks = _register_bisect("bisect_chunks", ch.BISECT_LIMIT)
bisect_chunks_512 = _register_bisect("bisect_chunks_512", 512)
pack_lines = _register_pack("pack_lines", ch.PACK_LIMIT)
pack_lines_64 = _register_pack("pack_lines_64", 64)


@query("reassemble_bisect", _bisect_cte(512) + """
    SELECT d.doc_id, count(*) AS n_parts, md5(d.text) AS md5, true AS exact
    FROM leaves JOIN documents d USING (doc_id) GROUP BY d.doc_id, d.text""")
def reassemble_bisect(spark, sf):
    """Identity answers joined in path order rebuild each text exactly (CH-4, SET-1)."""
    docs = views.long_text(spark, sf)
    parts = ch.bisect_chunks(docs, ["doc_id"], "text", 512)
    back = ch.reassemble(parts, ["doc_id"], "path", "piece", "").withColumnRenamed("text", "rebuilt")
    return back.join(docs, "doc_id").select(
        "doc_id", "n_parts", F.md5("text").alias("md5"),
        (F.col("text") == F.col("rebuilt")).alias("exact"))


@query("reassemble_packed", _pack_cte(64) + f"""
    SELECT d.doc_id, count(*) AS n_parts, md5(trim(d.text, {WS_SQL})) AS md5
    FROM packed JOIN documents d USING (doc_id) GROUP BY d.doc_id, d.text""")
def reassemble_packed(spark, sf):
    """Per-chunk answers each followed by a newline, then stripped (SET-2)."""
    docs = views.long_text(spark, sf)
    parts = ch.pack_lines(docs, ["doc_id"], "text", 64)
    back = ch.reassemble(parts.select("doc_id", "chunk_no", F.concat("chunk", F.lit("\n")).alias("c")),
                         ["doc_id"], "chunk_no", "c", "")
    return back.select("doc_id", "n_parts", F.md5(tx.strip("text")).alias("md5"))
