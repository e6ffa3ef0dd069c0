"""Registered prompt-table queries and whole-history chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators import bisection
from chatlake.operators import digest as dg
from chatlake.operators import history as hist
from chatlake.operators import prompts as pr
from chatlake.operators import search as srch
from chatlake.plans import sqltext as sq
from chatlake.plans.registry import query
from chatlake.plans.vector_queries import _CONTEXT_SQL, _search
from chatlake.sources import views
from chatlake.sources.views import with_views


# ---- prompt tables ----
_TRANSCRIPTS_SQL = """SELECT channel AS request_id, string_agg(sender || ': ' || message, chr(10) ORDER BY id DESC) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS rn FROM chat_text)
    WHERE rn <= 40 GROUP BY channel"""
_USER_TEXT_SQL = """SELECT sender AS request_id,
        string_agg(sender || ': ' || message, chr(10) ORDER BY id) AS text
    FROM chat_text GROUP BY sender"""


def _row_sql(src: str, kind: str, chunk: str, prompt: str, system: str = "NULL") -> str:
    temp, mx = pr.SETTINGS[kind]
    t = "NULL" if temp is None else repr(temp)
    m = "NULL" if mx is None else str(mx)
    return (f"SELECT CAST(request_id AS VARCHAR) AS request_id, '{kind}' AS kind, "
            f"CAST({chunk} AS VARCHAR) AS chunk, CAST({system} AS VARCHAR) AS system, "
            f"{prompt} AS prompt, CAST({t} AS DOUBLE) AS temperature, "
            f"CAST({m} AS BIGINT) AS max_tokens FROM {src}")


_PROMPT_ROWS_SQL = with_views(f"""WITH RECURSIVE tr AS ({_TRANSCRIPTS_SQL}),
    pt AS ({_USER_TEXT_SQL}),
    docs AS (SELECT doc_id AS request_id, text FROM documents),
    {sq.bisect_ctes('tr', 2048, 'b1')},
    {sq.bisect_ctes('pt', 2048, 'b2')},
    {sq.pack_ctes('docs', 10000, 'pk')}
    {_row_sql('b1_leaves', 'summary', 'path', sq.fill(pr.SUMMARY_TEMPLATE, text='piece'))}
    UNION ALL {_row_sql('b2_leaves', 'profile', 'path', sq.fill(pr.PROFILE_TEMPLATE, text='piece'))}
    UNION ALL {_row_sql('pk_packed', 'dossier', 'chunk_no', sq.fill(pr.DOSSIER_TEMPLATE, chat_history=sq.lit(pr.MEMORY_PREFIX) + ' || chunk', human_input=sq.lit(pr.DOSSIER_INPUT)))}""",
    "chat_text")


@query("prompt_rows", _PROMPT_ROWS_SQL)
def prompt_rows(spark, sf):
    """Batch-inference requests: channel summaries (C-1), user profiles
    (C-2) and history dossiers (C-5), one row per piece."""
    text = views.chat_text(spark, sf)
    tr = hist.channel_transcripts(text, 40, newest_first=True).select(F.col("channel").alias("request_id"),
                                                   F.col("transcript").alias("text"))
    leaves = _user_history_bisect(spark, sf, pr.ch.BISECT_LIMIT).withColumnRenamed("sender", "request_id")
    docs = views.long_text(spark, sf).select(F.col("doc_id").alias("request_id"), "text")
    return (pr.bisected_prompts(tr, "summary")
            .unionByName(pr.prompts_from_leaves(leaves, "profile"))
            .unionByName(pr.dossier_prompts(docs)))


SEARCH_QUERY = "label-0"


@query("prompt_search", with_views(f"""WITH RECURSIVE {_CONTEXT_SQL},
    blocks AS (SELECT hit_rank, string_agg(role || ' (' || timestamp || '): ' || content || chr(10), '' ORDER BY id)
               || '===' || chr(10) AS block,
               string_agg(role || ': ' || content, chr(10) || chr(10) ORDER BY id) AS flat
               FROM ctx GROUP BY hit_rank),
    sd AS (SELECT 'q0' AS request_id, '{SEARCH_QUERY}' AS query,
                  coalesce(string_agg(block, '' ORDER BY hit_rank), '') AS text,
                  coalesce(string_agg(flat, chr(10) || chr(10) ORDER BY hit_rank), '') AS results_text
           FROM blocks),
    sdr AS (SELECT request_id, results_text AS text FROM sd),
    {sq.bisect_ctes('sdr', 2048, 'b3')},
    b3q AS (SELECT l.*, sd.query FROM b3_leaves l JOIN sd USING (request_id))
    {_row_sql('b3q', 'search', 'path', sq.fill(pr.SEARCH_TEMPLATE, query='query', text='piece'))}
    UNION ALL {_row_sql('sd', 'relevance', "''", sq.fill(pr.RELEVANCE_TEMPLATE, query='query', text='text'), sq.lit(pr.RELEVANCE_SYSTEM))}""",
    "chat_vec"))
def prompt_search(spark, sf):
    """Prompts built from a search result document (C-3, C-4)."""
    ctx = srch.search_context(views.chat_vec(spark, sf), _search(spark, sf))
    doc = srch.search_document(ctx).select(F.lit("q0").alias("request_id"),
                                           F.lit(SEARCH_QUERY).alias("query"),
                                           F.col("document").alias("text"), "results_text")
    return pr.search_prompts(doc)


# ---- a user's whole history packed to the dossier budget (CMD-5, CH-2) ----
def primer_text_sql(src: str) -> str:
    """(request_id, text) of each sender's history in ``src``, as a primer is built from it."""
    return f"""SELECT sender AS request_id, string_agg(line, chr(10) ORDER BY section_no, seq) AS text
    FROM (SELECT h.sender, s.section_no, h.id AS seq, h.message AS line
          FROM {src} h JOIN (SELECT sender, channel,
                 row_number() OVER (PARTITION BY sender ORDER BY min(id)) AS section_no
               FROM {src} GROUP BY sender, channel) s ON h.sender = s.sender AND h.channel = s.channel
          UNION ALL SELECT sender, row_number() OVER (PARTITION BY sender ORDER BY min(id)), -1,
                 '=== ' || channel || ' ===' FROM {src} GROUP BY sender, channel)
    GROUP BY sender"""



def _user_history_pack(spark, sf, limit):
    from chatlake.operators import packing as pk
    lines = hist.user_history_lines(views.chat_text(spark, sf), style="primer")
    sub = lines.select("sender", "section_no", "seq",
                       F.posexplode(F.split("line", "\n")).alias("sub", "text"))
    return pk.pack_line_rows(sub, "sender", ["section_no", "seq", "sub"], "text", limit)


def _register_user_pack(name, limit):
    @query(name, with_views(f"""WITH RECURSIVE pt AS ({primer_text_sql('chat_text')}),
        {sq.pack_ctes('pt', limit, 'pk')}
        SELECT request_id AS sender, chunk_no, chunk, n_tokens FROM pk_packed""", "chat_text"))
    def run(spark, sf):
        """Each user's whole history text ('=== channel ===' sections) packed
        into dossier chunks, computed over line rows so a prolific user is
        never one row or one task (CMD-5, CH-2)."""
        return _user_history_pack(spark, sf, limit)
    return run


pack_user_history = _register_user_pack("pack_user_history", pr.ch.PACK_LIMIT)
pack_user_history_512 = _register_user_pack("pack_user_history_512", 512)


@query("dossier_prompts", with_views(f"""WITH RECURSIVE pt AS ({primer_text_sql('chat_text')}),
    {sq.pack_ctes('pt', pr.ch.PACK_LIMIT, 'pk')}
    {_row_sql('pk_packed', 'dossier', 'chunk_no', sq.fill(pr.DOSSIER_TEMPLATE, chat_history=sq.lit(pr.MEMORY_PREFIX) + ' || chunk', human_input=sq.lit(pr.DOSSIER_INPUT)))}""",
    "chat_text"))
def dossier_prompts(spark, sf):
    """One dossier prompt per packed chunk of each user's whole history (CMD-5, C-5)."""
    packed = _user_history_pack(spark, sf, pr.ch.PACK_LIMIT)
    return pr.dossier_from_chunks(packed.withColumnRenamed("sender", "request_id"))


# ---- a user's whole history bisected for profile prompts (CMD-3, CH-1, C-2) ----


def _user_history_bisect(spark, sf, limit):
    from chatlake.functions import text as tx2
    t = views.chat_text(spark, sf)
    sub = t.select("sender", "id", F.posexplode(F.split(tx2.line("sender", "message"), "\n"))
                   .alias("sub", "text"))
    return bisection.bisect_line_rows(sub, "sender", ["id", "sub"], "text", limit)


def _register_user_bisect(name, limit):
    @query(name, with_views(f"""WITH RECURSIVE ut AS ({_USER_TEXT_SQL}),
        {sq.bisect_ctes('ut', limit, 'bs')}
        SELECT request_id AS sender, path, piece FROM bs_leaves""", "chat_text"))
    def run(spark, sf):
        """Each user's whole history text ('sender: message' lines by id)
        bisected to the token limit, computed over line rows so a prolific
        user is never one row or one task (CMD-3, CH-1)."""
        return _user_history_bisect(spark, sf, limit)
    return run


bisect_user_history = _register_user_bisect("bisect_user_history", pr.ch.BISECT_LIMIT)
bisect_user_history_512 = _register_user_bisect("bisect_user_history_512", 512)


@query("profile_prompts", with_views(f"""WITH RECURSIVE ut AS ({_USER_TEXT_SQL}),
    {sq.bisect_ctes('ut', pr.ch.BISECT_LIMIT, 'bs')}
    {_row_sql('bs_leaves', 'profile', 'path', sq.fill(pr.PROFILE_TEMPLATE, text='piece'))}""",
    "chat_text"))
def profile_prompts(spark, sf):
    """One profile prompt per bisection leaf of each user's whole history (CMD-3, C-2)."""
    leaves = _user_history_bisect(spark, sf, pr.ch.BISECT_LIMIT)
    return pr.prompts_from_leaves(leaves.withColumnRenamed("sender", "request_id"), "profile")


# ---- one user's history in one channel, summarised (CMD-2, C-1) ----
_USER_CHANNEL_SQL = """SELECT sender || chr(31) || channel AS request_id,
        string_agg(sender || ': ' || message, chr(10) ORDER BY id) AS text
    FROM chat_text GROUP BY sender, channel"""


@query("user_summary_prompts", with_views(f"""WITH RECURSIVE uc AS ({_USER_CHANNEL_SQL}),
    {sq.bisect_ctes('uc', pr.ch.BISECT_LIMIT, 'bs')}
    {_row_sql('bs_leaves', 'summary', 'path', sq.fill(pr.SUMMARY_TEMPLATE, text='piece'))}""",
    "chat_text"))
def user_summary_prompts(spark, sf):
    """Summary prompts of each user's history in each channel ('name:
    message' lines by id; D2: the message, not the row), bisected over line
    rows so no (user, channel) history is ever one row (CMD-2, C-1)."""
    t = views.chat_text(spark, sf)
    key = F.concat("sender", F.lit("\u001f"), "channel")
    sub = t.select(key.alias("request_id"), "id",
                   F.posexplode(F.split(tx.line("sender", "message"), "\n")).alias("sub", "text"))
    leaves = bisection.bisect_line_rows(sub, "request_id", ["id", "sub"], "text", pr.ch.BISECT_LIMIT)
    return pr.prompts_from_leaves(leaves, "summary")
