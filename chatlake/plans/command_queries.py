"""Commands as whole chains, and sinks that are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import history as hist
from chatlake.operators import primers, profile_state
from chatlake.operators import prompts as pr
from chatlake.operators import transcripts as trs
from chatlake.plans import sqltext as sq
from chatlake.plans.digest_queries import _REQ_SQL, primer_requests, profile_ctes
from chatlake.plans.prompt_queries import _row_sql, primer_text_sql
from chatlake.plans.registry import query
from chatlake.session import run_dir
from chatlake.sources import views
from chatlake.sources.views import with_views


@query("cmd_buildprimer", with_views(f"""WITH RECURSIVE u AS (
      SELECT c_custkey AS id, 'user-' || CAST(c_custkey AS VARCHAR) AS user_name,
             CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS primer FROM customer),
    {profile_ctes('chat_event')},
    pt AS ({primer_text_sql('chat_event')}),
    {sq.pack_ctes('pt', pr.ch.PACK_LIMIT, 'pk')},
    req AS (SELECT request_id, count(*) AS n FROM pk_packed GROUP BY 1),
    files AS (SELECT sender, sum(len(string_split(message, chr(10)))) + 2 * count(DISTINCT channel) AS n FROM chat_event GROUP BY 1)
    SELECT u.id, u.user_name, CASE WHEN p.sender IS NULL THEN u.primer ELSE p.sender || ': ' || CAST(n_messages AS VARCHAR)
             || ' messages in ' || CAST(n_channels AS VARCHAR) || ' channels (ids ' || CAST(first_id AS VARCHAR) || '..'
             || CAST(last_id AS VARCHAR) || '); distinctive terms: ' || coalesce(top_terms, '') END AS primer,
           CAST(coalesce(files.n, 0) AS BIGINT) AS n_lines, coalesce(req.n, 0) AS n_prompts
    FROM u LEFT JOIN profiles p ON p.sender = u.user_name LEFT JOIN files ON files.sender = u.user_name
    LEFT JOIN req ON req.request_id = u.user_name""", "chat_event"))
def cmd_buildprimer(spark, sf):
    """Every user's primer built from their history and stored, with the lines of
    their history file and the dossier requests read back (CMD-5, SNK-6, SNK-7)."""
    folder = run_dir(spark, "primers")
    users = views.users(spark, sf).withColumn("user_name", F.concat(F.lit("user-"), "user_id"))
    info = primers.build_primers(views.chat_event(spark, sf), users, folder)
    lines = hist.read_lines(spark, f"{folder}/history", "sender").groupBy(F.col("sender").alias("user_name")).agg(
        F.count("*").alias("n_lines"))
    asked = spark.read.parquet(f"{folder}/requests").groupBy(F.col("request_id").alias("user_name")).agg(
        F.count("*").alias("n_prompts"))
    return info.join(lines, "user_name", "left").join(asked, "user_name", "left").select(
        "id", "user_name", "primer", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_prompts", F.lit(0)).alias("n_prompts"))


@query("primers_by_batch", with_views(f"""WITH {profile_ctes('chat_text')}
    SELECT sender, sender || ': ' || CAST(n_messages AS VARCHAR) || ' messages in ' || CAST(n_channels AS VARCHAR)
             || ' channels (ids ' || CAST(first_id AS VARCHAR) || '..' || CAST(last_id AS VARCHAR)
             || '); distinctive terms: ' || coalesce(top_terms, '') AS primer, CAST(0 AS BIGINT) AS rewritten
    FROM profiles""", "chat_text"))
def primers_by_batch(spark, sf):
    """Primer files after three batches of the messages, and how many a replay of
    the last one writes again (CMD-5, SNK-4, SNK-7)."""
    folder = run_dir(spark, "primer-state")
    chat = views.chat_text(spark, sf)
    for k in (0, 1, 2, 2):
        written = profile_state.update_primers(chat.where(F.col("id") % 3 == k), folder, f"part-{k}")
    primer = hist.read_lines(spark, f"{folder}/primers", "sender").select("sender", F.col("line").alias("primer"))
    return primer.withColumn("rewritten", F.lit(written.count()))


@query("user_history_files", with_views("""
    WITH s AS (SELECT sender, channel, row_number() OVER (PARTITION BY sender ORDER BY min(id)) AS section_no
               FROM chat_text GROUP BY sender, channel),
    parts AS (SELECT sender, section_no, id AS seq, sender || ': ' || message AS line FROM chat_text JOIN s USING (sender, channel)
              UNION ALL SELECT sender, section_no, -1, '--- ' || channel || ' ---' FROM s
              UNION ALL SELECT sender, section_no, 4611686018427387904, '' FROM s),
    files AS (SELECT sender, string_split(string_agg(line, chr(10) ORDER BY section_no, seq), chr(10)) AS lines FROM parts GROUP BY sender)
    SELECT sender, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line FROM files""", "chat_text"))
def user_history_files(spark, sf):
    """Every user's history file, written and read back in its order (SNK-6)."""
    path = run_dir(spark, "history-files")
    hist.write_user_history(hist.user_history_lines(views.chat_text(spark, sf)), path)
    return hist.read_ordered(spark, path, "sender")


_TRANSCRIPT_SQL = """SELECT channel, trim(string_agg(sender || ': ' || message, chr(10) ORDER BY id), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
    FROM (SELECT * FROM chat_text QUALIFY row_number() OVER (PARTITION BY channel ORDER BY id DESC) <= 40) GROUP BY channel"""


@query("transcript_files", with_views(f"""WITH t AS ({_TRANSCRIPT_SQL})
    SELECT channel, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line
    FROM (SELECT channel, string_split(text, chr(10)) AS lines FROM t)""",
    "chat_text"))
def transcript_files(spark, sf):
    """The last 40 messages of every channel as transcript files, read back in their order (SNK-8)."""
    path = run_dir(spark, "transcripts")
    t = hist.channel_transcripts(views.chat_text(spark, sf), 40)
    hist.write_lines(trs.transcript_lines(t), path, "channel", ["line_no"])
    return hist.read_ordered(spark, path, "channel")


@query("primer_prompts", with_views(f"""WITH req AS ({_REQ_SQL}),
    pr AS (SELECT user_name, arg_min_null(primer, id) AS primer FROM users GROUP BY user_name),
    j AS (SELECT req.*, pr.primer FROM req JOIN pr USING (user_name) WHERE primer IS NOT NULL)
    {_row_sql('j', 'primer_check', "''", sq.fill(pr.PRIMER_CHECK_TEMPLATE, primer='primer', query='question'))}""",
    "chat_text", "users"))
def primer_prompts(spark, sf):
    """The one-token question whether a user's primer helps (CMD-7)."""
    return pr.primer_check_prompts(primer_requests(spark, sf), views.users(spark, sf))
