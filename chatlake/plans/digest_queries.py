"""Registered digest, profile and relevance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators import digest as dg
from chatlake.operators import varied as vr
from chatlake.plans import sqltext as sq
from chatlake.plans.registry import query
from chatlake.sources import views
from chatlake.sources.views import with_views

USER_DIGEST_K = dg.USER_DIGEST_K
SUMMARIZE_N = 100


def _digest_sql(groups: str, k: int) -> str:
    return with_views(f"""WITH {sq.tfidf_ctes('chat_text')},
    r AS (SELECT {groups}, c.id, sc.score,
                 row_number() OVER (PARTITION BY {groups} ORDER BY round(sc.score, 9) DESC, c.id) AS digest_rank
          FROM chat_text c JOIN sc USING (id))
    SELECT {groups}, digest_rank, id, round(score, 6) AS score FROM r WHERE digest_rank <= {k}""",
        "chat_text")


@query("channel_digest", _digest_sql("channel", dg.DIGEST_K))
def channel_digest(spark, sf):
    """The 5 most distinctive messages of every channel (CMD-1, C-6)."""
    return dg.top_messages(views.chat_text(spark, sf), ["channel"], dg.DIGEST_K)


@query("user_digest", _digest_sql("sender, channel", USER_DIGEST_K))
def user_digest(spark, sf):
    """Per user per channel, the 3 most distinctive messages (CMD-2)."""
    return dg.top_messages(views.chat_text(spark, sf), ["sender", "channel"], USER_DIGEST_K)


def _varied_sql(k: int) -> str:
    """The walk as a recursive iteration, and a pair of CTEs for each choice."""
    far = 1 - vr.BALANCE
    picks = "".join(f"""
    b{s} AS (SELECT channel, id, round({vr.BALANCE} * rel - {far} * near, {vr.DIGITS}) AS gain FROM p{s}
             QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round({vr.BALANCE} * rel - {far} * near, {vr.DIGITS}) DESC, id) = 1),
    p{s + 1} AS (SELECT p.channel, p.id, p.rel, greatest(p.near, coalesce(s.sim, 0)) AS near
                 FROM p{s} p JOIN b{s} b USING (channel) LEFT JOIN sims s ON s.channel = p.channel AND s.a = p.id AND s.b = b.id
                 WHERE p.id <> b.id),""" for s in range(1, k + 1))
    chosen = " UNION ALL ".join(f"SELECT channel, {s} AS digest_rank, id, gain FROM b{s}" for s in range(1, k + 1))
    return with_views(f"""WITH RECURSIVE {sq.tfidf_ctes('chat_text')},
    firsts AS (SELECT channel, array_to_string(regexp_extract_all(lower(message), '{sq.TERM_RE_SQL}'), ' ') AS line,
                      min(id) AS id, count(*) AS copies
               FROM chat_text WHERE len(regexp_extract_all(lower(message), '{sq.TERM_RE_SQL}')) > 0 GROUP BY ALL),
    cand AS (SELECT channel, id, copies FROM firsts JOIN sc USING (id)
             QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(score, {vr.DIGITS}) DESC, id) <= {vr.CANDIDATES}),
    vec AS (SELECT c.channel, c.id, tf.term, tf.tf * ln((1 + nd.n) / (1 + df.df)) AS w
            FROM cand c JOIN tf USING (id) JOIN df USING (term), nd WHERE df.df <= {vr.RARE} * nd.n),
    norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM vec GROUP BY id),
    sims AS (SELECT x.channel, x.id AS a, y.id AS b, round(sum(x.w * y.w) / (any_value(m.norm) * any_value(n.norm)), {vr.DIGITS}) AS sim
             FROM vec x JOIN vec y ON x.channel = y.channel AND x.term = y.term AND x.id <> y.id
                  JOIN norms m ON m.id = x.id JOIN norms n ON n.id = y.id GROUP BY ALL),
    steps AS (SELECT channel, a, b, sim / sum(sim) OVER (PARTITION BY channel, b) AS p FROM sims
              UNION ALL SELECT channel, id, id, 0 FROM cand),
    size AS (SELECT channel, CAST(count(*) AS DOUBLE) AS n FROM cand GROUP BY channel),
    walk AS (SELECT 0 AS round, channel, id, 1 / n AS r FROM cand JOIN size USING (channel)
             UNION ALL SELECT any_value(w.round) + 1, s.channel, s.a, {1 - vr.WALK} / any_value(z.n) + {vr.WALK} * sum(s.p * w.r)
             FROM walk w JOIN steps s ON s.channel = w.channel AND s.b = w.id JOIN size z ON z.channel = s.channel
             WHERE w.round < {vr.ROUNDS} GROUP BY s.channel, s.a),
    central AS (SELECT channel, id, r FROM walk WHERE round = {vr.ROUNDS}),
    p1 AS (SELECT channel, id, round(r / max(r) OVER (PARTITION BY channel), {vr.DIGITS}) AS rel, CAST(0 AS DOUBLE) AS near FROM central),{picks}
    chosen AS ({chosen})
    SELECT channel, digest_rank, id, copies, round(r, 6) AS centrality, round(gain, 6) AS gain
    FROM chosen JOIN cand USING (channel, id) JOIN central USING (channel, id)""", "chat_text")


@query("digest_varied", _varied_sql(dg.DIGEST_K))
def digest_varied(spark, sf):
    """Every channel's 5 most central messages that differ from each other (CMD-1, C-6)."""
    return vr.varied_messages(views.chat_text(spark, sf), ["channel"])


def _summary_sql(src: str, groups: str, k: int) -> str:
    """CTEs ending in ``pieces``: the summary text of each group of ``src``."""
    return f"""{sq.tfidf_ctes(src)},
    ranked AS (SELECT {groups}, c.id, c.sender || ': ' || c.message AS line,
                      row_number() OVER (PARTITION BY {groups} ORDER BY round(coalesce(sc.score, 0), 9) DESC, c.id) AS rn
               FROM {src} c LEFT JOIN sc USING (id)),
    texts AS (SELECT {groups}, string_agg(line, chr(10) ORDER BY id) AS text FROM ranked WHERE rn <= {k} GROUP BY {groups}),
    pieces AS (SELECT {groups}, pos, substr(text, pos * 2000 + 1, 2000) AS piece FROM (
      SELECT {groups}, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2000.0) AS BIGINT)))) AS pos FROM texts))"""


@query("cmd_summarize", with_views(f"""WITH lastn AS (
      SELECT * FROM chat_text QUALIFY row_number() OVER (PARTITION BY channel ORDER BY id DESC) <= {SUMMARIZE_N}),
    {_summary_sql('lastn', 'channel', dg.DIGEST_K)} SELECT * FROM pieces""", "chat_text"))
def cmd_summarize(spark, sf):
    """Every channel's last 100 messages, summarised and cut to replies (CMD-1)."""
    return dg.channel_summaries(views.chat_text(spark, sf), SUMMARIZE_N)


@query("cmd_usersummary", with_views(f"""WITH asked AS (
      SELECT sender, 'ch-' || CAST(i AS VARCHAR) AS channel FROM (SELECT DISTINCT sender FROM chat_text), range(0, 12) r(i)),
    there AS (SELECT * FROM chat_text SEMI JOIN asked USING (sender, channel)),
    {_summary_sql('there', 'sender, channel', dg.USER_DIGEST_K)}
    SELECT * FROM pieces
    UNION ALL SELECT sender, channel, 0, 'No chat history found for user ' || sender || ' in channel ' || channel || '.'
    FROM asked ANTI JOIN there USING (sender, channel)""", "chat_text"))
def cmd_usersummary(spark, sf):
    """Each user's messages of each of twelve channels, two of which are not there,
    summarised and cut to replies (CMD-2)."""
    t = views.chat_text(spark, sf)
    channels = F.array(*[F.lit(f"ch-{i}") for i in range(12)])
    asked = t.select("sender").distinct().select("sender", F.explode(channels).alias("channel"))
    return dg.user_summaries(t, asked)


def profile_ctes(src: str) -> str:
    """CTEs ending in ``profiles`` (facts and top_terms of each sender of ``src``)."""
    return f"""{sq.tfidf_ctes(src)},
    bys AS (SELECT c.sender, tf.term, sum(tf.tf) AS ttf FROM tf JOIN {src} c USING (id) GROUP BY ALL),
    w AS (SELECT sender, term, ttf * ln((1 + nd.n) / (1 + df.df)) AS weight FROM bys JOIN df USING (term), nd),
    top AS (SELECT sender, string_agg(term, ' ' ORDER BY r) AS top_terms FROM (
              SELECT *, row_number() OVER (PARTITION BY sender ORDER BY round(weight, 9) DESC, term) AS r FROM w)
            WHERE r <= {dg.PROFILE_TERMS} GROUP BY sender),
    facts AS (SELECT sender, count(*) AS n_messages, count(DISTINCT channel) AS n_channels,
                     min(id) AS first_id, max(id) AS last_id,
                     CAST(sum(len(regexp_extract_all(lower(message), '{sq.TERM_RE_SQL}'))) AS BIGINT) AS n_terms
              FROM {src} GROUP BY sender),
    profiles AS (SELECT facts.*, top.top_terms FROM facts LEFT JOIN top USING (sender))"""


@query("user_profile", with_views(f"WITH {profile_ctes('chat_text')} SELECT * FROM profiles", "chat_text"))
def user_profile(spark, sf):
    """Per-sender profile: activity facts and top distinctive terms (CMD-3, C-6)."""
    return dg.user_profiles(views.chat_text(spark, sf))


_REQ_SQL = """SELECT id AS request_id, 'Customer#' || lpad(CAST(id // 100 AS VARCHAR), 9, '0') AS user_name,
        array_to_string(regexp_extract_all(message, '[^\\s]+'), ' ') AS question
    FROM chat_text"""


_RELEVANCE_SQL = f"""WITH req AS ({_REQ_SQL}),
    pr AS (SELECT user_name, arg_min_null(primer, id) AS primer FROM users GROUP BY user_name),
    j AS (SELECT req.*, pr.primer FROM req LEFT JOIN pr USING (user_name)),
    {sq.hashed_ctes('j', 'request_id', 'primer', 'pv')},
    {sq.hashed_ctes('j', 'request_id', 'question', 'qv')},
    dot AS (SELECT pv_b.k, sum(pv_b.c * qv_b.c) AS d FROM pv_b JOIN qv_b ON pv_b.k = qv_b.k AND pv_b.bucket = qv_b.bucket GROUP BY pv_b.k),
    s AS (SELECT j.request_id, j.user_name, j.primer,
                 coalesce(dot.d / (pv_n.norm * qv_n.norm), 0.0) AS sim
          FROM j LEFT JOIN dot ON dot.k = j.request_id LEFT JOIN pv_n ON pv_n.k = j.request_id
                 LEFT JOIN qv_n ON qv_n.k = j.request_id)"""


@query("primer_relevance", with_views(f"""{_RELEVANCE_SQL}
    SELECT request_id, user_name,
           CASE WHEN primer IS NOT NULL THEN round(sim, 6) END AS similarity,
           CASE WHEN primer IS NOT NULL THEN sim > {dg.RELEVANCE_THRESHOLD} END AS relevant
    FROM s""", "chat_text", "users"))
def primer_relevance(spark, sf):
    """'NAME question' arguments of the primer command: is NAME's primer
    relevant to the question (CMD-7, C-7)? The command word itself is
    removed by the command dispatcher before the argument is parsed."""
    return dg.primer_relevance(primer_requests(spark, sf), views.users(spark, sf))


def primer_requests(spark, sf):
    """(request_id, user_name, question) parsed from the primer command's arguments."""
    t = views.chat_text(spark, sf)
    raw = F.concat(F.lit("Customer#"),
                   F.lpad((F.col("id") / 100).cast("long").cast("string"), 9, "0"),
                   F.lit(" "), F.col("message"))
    return t.select(F.col("id").alias("request_id"), raw.alias("raw")).select(
        "request_id", tx.parse_command_user("raw").alias("user_name"),
        tx.command_rest("raw").alias("question"))


@query("primer_check_replies", with_views(f"""{_RELEVANCE_SQL}
    SELECT request_id, user_name, CASE WHEN user_name NOT IN (SELECT user_name FROM users)
             THEN 'No user with the username ''' || user_name || ''' found in the database.'
           WHEN primer IS NOT NULL AND sim > {dg.RELEVANCE_THRESHOLD} THEN primer
           ELSE 'The primer is not useful for answering the query.' END AS reply
    FROM s""", "chat_text", "users"))
def primer_check_replies(spark, sf):
    """The answer to each primer check: the primer, that it does not help, or that
    there is no such user (CMD-7)."""
    return dg.primer_check(primer_requests(spark, sf), views.users(spark, sf))
