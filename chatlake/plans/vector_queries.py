"""Registered vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import vectors as vx
from chatlake.operators import index
from chatlake.operators import search as srch
from chatlake.operators import store
from chatlake.plans import sqltext as sq
from chatlake.plans.common import CENTROIDS_SQL, label_centroids, query_vector
from chatlake.plans.registry import query
from chatlake.session import run_dir
from chatlake.sources import views
from chatlake.sources.views import BOT_NAME, with_views

MENTION = "@" + BOT_NAME
EXCLUDED = ("error",)
_FILTER_SQL = (f"sender <> '{BOT_NAME}' AND NOT contains(message, '{MENTION}') "
               f"AND channel NOT IN ({', '.join(repr(c) for c in EXCLUDED)})")


def _cos_sql(v: str, q: str) -> str:
    dv = f"CAST({v} AS DOUBLE[])"
    return (f"list_dot_product({dv}, {q}) / (sqrt(list_dot_product({dv}, {dv})) * "
            f"sqrt(list_dot_product({q}, {q})))")


def _search(spark, sf):
    return srch.vector_search(views.chat_vec(spark, sf), query_vector(spark, sf, 0),
                              bot_name=BOT_NAME, mention=MENTION, exclude_channels=EXCLUDED)


_HITS_SQL = f"""{CENTROIDS_SQL},
  scored AS (SELECT id, ts, sender, channel, message, {_cos_sql('m.vector', 'c.vector')} AS sim
             FROM chat_vec m, centroids c WHERE c.qid = 0 AND {_FILTER_SQL}),
  hits AS (SELECT row_number() OVER (ORDER BY sim DESC, id) AS hit_rank, id, sender AS role,
             message AS content, round(sim, 6) AS similarity,
             epoch_us(ts) // 1000000 AS timestamp, channel
           FROM scored WHERE sim > 0.3 ORDER BY sim DESC, id LIMIT 20)"""

_ISO_SQL = ("CASE WHEN strftime({t}, '%f') = '000000' THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') "
            "ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END")

_CONTEXT_SQL = f"""{_HITS_SQL},
  ctx AS (SELECT h.hit_rank, h.id AS hit_id, c.id, c.sender AS role, c.message AS content,
                 {_ISO_SQL.format(t='c.ts')} AS timestamp, c.channel
          FROM hits h JOIN chat_vec c ON c.channel = h.channel
           AND c.id BETWEEN h.id - 2 AND h.id + 2)"""


@query("vector_search", with_views(f"WITH {_HITS_SQL} SELECT * FROM hits", "chat_vec"))
def vector_search(spark, sf):
    return _search(spark, sf)


@query("search_indexed", with_views(f"WITH {_HITS_SQL} SELECT * FROM hits", "chat_vec"))
def search_indexed(spark, sf):
    """The same search over an index of all events, reading only the cells that can
    hold a hit (CMD-8, O-3)."""
    path = run_dir(spark, "search_indexed")
    index.build(views.chat_vec(spark, sf), path)
    return index.search(spark, path, query_vector(spark, sf, 0), bot_name=BOT_NAME, mention=MENTION, exclude_channels=EXCLUDED)


@query("vector_search_batch", with_views(f"""WITH {CENTROIDS_SQL},
  scored AS (SELECT c.qid, id, ts, sender, channel, message, {_cos_sql('m.vector', 'c.vector')} AS sim
             FROM chat_vec m, centroids c WHERE {_FILTER_SQL}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS hit_rank
             FROM scored WHERE sim > 0.3)
  SELECT qid, hit_rank, id, sender AS role, message AS content, round(sim, 6) AS similarity,
         epoch_us(ts) // 1000000 AS timestamp, channel FROM ranked WHERE hit_rank <= 20""",
    "chat_vec"))
def vector_search_batch(spark, sf):
    return srch.vector_search_batch(views.chat_vec(spark, sf), label_centroids(spark, sf),
                                    bot_name=BOT_NAME, mention=MENTION,
                                    exclude_channels=EXCLUDED)


@query("search_context", with_views(f"WITH {_CONTEXT_SQL} SELECT * FROM ctx", "chat_vec"))
def search_context(spark, sf):
    return srch.search_context(views.chat_vec(spark, sf), _search(spark, sf))


QUESTION = "What did k 69 say?"
_TOKENS_SQL = "@?[\\p{L}\\p{N}]+(?:[._''-][\\p{L}\\p{N}]+)*"


@query("search_text", with_views(f"""WITH h AS (
    SELECT row_number() OVER (ORDER BY ts, id) - 1 AS id, ts, sender, channel,
           array_to_string(regexp_extract_all(lower(message), '{_TOKENS_SQL}'), ' ') AS message FROM chat_event),
  q AS (SELECT 0 AS k, '{QUESTION}' AS question),
  {sq.hashed_ctes('h', 'id', 'message', 'mv')}, {sq.hashed_ctes('q', 'k', 'question', 'qv')},
  scored AS (SELECT h.*, d / (mv_n.norm * qv_n.norm) AS sim FROM h JOIN mv_n ON mv_n.k = h.id, qv_n,
             (SELECT mv_b.k AS m, sum(mv_b.c * qv_b.c) AS d FROM mv_b JOIN qv_b USING (bucket) GROUP BY mv_b.k) dots
             WHERE dots.m = h.id AND sender <> '{BOT_NAME}' AND NOT contains(message, '{MENTION}')),
  hits AS (SELECT row_number() OVER (ORDER BY sim DESC, id) AS hit_rank, id, channel, sim
           FROM scored WHERE sim > 0.3 ORDER BY sim DESC, id LIMIT 20)
  SELECT hit_rank, x.id AS hit_id, c.id, c.sender AS role, c.message AS content,
         {_ISO_SQL.format(t='c.ts')} AS timestamp, c.channel
  FROM hits x JOIN h c ON c.channel = x.channel AND c.id BETWEEN x.id - 2 AND x.id + 2""", "chat_event"))
def search_text(spark, sf):
    """All events ingested to a store, then a text question: embedded, searched by
    the stored vectors and norms, with the conversation of each hit read from the
    store's id blocks (CMD-8, U-1, J-1)."""
    path = run_dir(spark, "search_text")
    store.add(views.chat_event(spark, sf).withColumnRenamed("id", "source_id"), path, "import")
    history = spark.read.parquet(path)
    hits = srch.search_text(history, QUESTION, bot_name=BOT_NAME, mention=MENTION)
    return srch.search_context(history, hits)


@query("search_document", with_views(f"""WITH {_CONTEXT_SQL},
  blocks AS (SELECT hit_rank, count(*) AS n,
               string_agg(role || ' (' || timestamp || '): ' || content || chr(10), '' ORDER BY id)
               || '===' || chr(10) AS block,
               string_agg(role || ': ' || content, chr(10) || chr(10) ORDER BY id) AS flat
               FROM ctx GROUP BY hit_rank)
  SELECT count(*) AS n_blocks, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines,
         coalesce(string_agg(block, '' ORDER BY hit_rank), '') AS document,
         coalesce(string_agg(flat, chr(10) || chr(10) ORDER BY hit_rank), '') AS results_text
  FROM blocks""",
    "chat_vec"))
def search_document(spark, sf):
    ctx = srch.search_context(views.chat_vec(spark, sf), _search(spark, sf))
    return srch.search_document(ctx)


@query("context_window", with_views("""
    SELECT a.id, a.channel, count(*) AS n_context,
           string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS context_ids
    FROM chat_event a JOIN chat_event b ON a.channel = b.channel AND b.id BETWEEN a.id - 2 AND a.id + 2
    GROUP BY a.id, a.channel""", "chat_event"))
def context_window(spark, sf):
    return srch.context_window(views.chat_event(spark, sf))


@query("cosine_pairs", with_views(f"""WITH {CENTROIDS_SQL}
    SELECT m.id, round({_cos_sql('m.vector', 'c.vector')}, 6) AS similarity
    FROM chat_vec m, centroids c WHERE c.qid = 0""", "chat_vec"))
def cosine_pairs(spark, sf):
    """Cosine of every stored message vector with the query vector (MTH-3)."""
    q = query_vector(spark, sf, 0)
    qcol = F.array(*[F.lit(float(x)).cast("double") for x in q])
    return views.chat_vec(spark, sf).select(
        "id", F.round(vx.cosine("vector", qcol), 6).alias("similarity"))


@query("vector_norms", with_views("""
    SELECT id, round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6)
           AS norm FROM chat_vec""", "chat_vec"))
def vector_norms(spark, sf):
    return views.chat_vec(spark, sf).select("id", F.round(vx.norm("vector"), 6).alias("norm"))


@query("vector_codec", with_views("""
    SELECT id, len(vector) AS n_dims, round(list_sum(CAST(vector AS DOUBLE[])), 4) AS total,
           true AS exact_roundtrip FROM chat_vec""", "chat_vec"))
def vector_codec(spark, sf):
    """Vector -> comma text -> vector (ARR-1, ARR-2): the float values come back exactly."""
    v = views.chat_vec(spark, sf)
    back = vx.from_text(vx.to_text("vector"))
    same = F.aggregate(F.zip_with("vector", back, lambda a, b: a == b.cast("float")),
                       F.lit(True), lambda acc, x: acc & x)
    return v.select("id", F.size(back).alias("n_dims"),
                    F.round(F.aggregate(back, F.lit(0.0).cast("double"), lambda s, x: s + x), 4)
                    .alias("total"),
                    same.alias("exact_roundtrip"))
