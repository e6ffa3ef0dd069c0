"""Prompt tables for batch inference (C-1..C-5).

Model calls are outside this library; these operators stop at one row per
request: (request_id, kind, chunk, system, prompt, temperature, max_tokens).
Texts over budget are split first (bisection or line packing), one prompt
per piece, exactly as the requests would have been sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators import chunks as ch
from chatlake.session import ship_package

# ---- fixed values: prompt templates and settings that must equal the
# reference's text for the same requests ({text}, {query} and
# {chat_history}/{human_input} are the slots) ----
SUMMARY_TEMPLATE = ("I have the following text from a conversation, and I need a summary. "
                    "\n\n{text}\n\nSummary:")
PROFILE_TEMPLATE = ("Here is a chat history for a single user. Please create a personality profile "
                    "and summary of any personal information (likes, dislikes, historical data) the "
                    "user has provided. Please try to retain as much specific data about the person "
                    "as possible. \n\n{text}\n\nSummary:")
SEARCH_TEMPLATE = ("We have a query: '{query}'. Here are some related messages from the chat "
                   "history:\n{text}\n\nBased on this information, could you provide a response to "
                   "the query? Please be specific and use names and specific examples when possible.")
RELEVANCE_SYSTEM = "You are a helpful assistant."
RELEVANCE_TEMPLATE = ("Given the query '{query}', evaluate the following text for relevance. Each "
                      "block is a small part of an ongoing conversation. 'Role' will indicate the "
                      "users name for each message, use this as much as possible in your answer. "
                      "'Timestamp' will tell you when a message was said, statements like 'last week "
                      "Jack mentioned x' are encouraged.'{text}' Is any information in provided text "
                      "relevant to the query? If so, provide a detailed summary.")
DOSSIER_TEMPLATE = (
    "Generate a user dossier based on the chat history of a single user. Please provide detailed "
    "information about the user's background, personal details, likes, dislikes, and personality "
    "profile. Analyze the text conversations to extract relevant facts about the user's life, "
    "preferences, and traits. Include any available data on their name, age, location, occupation, "
    "hobbies, favorite activities, favorite foods, and any other personal information. Additionally, "
    "provide insights into their personality, such as their temperament, emotional disposition, and "
    "communication style. Ensure that presents a comprehensive overview of the user's identity based "
    "on the chat history. Try to keep your response as concise as possible.\n"
    "    Examples: Likes: the color blue, neo-noir movies, hiking. \n"
    "              Personal: From England. Lives in Los Angles. Mid-thirties.\n"
    "    \n"
    "    (Start Chat History)\n"
    "    {chat_history}\n"
    "    (End Chat History)\n"
    "    Human: {human_input} \n"
    "    ")
DOSSIER_INPUT = "PLease create a primer on the user using the data provided"
PRIMER_CHECK_TEMPLATE = "User Primer: {primer}\nQuestion: {query}\nIs the primer useful in answering the question?"
MEMORY_PREFIX = "Human: "     # how the chunk appears as the one message in the memory buffer
SETTINGS = {  # kind: (temperature, max_tokens)
    "summary": (0.3, 1500),
    "profile": (0.6, 1500),
    "search": (0.6, 1500),
    "relevance": (None, None),
    "dossier": (0.1, None),
    "primer_check": (None, 1),
}
# ---- end of fixed values ----


def fill(template: str, **slots: Column) -> Column:
    """Template with Column values in its {slots}, as one concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(slots[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


def _rows(df: DataFrame, kind: str, prompt: Column, system: Column | None = None) -> DataFrame:
    temp, max_tokens = SETTINGS[kind]
    return df.select(
        F.col("request_id").cast("string").alias("request_id"), F.lit(kind).alias("kind"),
        F.col("chunk").cast("string").alias("chunk"),
        (system if system is not None else F.lit(None).cast("string")).alias("system"),
        prompt.alias("prompt"),
        F.lit(temp).cast("double").alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"))


def bisected_prompts(texts: DataFrame, kind: str, limit: int = ch.BISECT_LIMIT) -> DataFrame:
    """Summary (C-1) or profile (C-2) prompts: one per bisection leaf of each
    (request_id, text)."""
    template = {"summary": SUMMARY_TEMPLATE, "profile": PROFILE_TEMPLATE}[kind]
    leaves = ch.bisect_chunks(texts, ["request_id"], "text", limit)\
        .withColumnRenamed("path", "chunk")
    return _rows(leaves, kind, fill(template, text=F.col("piece")))


def prompts_from_leaves(leaves: DataFrame, kind: str) -> DataFrame:
    """Summary (C-1) or profile (C-2) prompts from bisection leaves
    (request_id, path, piece), e.g. of ``bisection.bisect_line_rows``."""
    template = {"summary": SUMMARY_TEMPLATE, "profile": PROFILE_TEMPLATE}[kind]
    return _rows(leaves.withColumnRenamed("path", "chunk"), kind,
                 fill(template, text=F.col("piece")))


def search_prompts(docs: DataFrame, limit: int = ch.BISECT_LIMIT) -> DataFrame:
    """Answer-from-search prompts (C-3 over ``results_text``; D4: the long
    branch bisects the results text) and the relevance check messages (C-4
    over the block ``text``).

    Both kinds come from one pass over each search document: the bisection
    leaves and the relevance request are built in the same row and exploded
    together, so the search behind ``docs`` runs once.
    """
    ship_package(docs.sparkSession)
    leaves = ch.bisect_udf(F.col("results_text"), F.lit(limit))
    answers = F.transform(leaves, lambda l: F.struct(
        F.lit("search").alias("kind"), l["path"].alias("chunk"),
        F.lit(None).cast("string").alias("system"),
        fill(SEARCH_TEMPLATE, query=F.col("query"), text=l["piece"]).alias("prompt")))
    check = F.array(F.struct(
        F.lit("relevance").alias("kind"), F.lit("").alias("chunk"),
        F.lit(RELEVANCE_SYSTEM).alias("system"),
        fill(RELEVANCE_TEMPLATE, query=F.col("query"), text=F.col("text")).alias("prompt")))
    rows = docs.select("request_id", F.explode(F.concat(answers, check)).alias("r"))
    settings = F.create_map(*[x for kind, (t, m) in SETTINGS.items()
                              for x in (F.lit(kind), F.struct(F.lit(t).cast("double").alias("t"),
                                                              F.lit(m).cast("int").alias("m")))])
    return rows.select(
        F.col("request_id").cast("string").alias("request_id"), F.col("r.kind").alias("kind"),
        F.col("r.chunk").alias("chunk"), F.col("r.system").alias("system"),
        F.col("r.prompt").alias("prompt"),
        settings[F.col("r.kind")]["t"].alias("temperature"),
        settings[F.col("r.kind")]["m"].alias("max_tokens"))


def dossier_prompts(histories: DataFrame, max_tokens: int = ch.PACK_LIMIT) -> DataFrame:
    """One dossier prompt per packed chunk of each history text (C-5)."""
    packed = ch.pack_lines(histories, ["request_id"], "text", max_tokens)
    return dossier_from_chunks(packed)


def dossier_from_chunks(packed: DataFrame) -> DataFrame:
    """Dossier prompts (C-5) from packed chunks (request_id, chunk_no, chunk),
    e.g. the output of ``packing.pack_line_rows`` over a user's history."""
    p = packed.withColumnRenamed("chunk", "piece").withColumnRenamed("chunk_no", "chunk")
    prompt = fill(DOSSIER_TEMPLATE, chat_history=F.concat(F.lit(MEMORY_PREFIX), F.col("piece")),
                  human_input=F.lit(DOSSIER_INPUT))
    return _rows(p, "dossier", prompt)


def primer_check_prompts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """The yes/no question whether a user's primer helps with a question (CMD-7),
    one prompt for each (request_id, user_name, question). The primer is that of
    the name's first row by id, as in every lookup; without one there is no prompt."""
    primers = users.groupBy("user_name").agg(F.min_by("primer", F.col("id")).alias("primer"))
    asked = requests.join(primers.where("primer IS NOT NULL"), "user_name").withColumn("chunk", F.lit(""))
    return _rows(asked, "primer_check", fill(PRIMER_CHECK_TEMPLATE, primer=F.col("primer"), query=F.col("question")))
