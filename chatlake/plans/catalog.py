"""Imports every query module so the registry is complete."""

from chatlake.plans import (  # noqa: F401
    command_queries, digest_queries, history_queries, prompt_queries, store_queries, stream_queries,
    text_queries, vector_queries)
from chatlake.plans.registry import ORACLE, QUERIES  # noqa: F401
