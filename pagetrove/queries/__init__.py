"""Queries over the given tables, one module per area."""

from importlib import import_module

AREAS = ["url_queries", "ledger_queries", "text_queries", "tag_queries", "page_queries", "recipe_queries",
         "post_queries", "offsite_queries", "model_queries", "note_queries", "queue_queries"]


def load_all():
    for area in AREAS:
        import_module(f"pagetrove.queries.{area}")
