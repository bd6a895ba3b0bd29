"""Queries over the given tables, each with its SQL counterpart where there is one."""

from . import catalog, comments, content, feed, interactions, news, ratings, streams, tables
from .base import CHECKS

__all__ = ["CHECKS", "catalog", "comments", "content", "feed", "interactions", "news",
           "ratings", "streams", "tables"]
