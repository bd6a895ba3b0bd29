"""Comments to stored replies."""

from ..operators.comments import (
    choose_links,
    comment_row,
    drop_seen_comments,
    drop_self_comments,
)


def answer_comments(comments, videos, history, handle, base_url, seed=0):
    """New foreign comments with link and reply, as pending rows."""
    fresh = drop_seen_comments(drop_self_comments(comments, handle), history)
    return comment_row(choose_links(fresh, videos, base_url), seed)
