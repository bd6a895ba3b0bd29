"""Sign-up stream to zero-rating seeds."""

from ..operators.ratings import seed_users, to_json_rows


def run_signup_seed_stream(users, path, checkpoint, once=False):
    """One JSON seed per new user; the seed stands for every product."""
    writer = (
        to_json_rows(seed_users(users))
        .writeStream.format("text")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
