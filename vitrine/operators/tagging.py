"""Product tagging through an injected client, one per partition."""

import itertools

import pandas as pd
from pyspark.sql import functions as F

from .. import schemas
from ..dims.texts import CATEGORY_WORDS, DEFAULT_CATEGORY
from ..functions.urls import proxy_image_url
from .calls import DEADLINE, FIRST_WAIT, TRIES, WIDTH, windowed
from .grouping import spread_rows


class KeywordTagger:
    """Offline client: category and colour by words of the text."""

    COLORS = ["black", "white", "red", "blue", "green"]

    def tag(self, image_url, description):
        text = description.lower()
        category, hits = DEFAULT_CATEGORY, []
        for name, words in CATEGORY_WORDS.items():
            found = [w for w in words if w in text]
            if found:
                category, hits = name, found
                break
        color = next((c for c in self.COLORS if c in text), None)
        return {
            "gender": None,
            "category": category,
            "sub_categories": hits,
            "color": color,
            "material": None,
        }


#: Results that a task hands on together.
GATHERED = 256


def _frame(found):
    """Results of calls as the rows of ``tag_results``."""
    errors = [None if e is None else f"{type(e).__name__}: {e}" for _, _, e in found]
    return pd.DataFrame(
        {
            "id": pd.Series([item[0] for item, _, _ in found], dtype="int64"),
            "tags": pd.Series([tags for _, tags, _ in found], dtype="object"),
            "error": pd.Series(errors, dtype="object"),
        }
    )


def tag_results(products, client_factory, image_base, tries=TRIES, first=FIRST_WAIT, width=WIDTH,
                deadline=DEADLINE, partitions=None):
    """(id, tags, error) from a client's ``tag(image_url, description)``.

    Products without a thumbnail or text are not sent. The client is made once per
    partition and has up to ``width`` calls to answer at once, each within ``deadline``
    seconds (``windowed``). A failed call is repeated; one that fails to the end gives a
    row with the error and without tags. Rows come in the order of the answers.
    ``partitions`` deals the products out to so many tasks before, each with a client.
    """

    def run(batches):
        client = client_factory()
        items = (
            item for batch in batches
            for item in zip(batch["id"], batch["image_url"], batch["description"], strict=True)
        )
        answers = windowed(items, lambda i: client.tag(i[1], i[2]), width, deadline, tries, first)
        while found := list(itertools.islice(answers, GATHERED)):
            yield _frame(found)

    sent = products.where(
        F.col("thumbnail").isNotNull() & F.col("product_details").isNotNull()
    ).select(
        F.col("id").cast("bigint").alias("id"),
        proxy_image_url(image_base, "thumbnail").alias("image_url"),
        F.col("product_details").alias("description"),
    )
    return spread_rows(sent, partitions).mapInPandas(run, f"{schemas.TAGGED_PRODUCT}, error STRING")


def tag_products(products, client_factory, image_base, tries=TRIES, first=FIRST_WAIT, partitions=None):
    """(id, tags) of the products whose call succeeded."""
    results = tag_results(products, client_factory, image_base, tries, first, partitions=partitions)
    return results.where(F.col("error").isNull()).select("id", "tags")
