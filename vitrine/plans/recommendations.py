"""Interaction log to a versioned model and the recommendations of all users."""

from ..operators.factors import top_items
from ..operators.interactions import (
    fill_interaction_nulls,
    interactions_to_ratings,
    valid_interactions,
)
from ..operators.ratings import (
    BATCH_PARAMS,
    flatten_recs,
    id_maps,
    rmse_value,
    score,
    split_ratings,
    train_als,
    with_ids,
    with_indices,
)
from ..sources.models import load_ids, load_model, save_model
from ..sources.versions import publish


#: Part of the error by which a model must be better: sums in another order differ by less.
LEAST_GAIN = 1e-9


def champion_challenger(spark, model, ratings, path, ids=None):
    """Save the model if it beats the stored one on ``ratings``; returns both errors.

    Without a stored model the new one is saved. A model that predicts nothing is
    not better, nor is one whose error differs by no more than LEAST_GAIN of the stored
    model's. Ratings have their own ids; each model is asked by its own indices.
    """
    champion = load_model(spark, path)
    known = None if champion is None else with_indices(ratings, load_ids(spark, path))
    old = None if champion is None else rmse_value(score(champion, known))
    new = rmse_value(score(model, with_indices(ratings, ids)))
    better = new is not None and (old is None or new < old * (1 - LEAST_GAIN))
    version = save_model(spark, model, path, new, ids) if better else None
    return {"old": old, "new": new, "version": version}


def train_job(spark, interactions, path, params=None, id_column="id"):
    """Train on four fifths of the ratings, keep the better model on all of them.

    Ids beyond 32 bits are numbered for the training; the maps are stored with the model.
    """
    clean = valid_interactions(fill_interaction_nulls(interactions))
    ratings = interactions_to_ratings(clean, keep=(id_column,)).persist()
    try:
        training, test = split_ratings(ratings)
        ids = id_maps(ratings)
        model = train_als(with_indices(training.drop(id_column), ids), params or BATCH_PARAMS)
        outcome = champion_challenger(spark, model, ratings, path, ids)
        outcome["test_rmse"] = rmse_value(score(model, with_indices(test, ids)))
    finally:
        ratings.unpersist()
    return outcome


def recommendations_job(spark, path, out, n=20):
    """Top ``n`` products of every user as a table; nothing without a model.

    Each run writes a folder of its own, which readers see once it is complete.
    """
    model = load_model(spark, path)
    if model is None:
        return None
    recs, _ = top_items(model.userFactors, model.itemFactors, n)
    flat = flatten_recs(recs)
    return publish(with_ids(flat, load_ids(spark, path)), out)
