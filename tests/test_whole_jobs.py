"""Registered queries ask for the whole job that a run does, not for a part of it."""

import inspect

import pytest

from assayloom import queries_models
from assayloom.catalogue import QUERIES
from assayloom.config import Settings
from assayloom.operators import ranking
from assayloom.operators.forest import boost

from .conftest import SF


class Asked(Exception):
    pass


def asked(monkeypatch, spark, name, operator):
    """The arguments that the query gives its operator, defaults included."""
    found, plain = {}, inspect.signature(getattr(ranking, operator))

    def stop(*args, **how):
        own = plain.bind(*args, **how)
        own.apply_defaults()
        found.update(own.arguments)
        raise Asked

    monkeypatch.setattr(queries_models.ranking, operator, stop)
    with pytest.raises(Asked):
        QUERIES[name](spark, SF)
    return found


@pytest.mark.parametrize("name", ["rfe_curve", "rfe_selected"])
def test_elimination_is_whole(spark, monkeypatch, name):
    got = asked(monkeypatch, spark, name, "elimination")
    assert got["splits"] == Settings().feature_selection.multisurf_cross_validation_splits and got["most"] == 40
    assert got["params"].get("trees", inspect.signature(boost).parameters["trees"].default) == 200


def test_search_is_whole(spark, monkeypatch):
    got, whole = asked(monkeypatch, spark, "search_trials", "search"), Settings()
    assert got["trials"] == whole.optimization.optuna.trials
    assert (got["k"], got["repeats"]) == (whole.feature_selection.cross_validation_splits, whole.feature_selection.cross_validation_repeats)
