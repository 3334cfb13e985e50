"""Model queries run their operators with the operators' own sizes."""

import inspect
from unittest.mock import MagicMock

import pytest

from tablewright.catalog import QUERIES
from tablewright.catalog import models as C
from tablewright.plans import models as M

#: What fits in each query, and the arguments that make it smaller.
FITS = {
    "rf_fit": (M, "fit_and_score"),
    "gbt_fit": (M, "fit_and_score"),
    "extra_trees_fit": (M, "fit_and_score"),
    "leaderboard": (C, "run_regression_cv"),
    "classifier_fit": (M, "train_classifier"),
    "balanced_forest_fit": (M, "fit_balanced_forest"),
    "classification_cv": (C, "run_classification_cv"),
    "robustness_shift_trees": (M, "fit_pipeline"),
    "train_until_ready": (C, "train_until_ready"),
    "train_until_given_up": (C, "train_until_ready"),
    "gbt_early_stop": (M, "fit_boosting_with_stop"),
    "capacity_sweep": (M, "capacity_sweep"),
}
SIZES = ("settings", "folds", "max_feedback", "rounds", "depth", "rate", "patience", "trees")


class Called(Exception):
    pass


@pytest.mark.parametrize("name", FITS)
def test_full_sizes(monkeypatch, name):
    place, function = FITS[name]
    signature = inspect.signature(getattr(place, function))

    def record(*args, **kwargs):
        raise Called(signature.bind(*args, **kwargs))

    for helper in ("_model_table", "_class_table", "_regression_vectors", "view", "table", "scratch_table", "holdout_split", "F"):
        monkeypatch.setattr(C, helper, MagicMock())
    monkeypatch.setattr(M, "with_class_weight", MagicMock())
    monkeypatch.setattr(place, function, record)
    with pytest.raises(Called) as called:
        QUERIES[name](MagicMock(), "")
    bound = called.value.args[0]
    for size in SIZES:
        if size in bound.arguments:
            assert bound.arguments[size] == signature.parameters[size].default, size
