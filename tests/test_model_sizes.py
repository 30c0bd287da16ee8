import pytest

from nullwise.operators import binning
from nullwise.plans import q_models
from nullwise.plans.registry import QUERIES

NAMES = [f"f{i}" for i in range(40)]
WANT = {
    "fit_adaboost": ("fit_adaboost", ("train", "label", 300, 0.05), {}),
    "fit_adaboost_shares": ("fit_adaboost", ("train", "label", 100, 1.0), {"probability": True}),
    "fit_hist_boosted": ("hist_boosted", ("train", "label", 100, 0.1), {}),
    "fit_hist_boosted_l2": ("hist_boosted", ("train", "label", 200, 0.05, 5, 0.1), {}),
    "fit_extra_trees": ("fit_extra_trees", ("train", "label", 300), {}),
    "fit_stack_linear": ("stack_linear", ("train", "label", 200), {}),
    "fit_stack_refine": ("stack_refine", ("train", "label", 200), {}),
    "fit_neural_forest": ("neural_forest", ("train", "label", 40, 200), {"hidden": (64, 64)}),
    "fit_boosted_multi": ("boosted", ("train", "label", 100, 0.1, 3), {}),
}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", WANT)
def test_queries_run_the_sizes_of_the_survey(name, monkeypatch):
    def called(*args, **kwargs):
        raise Called(args, kwargs)

    monkeypatch.setattr(q_models, "prepared", lambda *a, **k: ("train", "test", NAMES))
    monkeypatch.setattr(q_models.L, WANT[name][0], called)
    with pytest.raises(Called) as seen:
        QUERIES[name](None, None)
    assert seen.value.args == WANT[name][1:]


def test_many_rows_are_dealt_evenly(spark, monkeypatch):
    """The split ranks a class in one task; the fits must not read the rows as that left them."""
    monkeypatch.setattr(binning, "ROWS_PER_TASK", 300)
    train, _, _ = q_models.prepared(spark, "/root/testdata/sf0.001")
    sizes = train.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 4 and max(sizes) < 1.5 * sum(sizes) / len(sizes)
