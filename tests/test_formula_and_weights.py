import pytest

from cohortspark.functions.formula import FormulaParseError, parse_formula, term_to_str
from cohortspark.functions.naming import feature_maps
from cohortspark.functions.weights import resolve_weights, weights_by_kind
from cohortspark.sources.synth import random_weights


@pytest.mark.parametrize("text, terms", [
    ("a", ["a"]), ("a + b", ["a", "b"]), ("a*b", ["a", "b", "a:b"]), ("(a + b):c", ["a:c", "b:c"]), ("a + a", ["a"]), ("a*b:c", ["a", "b:c", "a:b:c"]), ("a*b*c", ["a", "b", "a:b", "c", "a:c", "b:c", "a:b:c"]),
])
def test_formula(text, terms):
    assert [term_to_str(t) for t in parse_formula(text)] == terms


@pytest.mark.parametrize("text", ["", "a +", "(a", "a b", "a ~ b", ")", "a + + b"])
def test_bad_formula(text):
    with pytest.raises(FormulaParseError):
        parse_formula(text)


def test_feature_maps_take_the_longest_owner():
    up, down = feature_maps(["log(x)", "binned(y)", "d_days", "c_d_v", "c_w"], ["x", "y"], ["c", "c_d"], ["d"])
    assert up == {"log(x)": "x", "binned(y)": "y", "d_days": "d", "c_d_v": "c_d", "c_w": "c"}
    assert down["c_d"] == ["c_d_v"]


def test_weights():
    columns, parents = ["x", "c_a", "c_b"], {"c_a": "c", "c_b": "c"}
    assert resolve_weights(None, columns, parents, ["c"]) == [1, 1, 1]
    assert resolve_weights({"x": 2, "c": 3}, columns, parents, ["c"]) == [2, 3, 3]
    assert resolve_weights({"c": {"a": 0.5}}, columns, parents, ["c"]) == [1, 0.5, 1]
    assert resolve_weights({"c": {"c_b": 4}}, columns, parents, ["c"]) == [1, 1, 4]
    assert resolve_weights([1, 2, 3], columns, parents, ["c"]) == [1, 2, 3]
    assert weights_by_kind(["x"], ["c"], 1, 2) == {"x": 1, "c": 2}


@pytest.mark.parametrize("weights", [[1, 2], "abc", 5, {"q": 1}, {"x": {"a": 1}}, {"c": {"a": {"b": 1}}}, {"c": {"zz": 1}}, {"x": "heavy"}, {"x": -1}, {"x": float("nan")}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        resolve_weights(weights, ["x", "c_a", "c_b"], {"c_a": "c", "c_b": "c"}, ["c"])


def test_random_weights_add_up():
    for seed in range(20):
        w = random_weights(7, seed, 0.02)
        assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0.02 - 1e-9
