import itertools
import math

import numpy as np
import pytest

from cohortspark.operators.kernel import FLOW_SCALE, FLOW_UNMATCHED, Rules, allocate, assign, categorise, nearest_first


def rows_of(matrix, k=None):
    """Candidate lists of a distance matrix, each in order of (distance, column)."""
    out = []
    for row in matrix:
        order = sorted((d, j) for j, d in enumerate(row) if math.isfinite(d))[:k]
        out.append((np.array([j for _, j in order], int), np.array([d for d, _ in order])))
    return out


def picked(rows, chosen):
    return {(i, int(rows[i][0][at])): rows[i][1][at] for i, x in enumerate(chosen) for at, _ in x}


EXAMPLE = [[0.10, 0.20, 0.30, 0.90], [0.10, 0.80, 0.25, 0.90], [0.50, 0.10, 0.60, 0.32]]


def test_worked_example():
    rows = rows_of(EXAMPLE)
    chosen, cats = allocate(rows, 4, Rules(0.35))
    assert picked(rows, chosen) == {(0, 1): 0.20, (1, 0): 0.10, (2, 3): 0.32}
    assert [list(rows[i][0][cats.competitive[i]]) for i in range(3)] == [[0, 1, 2], [0, 2], [1]]
    assert [list(rows[i][0][cats.safe[i]]) for i in range(3)] == [[], [], [3]]


def test_worked_example_without_the_greedy_phase():
    rows = rows_of(EXAMPLE)
    got = picked(rows, allocate(rows, 4, Rules(0.35, competitive=False))[0])
    assert set(got) == {(0, 0), (1, 2), (2, 1)} and sum(got.values()) == pytest.approx(0.45)


def test_worked_example_two_neighbours():
    rows = rows_of(EXAMPLE)
    got = picked(rows, allocate(rows, 4, Rules(0.35, n_neighbors=2, safe_matches=2))[0])
    assert set(got) == {(2, 3), (1, 0), (0, 1), (0, 2)}


def test_flow_objective_may_leave_a_row_out():
    """Rerouting costs more than one unmatched place on the integer scale, but not in the assignment."""
    rows = rows_of([[0.0, 1.0], [1.0, math.inf]])
    wide = Rules(1.0, safe_matches=2, competitive=False)
    assert set(picked(rows, allocate(rows, 2, wide)[0])) == {(0, 1), (1, 0)}
    assert set(picked(rows, allocate(rows, 2, Rules(1.0, safe_matches=2, competitive=False, flow=True, largest=1.0))[0])) == {(0, 0)}


def best_total(cost, places, unmatched):
    """The least total cost over all ways to fill the places, by enumeration."""
    of = [i for i, n in enumerate(places) for _ in range(n)]
    m = cost.shape[1]
    return min((sum(unmatched if c >= m else cost[i, c] for i, c in zip(of, p)) for p in itertools.permutations(range(m + len(of)), len(of))), default=0.0)


def lists_of(cost):
    return [(np.flatnonzero(np.isfinite(r)), r[np.isfinite(r)]) for r in cost]


def test_assignment_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n, m = rng.integers(1, 4), rng.integers(1, 4)
        places = [1] * n if rng.random() < 0.6 else rng.integers(0, 3, n).tolist()
        if sum(places) > 4:
            places = [1] * n
        cost = np.round(rng.random((n, m)) * 4) / 4
        cost[rng.random((n, m)) < 0.3] = np.inf
        unmatched = float(rng.choice([0.3, 100.0]))
        got = assign(lists_of(cost), places, m, unmatched)
        used = [c for row in got for c in row]
        assert len(used) == len(set(used)) and all(len(row) <= k for row, k in zip(got, places))
        assert sum(cost[i, c] for i, row in enumerate(got) for c in row) + unmatched * (sum(places) - len(used)) == pytest.approx(best_total(cost, places, unmatched))


def test_assignment_with_capacities_costs_what_copies_cost():
    """A row with n places is n copies of it."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = rng.integers(1, 15, 2)
        cost = np.where(rng.random((n, m)) < 0.4, rng.integers(0, 40, (n, m)).astype(float), np.inf)
        places = rng.integers(0, 4, n).tolist()
        lists = lists_of(cost)
        copies = [i for i, k in enumerate(places) for _ in range(k)]
        for unmatched in (10.0, 5000.0):
            total = lambda rows, of: sum(cost[i, c] for i, row in zip(of, rows) for c in row) + unmatched * (sum(places) - sum(map(len, rows)))
            assert total(assign(lists, places, m, unmatched), range(n)) == total(assign([lists[i] for i in copies], [1] * len(copies), m, unmatched), copies)


def greedy_by_rescan(rows, cats, rules):
    """The greedy phase restated: all limited rows are looked at anew before every match."""
    limited = [i for i in range(len(rows)) if len(cats.safe[i]) < rules.safe_matches]
    got = {i: [(at, "safe") for at in cats.safe[i][: rules.n_neighbors]] for i in limited}
    taken = {int(rows[i][0][at]) for i in limited for at, _ in got[i]}
    while True:
        left = {i: [[at for at in of[i] if int(rows[i][0][at]) not in taken] for of in (cats.competitive, cats.fuzzy)] for i in limited if len(got[i]) < rules.n_neighbors}
        ready = [(len(got[i]), len(k), len(f), i) for i, (k, f) in left.items() if k or f]
        if not ready:
            return got
        i = min(ready)[-1]
        k, f = left[i]
        got[i].append((k[0], "competitive") if k else (f[0], "fuzzy"))
        taken.add(int(rows[i][0][got[i][-1][0]]))


def test_greedy_heap_picks_what_a_rescan_picks():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n, m = rng.integers(1, 9), rng.integers(1, 12)
        d = np.round(rng.random((n, m)) * 8) / 8
        rules = Rules(0.5, int(rng.integers(1, 4)), int(rng.integers(1, 4)), 0.75 if rng.random() < 0.5 else None, True, False)
        rows = rows_of(np.where(d <= (rules.fuzzy_limit or rules.threshold), d, np.inf))
        chosen, cats = allocate(rows, m, rules)
        want = greedy_by_rescan(rows, cats, rules)
        assert [x for x in chosen] == [want.get(i, []) for i in range(n)]


def literal_categories(rows, n, rules):
    """The horizon rule restated without bookkeeping: everything counted anew each round."""
    h = [min(1, len(c)) for c, _ in rows]

    def users(c):
        return sum(any(rows[i][0][a] == c and rows[i][1][a] <= rules.threshold for a in range(h[i])) for i in range(len(rows)))

    while True:
        safe = [sum(rows[i][1][a] <= rules.threshold and users(rows[i][0][a]) == 1 for a in range(h[i])) for i in range(len(rows))]
        grow = [i for i in range(len(rows)) if safe[i] < rules.safe_matches and 0 < h[i] < len(rows[i][0])]
        if not grow:
            break
        for i in grow:
            h[i] += 1
    out = []
    for i, (c, d) in enumerate(rows):
        s, k, f = [], [], []
        for a in range(h[i]):
            if d[a] <= rules.threshold and users(c[a]) == 1:
                s.append(a)
                if len(s) == rules.safe_matches:
                    break
            elif d[a] <= rules.threshold:
                k.append(a)
            elif rules.fuzzy_limit is not None and d[a] <= rules.fuzzy_limit:
                f.append(a)
            else:
                break
        out.append((s, k, f))
    return out


def test_categories_and_invariants():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n, m = rng.integers(1, 7), rng.integers(1, 8)
        d = np.round(rng.random((n, m)) * 8) / 8
        rules = Rules(0.5, int(rng.integers(1, 4)), int(rng.integers(1, 4)), 0.75 if rng.random() < 0.5 else None, bool(rng.random() < 0.8), bool(rng.random() < 0.8))
        limit = rules.fuzzy_limit or rules.threshold
        rows = rows_of(np.where(d <= limit, d, np.inf))
        chosen, cats = allocate(rows, m, rules)
        assert list(zip(cats.safe, cats.competitive, cats.fuzzy)) == literal_categories(rows, m, rules)
        controls = [int(rows[i][0][at]) for i, x in enumerate(chosen) for at, _ in x]
        assert len(controls) == len(set(controls))
        assert all(len(x) <= rules.n_neighbors for x in chosen)
        assert all(rows[i][1][at] <= (limit if phase == "fuzzy" else rules.threshold) for i, x in enumerate(chosen) for at, phase in x)


def test_empty_and_unmatchable():
    assert allocate([], 0, Rules(1.0))[0] == []
    rows = [(np.zeros(0, int), np.zeros(0))]
    assert allocate(rows, 3, Rules(1.0))[0] == [[]]
    assert categorise(rows, 3, Rules(1.0)).horizon.tolist() == [0]


def test_greedy_takes_the_nearest_free():
    rows = rows_of([[0.1, 0.2], [0.1, 0.9]])
    assert nearest_first(rows, 2, 0.5) == [[0], []]
    assert nearest_first(rows, 2, 1.0) == [[0], [1]]


def test_flow_constants():
    assert FLOW_SCALE == 1_000_000 and FLOW_UNMATCHED == 10_000


def test_rows_at_equal_cost_leave_a_control_to_the_first():
    """The price of an empty place has no part in the sums: it rounded costs, and a later row at the same cost could take the control."""
    rng = np.random.default_rng(4)
    for d in rng.random(200):
        held = assign([(np.array([0]), np.array([d]))] * 6, [1] * 6, 1)
        assert held == [[0], [], [], [], [], []]


def test_as_many_places_as_can_be_filled_then_least_cost():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, m = rng.integers(1, 5), rng.integers(1, 5)
        cost = np.where(rng.random((n, m)) < 0.6, rng.random((n, m)), math.inf)
        lists, places = lists_of(cost), rng.integers(1, 3, n).tolist()
        got = assign(lists, places, m)
        found = [c for x in got for c in x]
        assert len(set(found)) == len(found) and all(len(x) <= p for x, p in zip(got, places))
        total = sum(100.0 if len(x) <= j else cost[i, x[j]] for i, x in enumerate(got) for j in range(places[i]))
        assert total == pytest.approx(best_total(cost, places, 100.0))


@pytest.mark.parametrize("n_neighbors", [1, 2, 3])
def test_greedy_over_classes_is_greedy_over_rows(n_neighbors):
    """Rows with the same list as one class: the same matches in the same phases as row by row."""
    from cohortspark.operators.kernel import greedy_classes

    rng = np.random.default_rng(n_neighbors)
    rules = Rules(0.6, n_neighbors=n_neighbors, safe_matches=n_neighbors, fuzzy_limit=0.8, global_optimal=False)
    for _ in range(80):
        few, m = rng.integers(2, 6), rng.integers(3, 14)
        matrix = np.where(rng.random((few, m)) < 0.7, np.round(rng.random((few, m)), 1), math.inf)
        of = np.sort(rng.integers(0, few, rng.integers(few, 12)))
        rng.shuffle(of)
        rows = rows_of(matrix[of])
        chosen, cats = allocate(rows, m, rules)
        limited = [i for i in range(len(of)) if len(cats.safe[i]) < n_neighbors and cats.horizon[i]]
        want = {(i, int(rows[i][0][at]), phase) for i in limited for at, phase in chosen[i]}
        heads = sorted({int(np.flatnonzero(of == of[i])[0]) for i in limited})
        start, controls, kinds, members = [0], [], [], []
        for i in heads:
            for at in range(len(rows[i][0])):
                for kind, x in enumerate((cats.safe, cats.competitive, cats.fuzzy)):
                    if at in x[i]:
                        controls.append(int(rows[i][0][at]))
                        kinds.append(kind)
            start.append(len(controls))
            members.append(np.flatnonzero(of == of[i]))
        got = greedy_classes(np.array(start), np.array(controls, int), np.array(kinds, int), m, members, n_neighbors)
        assert {(i, controls[e], ("safe", "competitive", "fuzzy")[kinds[e]]) for _, i, e in got} == want
