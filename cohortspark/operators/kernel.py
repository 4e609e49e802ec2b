"""Allocation within one connected component of the horizon graph, in NumPy.

Rows are exposed subjects, columns controls.  Every row has its candidate edges
in order of (distance, control).  Steps: horizons grow until a row has its safe
controls; edges in the final horizons are safe, competitive or fuzzy; a greedy
phase serves the rows short of safe controls, always the worst-off first; an
assignment of least cost serves the rest.

Growing is monotone: what a row needs is never less when other rows have grown
further.  So the final horizons are the least ones that leave nobody growing,
whatever the order in which rows grow, and ``operators.allocate`` can grow them
in shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Scale of the integer costs of the flow objective, and what an unmatched place costs beyond the dearest edge.
FLOW_SCALE, FLOW_UNMATCHED = 1_000_000, 10_000


@dataclass(frozen=True)
class Rules:
    threshold: float
    n_neighbors: int = 1
    safe_matches: int = 1
    fuzzy_limit: float | None = None
    competitive: bool = True
    global_optimal: bool = True
    flow: bool = False
    largest: float = 1.0
    k: int | None = None


@dataclass
class Categories:
    safe: list[list[int]]
    competitive: list[list[int]]
    fuzzy: list[list[int]]
    horizon: np.ndarray


def horizons(rows: list[tuple[np.ndarray, np.ndarray]], n_controls: int, rules: Rules, users: np.ndarray | None = None, needs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(horizon of each row, users of each control): rows short of safe edges take their next edge, all at once, until nothing can grow.

    ``users``: how many outside rows hold each control already; ``needs``: how many safe edges each row is short of.
    """
    horizon = np.zeros(len(rows), np.int64)
    users = np.zeros(n_controls, np.int64) if users is None else users.copy()
    needs = np.full(len(rows), rules.safe_matches) if needs is None else needs
    owner = np.full(n_controls, -1)
    safe = np.zeros(len(rows), np.int64)
    most = [len(c) if rules.k is None else min(len(c), rules.k) for c, _ in rows]
    growing = [i for i, (c, _) in enumerate(rows) if most[i]]
    while growing:
        hit = []
        for i in growing:
            c, d = rows[i][0][horizon[i]], rows[i][1][horizon[i]]
            horizon[i] += 1
            if d > rules.threshold:
                continue
            users[c] += 1
            if users[c] == 1:
                owner[c] = i
                safe[i] += 1
            elif users[c] == 2 and owner[c] >= 0:
                safe[owner[c]] -= 1
                hit.append(int(owner[c]))
        growing = [i for i in sorted({*growing, *hit}) if safe[i] < needs[i] and 0 < horizon[i] < most[i]]
    return horizon, users


def horizons_flat(start: np.ndarray, controls: np.ndarray, inside: np.ndarray, users: np.ndarray, needs: int) -> np.ndarray:
    """``horizons`` over flat edges, all growing rows taking their next edge in one step: row i has the edges ``start[i]:start[i + 1]`` to ``controls``, ``inside`` the threshold or not.

    ``users``, how many outside rows hold each control, is counted on in place.
    """
    n = len(start) - 1
    most = np.diff(start)
    horizon, safe = np.zeros(n, np.int64), np.zeros(n, np.int64)
    owner = np.full(len(users), -1, np.int64)
    growing = np.flatnonzero(most > 0)
    while len(growing):
        e = start[growing] + horizon[growing]
        horizon[growing] += 1
        near = inside[e]
        who, c = growing[near], controls[e[near]]
        np.add.at(users, c, 1)
        alone = users[c] == 1
        owner[c[alone]] = who[alone]
        safe[who[alone]] += 1
        lost = np.unique(c[~alone])
        hit = owner[lost]
        owner[lost] = -1
        hit = hit[hit >= 0]
        if len(hit):
            np.subtract.at(safe, hit, 1)
            growing = np.union1d(growing, hit)
        growing = growing[(safe[growing] < needs) & (horizon[growing] < most[growing])]
    return horizon


def categorise(rows, n_controls: int, rules: Rules) -> Categories:
    horizon, users = horizons(rows, n_controls, rules)
    out = Categories([[] for _ in rows], [[] for _ in rows], [[] for _ in rows], horizon)
    for i, (controls, distances) in enumerate(rows):
        for at in range(horizon[i]):
            c, d = int(controls[at]), distances[at]
            if d <= rules.threshold:
                if users[c] > 1:
                    out.competitive[i].append(at)
                    continue
                out.safe[i].append(at)
                if len(out.safe[i]) >= rules.safe_matches:
                    break
            elif rules.fuzzy_limit is not None and d <= rules.fuzzy_limit:
                out.fuzzy[i].append(at)
            else:
                break
    return out


def _greedy(rows, cats: Categories, rules: Rules, taken: np.ndarray, chosen: list[list[tuple[int, str]]]) -> None:
    """Serve the limited rows: their safe controls first, then one match at a time for the row with the fewest matches, competitive and fuzzy options.

    Rows wait in a heap under (matches, competitive, fuzzy, row).  A row whose
    options change enters anew; the old entry is passed over when it comes up.
    """
    limited = [i for i in range(len(rows)) if len(cats.safe[i]) < rules.safe_matches]
    for i in limited:
        for at in cats.safe[i][: rules.n_neighbors]:
            chosen[i].append((at, "safe"))
            taken[rows[i][0][at]] = True
    lists = {"competitive": cats.competitive, "fuzzy": cats.fuzzy}
    wanting: dict[int, list[tuple[str, int]]] = {}
    left = {kind: dict.fromkeys(limited, 0) for kind in lists}
    upto = {kind: dict.fromkeys(limited, 0) for kind in lists}  # how far the list is known to be taken
    for kind, of in lists.items():
        for i in limited:
            for at in of[i]:
                if not taken[c := int(rows[i][0][at])]:
                    left[kind][i] += 1
                    wanting.setdefault(c, []).append((kind, i))
    key = lambda i: (len(chosen[i]), left["competitive"][i], left["fuzzy"][i], i)
    waits = lambda i: len(chosen[i]) < rules.n_neighbors and (left["competitive"][i] or left["fuzzy"][i])
    heap = [key(i) for i in limited if waits(i)]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry[-1]
        if not waits(i) or entry != key(i):
            continue
        kind = "competitive" if left["competitive"][i] else "fuzzy"
        of, k = lists[kind][i], upto[kind][i]
        while taken[rows[i][0][of[k]]]:
            k += 1
        upto[kind][i] = k
        c = int(rows[i][0][of[k]])
        chosen[i].append((of[k], kind))
        taken[c] = True
        for other, j in wanting[c]:
            left[other][j] -= 1
        for j in {i, *(j for _, j in wanting[c])}:
            if waits(j):
                heapq.heappush(heap, key(j))


#: Key of a class of rows that waits no more; what one match and one competitive option weigh in a key.
_DONE, _MATCH, _OPTION = np.iinfo(np.int64).max, 1 << 50, 1 << 25


def greedy_classes(start: np.ndarray, controls: np.ndarray, kinds: np.ndarray, n_controls: int, members: list[np.ndarray], n_neighbors: int) -> list[tuple[int, int, int]]:
    """The greedy phase where rows with the same list are one class: (class, member's id, edge) of each match.

    Class ``c`` has the edges ``start[c]:start[c + 1]`` in order, to ``controls``, of ``kinds`` 0 safe, 1 competitive, 2 fuzzy, and its ``members``' ids in order.
    Of rows with the same list the same options are left, so what stands between them is how many matches they have, then their id.
    """
    n = len(members)
    of = np.repeat(np.arange(n), np.diff(start))
    taken = np.zeros(n_controls, bool)
    out: list[tuple[int, int, int]] = []
    queues = []
    for c in range(n):
        got = 0
        for e in start[c] + np.flatnonzero(kinds[start[c] : start[c + 1]] == 0)[:n_neighbors]:  # only a row that is alone has any
            out.append((c, int(members[c][0]), int(e)))
            taken[controls[e]] = True
            got += 1
        queues.append([(got, int(i)) for i in members[c]])
    optional = np.flatnonzero((kinds > 0) & ~taken[controls])
    lists = [[np.zeros(0, int)] * n, [np.zeros(0, int)] * n]
    for kind in (1, 2):
        some = optional[kinds[optional] == kind]
        lists[kind - 1] = np.split(some, np.searchsorted(of[some], np.arange(1, n)))
    by_control = optional[np.argsort(controls[optional], kind="stable")]
    first = np.searchsorted(controls[by_control], np.arange(n_controls + 1))
    weight = np.where(kinds == 1, _OPTION, 1)
    left = np.zeros(n, np.int64)
    np.add.at(left, of[optional], weight[optional])
    upto = [[0] * n, [0] * n]
    at = [0] * n  # the next member of each class, in its queue
    matches = np.array([x[0][0] for x in queues], np.int64)
    ids = np.array([x[0][1] for x in queues])
    key = np.where((left > 0) & (matches < n_neighbors), matches * _MATCH + left, _DONE)
    while n:
        least = key.min()
        if least == _DONE:
            break
        same = np.flatnonzero(key == least)
        c = int(same[ids[same].argmin()])
        kind = 0 if left[c] >= _OPTION else 1
        options, k = lists[kind][c], upto[kind][c]
        while taken[controls[options[k]]]:
            k += 1
        upto[kind][c] = k
        e = int(options[k])
        out.append((c, int(ids[c]), e))
        control = controls[e]
        taken[control] = True
        queue = queues[c]
        got = queue[at[c]][0] + 1
        at[c] += 1
        if got < n_neighbors:  # behind those with fewer matches; those with as many came before
            queue.append((got, int(ids[c])))
        if at[c] < len(queue):
            matches[c], ids[c] = queue[at[c]]
            key[c] = matches[c] * _MATCH + left[c]
        else:
            key[c] = _DONE
        wanting = by_control[first[control] : first[control + 1]]
        who = of[wanting]
        left[who] -= weight[wanting]
        waits = who[key[who] != _DONE]
        key[waits] = np.where(left[waits] > 0, matches[waits] * _MATCH + left[waits], _DONE)
    return out


def assign(edges: list[tuple[np.ndarray, np.ndarray]], places: list[int], n_columns: int, unmatched: float | None = None) -> list[list[int]]:
    """Columns of each row at least total cost: row i takes up to ``places[i]`` columns of its (columns, costs), and every place left empty costs ``unmatched``.

    Without ``unmatched`` as many places as can be are filled, and then at least
    cost: no price large enough for that enters the sums, which would round the
    costs, so rows at equal cost keep what they hold and the first has it.

    A flow with capacities by successive shortest paths: for each place a heap
    search over reduced costs (a cost plus its start's potential less its end's)
    finds the cheapest way to a free column, or to a row that leaves a place
    empty; holders hand their columns on along the way.
    """
    held: list[dict[int, float]] = [{} for _ in edges]  # the columns of each row, with their costs
    holder = [-1] * n_columns
    of_row, of_column = [0.0] * len(edges), np.zeros(n_columns)
    for start in (i for i, n in enumerate(places) for _ in range(n)):
        row_at, column_at = {start: 0.0}, {}
        to_row: dict[int, int] = {}
        to_column: dict[int, tuple[int, float]] = {}
        heap = [(0.0, n_columns + start)]
        best, end_row, end_column = np.inf, -1, -1
        spare, spare_row = np.inf, -1  # who leaves a place empty, should no free column be within reach
        while heap and heap[0][0] < best:
            base, node = heapq.heappop(heap)
            if node < n_columns:
                if base > column_at[node]:
                    continue
                h = holder[node]
                back = max(base, base - held[h][node] + of_column[node] - of_row[h])
                if back < row_at.get(h, np.inf):
                    row_at[h], to_row[h] = back, node
                    heapq.heappush(heap, (back, n_columns + h))
                continue
            i = node - n_columns
            if base > row_at[i]:
                continue
            if unmatched is None:
                if base + of_row[i] < spare:
                    spare, spare_row = base + of_row[i], i
            elif base + unmatched + of_row[i] < best:
                best, end_row, end_column = base + unmatched + of_row[i], i, -1
            columns, costs = edges[i]
            reach = base + np.maximum(costs + of_row[i] - of_column[columns], 0.0)
            for k in np.flatnonzero(reach < best).tolist():
                c, d = int(columns[k]), float(reach[k])
                if d < best and d < column_at.get(c, np.inf) and c not in held[i]:
                    column_at[c], to_column[c] = d, (i, float(costs[k]))
                    if holder[c] < 0:
                        best, end_row, end_column = d, -1, c
                    else:
                        heapq.heappush(heap, (d, c))
        if end_row < 0 and end_column < 0:
            best, end_row = max(*row_at.values(), *column_at.values(), 0.0), spare_row
        for i, d in row_at.items():
            if d < best:
                of_row[i] += d - best
        for c, d in column_at.items():
            if d < best:
                of_column[c] += d - best
        c = end_column
        if c < 0:
            if end_row == start:
                continue
            c = to_row[end_row]
            del held[end_row][c]
        while True:
            i, cost = to_column[c]
            held[i][c] = cost
            holder[c] = i
            if i == start:
                break
            c = to_row[i]
            del held[i][c]
    return [sorted(h) for h in held]


def _optimal(rows, cats: Categories, rules: Rules, taken: np.ndarray, chosen: list[list[tuple[int, str]]], room: np.ndarray | None) -> None:
    room = [int(n) - len(chosen[i]) for i, n in enumerate(np.full(len(rows), rules.n_neighbors) if room is None else room)]
    short = [i for i in range(len(rows)) if room[i] > 0]
    open_ = {i: [at for at in sorted(cats.safe[i] + cats.competitive[i]) if not taken[rows[i][0][at]]] for i in short}
    short = [i for i in short if open_[i]]
    if not short:
        return
    columns = np.unique([rows[i][0][at] for i in short for at in open_[i]])
    edges = []
    for i in short:
        c, d = rows[i][0][open_[i]], rows[i][1][open_[i]]
        edges.append((np.searchsorted(columns, c), np.rint(d * FLOW_SCALE / rules.largest) if rules.flow else d))
    places = [min(room[i], len(open_[i])) for i in short]
    unmatched = FLOW_SCALE + FLOW_UNMATCHED if rules.flow else None
    for i, found in zip(short, assign(edges, places, len(columns), unmatched)):
        place_of = {int(rows[i][0][at]): at for at in open_[i]}
        for c in columns[found].tolist():
            chosen[i].append((place_of[c], "optimal"))
            taken[c] = True


def allocate(rows: list[tuple[np.ndarray, np.ndarray]], n_controls: int, rules: Rules, cats: Categories | None = None, room: np.ndarray | None = None) -> tuple[list[list[tuple[int, str]]], Categories]:
    """For each row the chosen edges (place in its list, phase), and the categories; ``room``: how many controls the assignment may give each row, where that isn't the same for all."""
    cats = cats or categorise(rows, n_controls, rules)
    chosen: list[list[tuple[int, str]]] = [[] for _ in rows]
    taken = np.zeros(n_controls, bool)
    if rules.competitive:
        _greedy(rows, cats, rules, taken, chosen)
    if rules.global_optimal:
        _optimal(rows, cats, rules, taken, chosen, room)
    return chosen, cats


def nearest_first(rows: list[tuple[np.ndarray, np.ndarray]], n_controls: int, caliper: float, ratio: int = 1) -> list[list[int]]:
    """Plain greedy matching: rows in order, each taking its nearest free control within the caliper; ``ratio`` rounds."""
    taken = np.zeros(n_controls, bool)
    out: list[list[int]] = [[] for _ in rows]
    for _ in range(ratio):
        for i, (c, d) in enumerate(rows):
            free = np.flatnonzero(~taken[c] & (d <= caliper))
            if len(free):
                taken[c[free[0]]] = True
                out[i].append(int(free[0]))
    return out
