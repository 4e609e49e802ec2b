"""Allocation over the whole candidate graph.

Horizons grow first, on all edges at once, in shards (``grown``): a shard grows
its rows as far as they need with what other rows hold at the moment, and
rounds repeat for rows that lost a safe control meanwhile.  Only edges within
the final horizons matter afterwards, few for each row, and only shared
controls tie rows together; each connected component of that graph is one
kernel call.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import discard, saved
from .kernel import Categories, Rules, allocate, greedy_classes, horizons, horizons_flat


#: Up to so many edges (counted first) are labelled on the driver.
DRIVER_EDGES = 500_000
#: How many further edges of a row a round of growing looks at, and about how many edges a shard holds.
LOOK_AHEAD = 64
SHARD_EDGES = 1_000_000
#: One row in so many at the end of its list: all lists are made longer.
SPREADS = 20
#: Up to so many edges (counted) grow in one call, which holds about 30 bytes of each.
GROW_EDGES = 16_000_000
#: Up to so many edges within horizons (counted) are one kernel call, without labels.
ONE_CALL = 20_000


def _labels(edges: DataFrame) -> DataFrame:
    """(query_id, component) of a small edge table, by the same rounds in NumPy."""
    ids = edges.select("query_id", "ref_id").toPandas()
    queries, q = np.unique(ids["query_id"].to_numpy(), return_inverse=True)
    refs, r = np.unique(ids["ref_id"].to_numpy(), return_inverse=True)
    label = np.arange(len(queries))
    while True:
        low = np.full(len(refs), len(queries))
        np.minimum.at(low, r, label[q])
        now = label.copy()
        np.minimum.at(now, q, low[r])
        now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    kind = dict(edges.dtypes)["query_id"]
    table = pa.table({"query_id": pa.array(queries.tolist()), "component": pa.array(queries[label].tolist())}) if len(queries) else None
    spark = edges.sparkSession
    found = spark.createDataFrame(table) if table is not None else spark.createDataFrame([], f"query_id {kind}, component {kind}")
    return found.select(F.col("query_id").cast(kind), F.col("component").cast(kind))


def _task_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, component) of all edges, as of ``_labels``."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    query, ref = (whole.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
    del parts, whole
    order = np.argsort(query.dictionary.to_numpy(zero_copy_only=False), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    q, r = place[query.indices.to_numpy()], ref.indices.to_numpy()
    label = np.arange(len(order), dtype=np.int32)
    while True:
        low = np.full(len(ref.dictionary), len(order), np.int32)
        np.minimum.at(low, r, label[q])
        now = label.copy()
        np.minimum.at(now, q, low[r])
        now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    yield pa.RecordBatch.from_arrays([query.dictionary.take(pa.array(order)), query.dictionary.take(pa.array(order[label]))], ["query_id", "component"])


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """``edges`` (query_id, ref_id, ...) with ``component``: the least query of each connected part.

    Labels travel over controls to queries and back until nothing changes; each
    round is two partial aggregations and two joins, and labels jump to the
    label of their label, so long chains take few rounds.  A round's labels are
    written, and the last round's removed.
    """
    n = edges.count()
    if n <= driver_edges:
        return edges.join(_labels(edges), "query_id")
    if driver_edges == DRIVER_EDGES and n <= GROW_EDGES:  # one task: long chains take many rounds, which are short there
        kind = dict(edges.dtypes)["query_id"]
        found = edges.select("query_id", "ref_id").repartition(1).mapInArrow(_task_labels, f"query_id {kind}, component {kind}")
        return edges.join(saved(found, "labels"), "query_id")
    links = edges.select("query_id", "ref_id")
    label = saved(links.select("query_id", F.col("query_id").alias("label")).distinct(), "labels")
    while True:
        at_ref = links.join(label, "query_id").groupBy("ref_id").agg(F.min("label").alias("label"))
        low = links.join(at_ref, "ref_id").groupBy("query_id").agg(F.min("label").alias("low"))
        jump = label.select(F.col("query_id").alias("low"), F.col("label").alias("jump"))
        now = saved(label.join(low, "query_id").join(jump, "low", "left").select("query_id", F.least("label", "low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved")), "labels")
        discard(label)
        label = now
        if not now.where("moved").limit(1).count():
            return edges.join(now.select("query_id", F.col("label").alias("component")), "query_id")


def _ranked(edges: DataFrame, rules: Rules) -> DataFrame:
    """The edges within reach of the rules, with their rank, written once."""
    limit = rules.threshold if rules.fuzzy_limit is None else max(rules.threshold, rules.fuzzy_limit)
    order = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    edges = edges.where(F.col("distance") <= limit).select("query_id", "ref_id", "distance", F.row_number().over(order).alias("rank"))
    return saved(edges if rules.k is None else edges.where(F.col("rank") <= rules.k), "edges")


def _grow_shard(rules: Rules):
    """(query_id, horizon) of a shard's rows after they have grown by their next edges, with ``users`` holding each control elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_id", "rank"], kind="stable")
        queries, first = np.unique(pdf["query_id"].to_numpy(), return_index=True)
        refs, codes = np.unique(pdf["ref_id"].to_numpy(), return_inverse=True)
        users = np.zeros(len(refs), np.int64)
        users[codes] = pdf["users"].to_numpy()
        cuts = [*first[1:], len(pdf)]
        d = pdf["distance"].to_numpy()
        steps, _ = horizons([(codes[a:z], d[a:z]) for a, z in zip(first, cuts)], len(refs), Rules(rules.threshold, safe_matches=rules.safe_matches), users, pdf["needs"].to_numpy()[first])
        return pd.DataFrame({"query_id": queries, "horizon": pdf["horizon"].to_numpy()[first] + steps, "length": np.diff([*first, len(pdf)])})

    return run


def _grow_whole(needs: int):
    """(query_id, horizon, length) of all rows, from (query_id, ref_id, inside, contested) in order of row and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        inside, outside = (whole.column(i).to_numpy() for i in (2, 3))
        refs = whole.column(1).combine_chunks().dictionary_encode()
        codes, n_refs = refs.indices.to_numpy(), len(refs.dictionary)
        row = whole.column(0).combine_chunks().dictionary_encode()
        del parts, whole, refs
        start = np.append(np.searchsorted(row.indices.to_numpy(), np.arange(len(row.dictionary))), len(codes))
        users = np.zeros(n_refs, np.int64)
        users[codes[outside]] = 2
        found = horizons_flat(start, codes, inside, users, needs)
        yield pa.RecordBatch.from_arrays([row.dictionary, pa.array(found), pa.array(np.diff(start))], ["query_id", "horizon", "length"])

    return run


def grown(ranked: DataFrame, rules: Rules, look_ahead: int = LOOK_AHEAD, shard_edges: int = SHARD_EDGES, contested: DataFrame | None = None) -> DataFrame:
    """(query_id, horizon, length): how far each row of the ranked edges takes part, and how many edges it has.

    What a row needs is never less after others have grown, so growing in any
    order, with whatever of the others is known, ends at the same least
    horizons as growing all rows by one edge at a time.  ``contested``: controls
    (ref_id) that are safe for nobody, as rows beside these hold them.  What a
    round looks at doubles from round to round.
    """
    kind = dict(ranked.dtypes)["query_id"]
    if ranked.count() <= (GROW_EDGES if shard_edges == SHARD_EDGES else shard_edges):  # one call knows all there is to know, in one round
        if contested is None:
            whole = ranked.withColumn("contested", F.lit(False))
        else:
            whole = ranked.join(contested.select("ref_id", F.lit(True).alias("contested")), "ref_id", "left")
        whole = whole.select("query_id", "ref_id", (F.col("distance") <= rules.threshold).alias("inside"), F.coalesce("contested", F.lit(False)).alias("contested"), "rank")
        whole = whole.repartition(1).sortWithinPartitions("query_id", "rank").drop("rank")
        return saved(whole.mapInArrow(_grow_whole(rules.safe_matches), f"query_id {kind}, horizon long, length long"), "horizons")
    state = saved(ranked.groupBy("query_id").agg(F.max("rank").cast("long").alias("length")).select("query_id", F.lit(0).cast("long").alias("horizon"), "length"), "horizons")
    while True:
        held = ranked.join(state, "query_id").where((F.col("rank") <= F.col("horizon")) & (F.col("distance") <= rules.threshold)).select("query_id", "ref_id")
        if contested is not None:
            held = held.unionByName(contested.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "ref_id").select(F.lit(None).cast(kind).alias("query_id"), "ref_id"))
        users = saved(held.groupBy("ref_id").agg(F.count("*").alias("users"), F.min("query_id").alias("query_id")), "users")
        safe = users.where("users = 1").groupBy("query_id").agg(F.count("*").alias("safe"))
        needs = F.lit(rules.safe_matches) - F.coalesce("safe", F.lit(0))
        growing = state.join(safe, "query_id", "left").select("query_id", "horizon", needs.alias("needs")).where((F.col("horizon") == 0) | (F.col("needs") > 0))
        ahead = ranked.join(growing, "query_id").where((F.col("rank") > F.col("horizon")) & (F.col("rank") <= F.col("horizon") + look_ahead))
        ahead = saved(ahead.join(users.select("ref_id", "users"), "ref_id", "left").select("query_id", "ref_id", "distance", "rank", "horizon", "needs", F.coalesce("users", F.lit(0)).alias("users")), "ahead")
        n = ahead.count()
        if n:
            shard = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // shard_edges))))
            new = ahead.groupBy(shard.alias("shard")).applyInPandas(_grow_shard(rules), f"query_id {kind}, horizon long, length long").drop("length")
            now = saved(state.join(new.withColumnRenamed("horizon", "next"), "query_id", "left").select("query_id", F.coalesce("next", "horizon").alias("horizon"), "length"), "horizons")
            discard(state)
            state = now
        discard(users)
        discard(ahead)
        look_ahead *= 2
        if not n:
            return state


def categorised(ranked: DataFrame, state: DataFrame, rules: Rules) -> DataFrame:
    """(query_id, ref_id, distance, rank, category) of the edges within the horizons: safe, competitive or fuzzy; with ``copies``, if given: how many rows have the list."""
    held = F.sum("copies") if "copies" in ranked.columns else F.count("*")
    inside = ranked.join(state.select("query_id", "horizon"), "query_id").where(F.col("rank") <= F.col("horizon")).drop("horizon")
    within = F.col("distance") <= rules.threshold
    users = inside.where(within).groupBy("ref_id").agg(held.alias("users"))
    kind = F.when(~within, "fuzzy").when(F.col("users") > 1, "competitive").otherwise("safe")
    return inside.join(users, "ref_id", "left").select("query_id", "ref_id", "distance", "rank", *(["copies"] if "copies" in ranked.columns else []), kind.alias("category"))


def _rows_of(pdf: pd.DataFrame):
    """Rows (controls, distances) in order of query id, and the two id lists."""
    pdf = pdf.sort_values(["query_id", "distance", "ref_id"], kind="stable")
    queries, first = np.unique(pdf["query_id"].to_numpy(), return_index=True)
    refs, codes = np.unique(pdf["ref_id"].to_numpy(), return_inverse=True)
    cuts = [*first[1:], len(pdf)]
    d = pdf["distance"].to_numpy()
    return [(codes[a:z], d[a:z]) for a, z in zip(first, cuts)], queries, refs


def match(edges: DataFrame, rules: Rules) -> DataFrame:
    """(query_id, ref_id, distance, phase): the chosen pairs; no control twice."""
    ranked = _ranked(edges, rules)
    return _match_ranked(ranked, grown(ranked, rules), rules)


def match_growing(candidates, rules: Rules, most: int, first: int = LOOK_AHEAD, factor: int = 8, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``match`` without the full candidate lists: (pairs, the edges that were made).

    ``candidates(k, queries)`` gives the k nearest edges of the queries (a
    table of query_id, or None for all).  Lists start at ``first`` edges; rows
    that grow to the end of theirs get longer ones, up to ``most``, until no
    row meets the end of a list that was cut.  What the lists leave out then
    can't have a part in the horizons, so the pairs are those of full lists.

    ``members`` (id, query_id): rows with the same list, under the least id
    among them.  The greedy phase takes such rows as one class, so neither their
    lists nor the edges grow with the copies of a row.
    """
    if members is not None and rules.competitive:
        return _match_classes(candidates, rules, most, first, factor, members)
    k = min(first, most)
    edges = saved(_asked(candidates, k), "candidates")
    while True:
        ranked = _ranked(edges, rules)
        state = grown(ranked, rules)
        short = _short(edges, state, most)
        if short is None:
            return _match_ranked(ranked, state, rules), edges.drop("asked")
        k = min(most, k * factor)
        edges = saved(edges.join(short, "query_id", "left_anti").unionByName(_asked(candidates, k, short)), "candidates")


def _match_classes(candidates, rules: Rules, most: int, first: int, factor: int, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``match_growing`` with rows of the same list as one: whatever one of them holds the others hold too, so none has a safe control, and all take part with their whole list."""
    sizes = saved(members.groupBy("query_id").agg(F.count("*").alias("copies")), "classes")
    several, alone = sizes.where("copies > 1").select("query_id"), sizes.where("copies = 1").select("query_id")
    shared = saved(_asked(candidates, most, several), "candidates")
    ranked_shared = _ranked(shared, rules)
    contested = saved(ranked_shared.where(F.col("distance") <= rules.threshold).select("ref_id").distinct(), "contested")
    k = min(first, most)
    edges = saved(_asked(candidates, k, alone), "candidates")
    while True:
        ranked = _ranked(edges, rules)
        state = grown(ranked, rules, contested=contested)
        short = _short(edges, state, most)
        if short is None:
            break
        k = min(most, k * factor)
        edges = saved(edges.join(short, "query_id", "left_anti").unionByName(_asked(candidates, k, short)), "candidates")
    n = F.max("rank").cast("long")
    state = state.unionByName(ranked_shared.groupBy("query_id").agg(n.alias("horizon"), n.alias("length")))
    ranked = ranked.withColumn("copies", F.lit(1)).unionByName(ranked_shared.withColumn("copies", F.lit(2)))
    every = edges.unionByName(shared).drop("asked").join(members, "query_id").select(F.col("id").alias("query_id"), "ref_id", "distance")
    return _match_ranked(ranked, state, rules, members=members), every


def _asked(candidates, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Lists of k edges, with k beside them: lists that were made earlier are shorter, and may turn out too short later."""
    return candidates(k, queries).select("query_id", "ref_id", "distance", F.lit(k).cast("long").alias("asked"))


def _short(edges: DataFrame, state: DataFrame, most: int) -> DataFrame | None:
    """The rows to get longer lists, None if no row grew to the end of a list that was cut.

    Where more than a few did, all cut lists are made longer: each row that goes on
    contests controls of others, which would ask for longer lists round by round.
    """
    cut = _cut(edges, most)
    short = saved(state.where(F.col("horizon") == F.col("length")).select("query_id").join(cut, "query_id", "left_semi"), "short")
    n = short.count()
    if not n:
        return None
    return saved(cut, "short") if n * SPREADS > state.count() else short


def _cut(edges: DataFrame, most: int) -> DataFrame:
    """The query_id of lists that have as many edges as were asked for, and so may go on."""
    lists = edges.groupBy("query_id").agg(F.count("*").alias("length"), F.max("asked").alias("asked"))
    return lists.where((F.col("length") >= F.col("asked")) & (F.col("asked") < most)).select("query_id")


def _match_ranked(ranked: DataFrame, state: DataFrame, rules: Rules, peel_from: int = DRIVER_EDGES, one_call: int = ONE_CALL, members: DataFrame | None = None) -> DataFrame:
    """The greedy phase over the rows short of safe controls, which alone take part in it; then the assignment over what is left."""
    used = saved(categorised(ranked, state, rules), "horizon-edges")
    if rules.flow:
        rules = replace(rules, largest=ranked.agg(F.max("distance")).first()[0] or 1.0)
    if members is None and used.count() <= one_call:
        return _by_component(used, rules, False)
    done = []
    if rules.competitive:
        limited = used.groupBy("query_id").agg(F.count(F.when(F.col("category") == "safe", 1)).alias("n")).where(F.col("n") < rules.safe_matches).select("query_id")
        done.append(saved(_greedy_by_component(used.join(limited, "query_id", "left_semi"), rules, members), "greedy"))
    if rules.global_optimal:
        rest = used.where("category <> 'fuzzy'").withColumn("room", F.lit(rules.n_neighbors))
        if members is not None:  # rows that share a list are through: nothing that they could take is free
            rest = rest.where("copies = 1").drop("copies")
        if done:
            got = done[0].groupBy("query_id").agg(F.count("*").cast("int").alias("got"))
            rest = rest.join(done[0].select("ref_id"), "ref_id", "left_anti").join(got, "query_id", "left").withColumn("room", F.col("room") - F.coalesce("got", F.lit(0))).where("room > 0").drop("got")
        decided, rest = _peeled(saved(rest, "open-edges"), peel_from)
        done += [decided, _by_component(rest, replace(rules, competitive=False))]
    if not done:
        return used.where("false").select("query_id", "ref_id", "distance", F.lit("").alias("phase"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _peeled(rest: DataFrame, peel_from: int) -> tuple[DataFrame, DataFrame]:
    """(decided pairs, open edges): rows whose nearest controls are wanted by nobody else take them, in any least-cost assignment.

    Once they are gone their other controls have fewer who want them, so more
    rows can be decided; on large graphs (``peel_from`` edges, counted) rounds go
    on until nothing moves, and only the contested core is left to be split
    into components and assigned.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    pairs = lambda x: x.select("query_id", "ref_id", "distance", F.lit("optimal").alias("phase"))
    decided = pairs(rest.where("false"))
    while rest.count() > peel_from:
        wanted = rest.groupBy("ref_id").agg(F.count("*").alias("users"))
        places = rest.join(wanted, "ref_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("room"))
        sure = saved(places.withColumn("most", F.max("users").over(Window.partitionBy("query_id"))).where("most = 1"), "decided")
        if not sure.limit(1).count():
            break
        decided = decided.unionByName(pairs(sure))
        left = saved(rest.join(sure.select("query_id").distinct(), "query_id", "left_anti"), "open-edges")
        discard(rest)
        rest = left
    return decided, rest


def _greedy_by_component(edges: DataFrame, rules: Rules, members: DataFrame | None) -> DataFrame:
    """Pairs of the greedy phase over the categorised ``edges`` of the rows that take part in it, one kernel call for each connected component."""
    names = np.array(["safe", "competitive", "fuzzy"], object)

    def run(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        q, r, rank = pdf["query_id"].to_numpy(), pdf["ref_id"].to_numpy(), pdf["rank"].to_numpy()
        order = np.lexsort((rank, q))
        q, r, d, kinds = q[order], r[order], pdf["distance"].to_numpy()[order], pdf["kind"].to_numpy()[order]
        queries, start = np.unique(q, return_index=True)
        refs, codes = np.unique(r, return_inverse=True)
        of = of.sort_values(["query_id", "id"])
        whose, at = np.unique(of["query_id"].to_numpy(), return_index=True)
        rows = dict(zip(whose.tolist(), np.split(of["id"].to_numpy(), at[1:])))
        found = greedy_classes(np.append(start, len(q)), codes, kinds, len(refs), [rows[x] for x in queries.tolist()], rules.n_neighbors)
        ids, e = [x for _, x, _ in found], np.array([x for _, _, x in found], int)
        return pd.DataFrame({"query_id": ids, "ref_id": refs[codes[e]], "distance": d[e], "phase": names[kinds[e]]})

    kinds = dict(edges.dtypes)
    if members is None:
        members = edges.select("query_id").distinct().select("query_id", F.col("query_id").alias("id"))
    number = F.when(F.col("category") == "safe", 0).when(F.col("category") == "competitive", 1).otherwise(2)
    parts = saved(components(edges.select("query_id", "ref_id", "distance", "rank", number.cast("byte").alias("kind"))), "parts")
    of = saved(members.join(parts.select("query_id", "component").distinct(), "query_id").select("query_id", "id", "component"), "members")
    return parts.groupBy("component").cogroup(of.groupBy("component")).applyInPandas(run, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, distance double, phase string")


def _by_component(edges: DataFrame, rules: Rules, apart: bool = True) -> DataFrame:
    """Pairs of the categorised ``edges``, one kernel call for each connected component (or one for all, if not ``apart``); ``room``, if given, is how many controls a row still takes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_id", "rank"], kind="stable")
        rows, queries, refs = _rows_of(pdf)
        kinds = iter(pdf["category"])
        cats = Categories([[] for _ in rows], [[] for _ in rows], [[] for _ in rows], np.array([len(c) for c, _ in rows]))
        for i, (c, _) in enumerate(rows):
            for at in range(len(c)):
                getattr(cats, next(kinds))[i].append(at)
        room = pdf.drop_duplicates("query_id")["room"].to_numpy() if "room" in pdf else None
        chosen, _ = allocate(rows, len(refs), rules, cats, room)
        out = [(queries[i], refs[rows[i][0][at]], rows[i][1][at], phase) for i, picks in enumerate(chosen) for at, phase in picks]
        return pd.DataFrame(out, columns=["query_id", "ref_id", "distance", "phase"])

    kinds = dict(edges.dtypes)
    parts = components(edges) if apart else edges.withColumn("component", F.lit(0))
    return parts.groupBy("component").applyInPandas(run, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, distance double, phase string")


def categories(edges: DataFrame, rules: Rules) -> DataFrame:
    """(query_id, horizon, n_safe, n_competitive, n_fuzzy) of every query with an edge."""
    ranked = _ranked(edges, rules)
    state = grown(ranked, rules)
    n = lambda kind: F.count(F.when(F.col("category") == kind, 1)).alias(f"n_{kind}")
    counts = categorised(ranked, state, rules).groupBy("query_id").agg(n("safe"), n("competitive"), n("fuzzy"))
    return state.join(counts, "query_id").select("query_id", "horizon", "n_safe", "n_competitive", "n_fuzzy")


def _propose_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """(query_id, ref_id, distance, at) of a shard's free rows: the control that each ends at, or none (``at``: how far its list is used up).

    A row asks its controls in turn; a control takes it unless it is held by a row of less id, and sends the one it held on.
    """
    pdf = pdf.sort_values(["query_id", "rank"], kind="stable").reset_index(drop=True)
    queries, first = np.unique(pdf["query_id"].to_numpy(), return_index=True)
    refs, codes = np.unique(pdf["ref_id"].to_numpy(), return_inverse=True)
    end = [*first[1:].tolist(), len(pdf)]
    # the place of the holder's id among the shard's ids: a row of the shard gives way to holders at or before it
    holder = np.full(len(refs), len(queries))
    has = pdf["held"].to_numpy()
    holder[codes[has]] = np.searchsorted(queries, pdf["holder"].to_numpy()[has])
    own = np.zeros(len(refs), bool)
    at = first.tolist()
    won = np.full(len(queries), -1)
    for q in range(len(queries)):
        while q >= 0:
            k = at[q]
            while k < end[q] and holder[codes[k]] <= q:
                k += 1
            at[q] = k
            if k == end[q]:
                break
            c = codes[k]
            sent = int(holder[c]) if own[c] else -1
            holder[c], own[c], won[q] = q, True, k
            if sent >= 0:
                won[sent] = -1
            q = sent
    k = np.where(won >= 0, won, 0)
    rank = pdf["rank"].to_numpy()
    at = np.where(won >= 0, rank[k] - 1, rank[np.array(end) - 1])
    return pd.DataFrame({"query_id": queries, "ref_id": pdf["ref_id"].to_numpy()[k], "distance": pdf["distance"].to_numpy()[k], "at": at, "won": won >= 0})


def greedy(edges: DataFrame, caliper: float, ratio: int = 1, look_ahead: int = LOOK_AHEAD, shard_edges: int = SHARD_EDGES) -> DataFrame:
    """(query_id, ref_id, distance): nearest-first matching without replacement, queries in order of id, ``ratio`` times over.

    That is the one matching in which no row would rather have a control that
    is free or held by a row of greater id, so it can be reached in any order:
    rows ask their controls in turn, controls keep the least id that asked.
    Shards do so for their free rows, as far as they know who holds what; where
    several shards' rows want one control the least id has it, and the others
    go on in the next round.
    """
    kinds = dict(edges.dtypes)
    edges = saved(edges.where(F.col("distance") <= caliper).select("query_id", "ref_id", "distance"), "edges")
    if ratio == 1 and edges.count() <= shard_edges:  # one shard serves all rows in order
        whole = _ranked(edges, Rules(caliper)).select("*", F.col("query_id").alias("holder"), F.lit(False).alias("held"))
        asked = whole.groupBy(F.lit(0).alias("shard")).applyInPandas(_propose_shard, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, distance double, at int, won boolean")
        return asked.where("won").select("query_id", "ref_id", "distance")
    done = saved(edges.where("false").select("query_id", "ref_id", "distance"), "greedy")
    for _ in range(ratio):
        ranked = _ranked(edges.join(done.select("ref_id"), "ref_id", "left_anti"), Rules(caliper))
        held = saved(done.where("false"), "held")
        used = saved(ranked.select("query_id").distinct().withColumn("at", F.lit(0)), "used")
        while True:
            free = used.join(held, "query_id", "left_anti")
            ahead = ranked.join(free, "query_id").where((F.col("rank") > F.col("at")) & (F.col("rank") <= F.col("at") + look_ahead)).drop("at")
            ahead = ahead.join(held.select("ref_id", F.col("query_id").alias("holder")), "ref_id", "left")
            ahead = saved(ahead.select("query_id", "ref_id", "distance", "rank", F.coalesce("holder", "query_id").alias("holder"), F.col("holder").isNotNull().alias("held")), "ahead")
            n = ahead.count()
            if not n:
                break
            shard = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // shard_edges))))
            asked = ahead.groupBy(shard.alias("shard")).applyInPandas(_propose_shard, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, distance double, at int, won boolean")
            asked = saved(asked, "asked")
            rows = held.unionByName(asked.where("won").select("query_id", "ref_id", "distance"))
            now = saved(rows.groupBy("ref_id").agg(F.min_by(F.struct("query_id", "distance"), F.col("query_id")).alias("x")).select("x.query_id", "ref_id", "x.distance"), "held")
            next_used = saved(used.join(asked.select("query_id", F.col("at").alias("next")), "query_id", "left").select("query_id", F.coalesce("next", "at").alias("at")), "used")
            for old in (held, used, ahead, asked):
                discard(old)
            held, used = now, next_used
        done = saved(done.unionByName(held), "greedy")
    return done


def greedy_growing(candidates, caliper: float, ratio: int, most: int, first: int = LOOK_AHEAD, factor: int = 8) -> DataFrame:
    """``greedy`` without the full candidate lists.

    ``candidates(k, queries)`` as for ``match_growing``.  A row asks its list in
    order, so what lies beyond the end of a list has no part in the matching
    unless the row came there without all its controls; those rows get longer
    lists, up to ``most``.
    """
    k = min(first, most)
    edges = saved(_asked(candidates, k), "candidates")
    while True:
        pairs = saved(greedy(edges, caliper, ratio), "greedy")
        served = pairs.groupBy("query_id").agg(F.count("*").alias("got")).where(F.col("got") >= ratio)
        short = saved(_cut(edges, most).join(served, "query_id", "left_anti"), "short")
        if not short.limit(1).count():
            return pairs
        k = min(most, k * factor)
        now = saved(edges.join(short, "query_id", "left_anti").unionByName(_asked(candidates, k, short)), "candidates")
        discard(edges)
        discard(pairs)
        edges = now


def usage(edges: DataFrame) -> DataFrame:
    """How many candidate lists each control is in."""
    return edges.groupBy("ref_id").agg(F.count("*").alias("n_users"))
