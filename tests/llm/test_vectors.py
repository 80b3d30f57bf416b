"""Searches and links of vectors against all pairs in double precision."""

import numpy as np
import pytest

from cardmill.llm.rotated_codes import Scan, _chunks, _floors, _held, _reranked, build_index, coded, nearest, rotation, rounded
from cardmill.llm.tiled_cosine import _near_tiles, _tiles, linked, near_vectors, principal_axes, units
from cardmill.session import materialise

from . import plain

SCHEMA = "vec_id long, embedding array<float>, label int, length int, tile long, key string"
INF, NAN = float("inf"), float("nan")
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [NAN] + [1.0] * 7, [INF] + [1.0] * 7]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA).repartition(3)


def cosine(a, b):
    one, two = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(one @ two / np.linalg.norm(one) / np.linalg.norm(two))


def clusters(seed, groups, each, size, spread):
    chance = np.random.default_rng(seed)
    centres = chance.standard_normal((groups, size))
    rows = np.concatenate([centre + spread * chance.standard_normal((each, size)) for centre in centres])
    return rows.astype(np.float32).tolist()


def check_links(spark, rows, threshold=0.93):
    found = {r["vec_id"]: r for r in near_vectors(frame(spark, rows), threshold).collect()}
    assert len(found) == len(rows)
    fine = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows
            if v and None not in v and np.isfinite(v).all() and any(v) and label is not None]
    links = []
    for k, (i, v, label) in enumerate(fine):
        links += [(i, j) for j, w, other in fine[:k] if other == label and len(v) == len(w) and cosine(v, w) >= threshold]
    degree = dict.fromkeys(found, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    wanted = plain.components(found, links)
    assert {i: r["n_links"] for i, r in found.items()} == degree
    assert {i: r["component_id"] for i, r in found.items()} == wanted
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    return len(links)


def test_links_of_clusters(spark):
    vectors = clusters(1, 12, 25, 32, 0.19) + clusters(2, 40, 3, 8, 0.1)
    vectors += vectors[:20] + [[2 * x for x in vectors[0]]] + [[-x for x in vectors[0]]] + ODD
    rows = [(i * 7 % 1009, v, (None, 1, 2)[min(i % 11, 2)]) for i, v in enumerate(vectors)]
    assert check_links(spark, rows) > 1000


def test_tiles_smaller_than_groups(spark, monkeypatch):
    monkeypatch.setattr("cardmill.llm.tiled_cosine.TILE", 16)
    assert check_links(spark, [(i, v, 0) for i, v in enumerate(clusters(3, 3, 60, 24, 0.2))]) > 500
    assert check_links(spark, [(i, [1.0, 2.0, 3.0], 0) for i in range(50)]) == 1225


def test_links_of_one_label_in_many_tiles_and_cells(spark, monkeypatch):
    monkeypatch.setattr("cardmill.llm.tiled_cosine.TILE", 8)
    monkeypatch.setattr("cardmill.llm.tiled_cosine.CELL_TILES", 5)
    vectors = clusters(6, 30, 12, 3, 0.3) + clusters(7, 20, 10, 80, 0.15) + clusters(8, 1, 40, 2, 1.0) + clusters(9, 1, 9, 1, 1.0)
    for threshold in (0.93, 0.5, 1.0):
        assert check_links(spark, [(i, v, 7) for i, v in enumerate(vectors)], threshold) > 0


def test_tiles_of_a_label_meet_near_ones_only(spark, monkeypatch):
    """Ten times the groups in one label take about ten times the pairs of tiles."""
    monkeypatch.setattr("cardmill.llm.tiled_cosine.TILE", 4)
    pairs = []
    for groups in (20, 200):
        rows = [(i, v, 7) for i, v in enumerate(clusters(10, groups, 4, 3, 0.01))]
        classes = frame(spark, rows).selectExpr("label", "vec_id as class", "1L as copies", "cast(embedding as array<double>) as vector")
        tiles = materialise(_tiles(classes, principal_axes(classes), 0.05), "tiles")
        pairs.append(_near_tiles(tiles, 0.999, 0.05).distinct().count())
        assert pairs[-1] == _near_tiles(tiles, 0.999, 0.05).count()
    assert pairs[1] < 40 * pairs[0]


def test_links_of_odd_tables(spark):
    vector = [1.0, 2.0]
    rows = [(None, vector, 1), (5, vector, 1), (5, vector, 1), (9, vector, 1), (9, [9.0, -1.0], 1), (3, [9.0, -1.0], 1), (2, vector, None)]
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 3, None, True), (5, 3, 3, False), (5, 3, 3, False), (9, 3, 3, False), (9, 1, 3, False),
                            (3, 1, 3, True), (2, 0, 2, True)], key=str)
    assert near_vectors(frame(spark, []).limit(0)).collect() == []
    assert [tuple(r) for r in near_vectors(frame(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]


def brute(rows, queries, k):
    fine = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    answer = {}
    for q in queries:
        if q in fine:
            others = [(-cosine(fine[q], v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])]
            answer[q] = sorted((round(score, 9), i) for score, i in others)[:k]
    return answer


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_nearest(spark, spread, monkeypatch):
    monkeypatch.setattr("cardmill.llm.rotated_codes.BLOCK", 200)
    monkeypatch.setattr("cardmill.llm.rotated_codes.QUERY_BYTES", 20_000)
    vectors = clusters(4, 60, 12, 24, spread) + clusters(5, 1, 3, 7, 1.0) + ODD
    vectors += [vectors[100]] * 40
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    table = frame(spark, rows)
    found = {}
    for r in nearest(table, table.filter("vec_id % 10 = 0 or vec_id > 750")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (-round(r["score"], 9), r["vec_id"])
    wanted = brute(rows, [i for i, _, _ in rows if i % 10 == 0 or i > 750], 5)
    assert found.keys() == {q for q, near in wanted.items() if near}
    hits = total = 0
    for q, near in wanted.items():
        got = [found[q][rank] for rank in range(1, len(near) + 1)]
        assert got == sorted(got) and len(found[q]) == len(near)
        hits += len(set(got) & set(near))
        total += len(near)
    assert hits / total >= 0.99


def test_nearest_of_odd_tables(spark):
    table = frame(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0), (3, [1.0], 0), (4, None, 0)])
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(table, table).collect()]
    assert sorted(found) == [(1, 1, 2), (2, 1, 1)]
    assert nearest(table.limit(0), table).collect() == [] == nearest(table, table.limit(0)).collect()


def test_bounds_hold():
    chance = np.random.default_rng(8)
    rows, queries = chance.standard_normal((2000, 48)), chance.standard_normal((30, 48))
    turn = rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48))
    scan = Scan(*coded(rows, turn))
    outside = 0
    for query in units(queries):
        estimate, width = scan.cosines(rounded(query @ turn, chance))
        outside += (np.abs(estimate - units(rows) @ query) > width).sum()
    assert outside / (30 * 2000) < 0.005


def test_products_stop_early_and_lose_nothing():
    chance = np.random.default_rng(12)
    rows = units(chance.standard_normal((300, 100)) * np.geomspace(1, 0.05, 100))
    axes = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    for threshold in (0.2, 0.6, 0.93):
        found = {(i, j) for i, others in linked(rows[:120], rows, axes, threshold) for j in others.tolist()}
        assert found == set(zip(*map(np.ndarray.tolist, np.nonzero((rows[:120, None] * rows).sum(axis=2) >= threshold)), strict=True))


def test_shuffled_rows_grow_with_queries_not_with_codes(spark):
    """Four times the codes give a query no more rows to rank than its tasks' k nearest."""
    vectors = clusters(11, 100, 8, 16, 0.3)
    table = frame(spark, [(i, v, 0) for i, v in enumerate(vectors)])
    held = _held(next(_chunks(table.filter("vec_id % 50 = 0").selectExpr("vec_id as query_id", "cast(embedding as array<double>) as asked"), 3, 8)))
    index = build_index(table)
    rows = index.select("key", "vector", "length", "words", "scalar")
    assert rows.mapInArrow(_reranked(held, 5), "query_id long, vec_id long, score double").count() <= 16 * 5 * rows.rdd.getNumPartitions()
    floors = rows.mapInArrow(_floors(held, 5), "query_id long, bound double").groupBy("query_id").max("bound").collect()
    exact = brute([(i, v, 0) for i, v in enumerate(vectors)], list(held), 5)
    assert len(floors) == 16 and all(bound <= -exact[query][-1][0] + 1e-6 for query, bound in floors)
