from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest

from threadlab.operators import layout

UNIT = layout.UNIT


def plain(edges, rounds, seed=42):
    """The same with loops: {(post, node): (x, y)}."""
    out = {}
    for post in {e[0] for e in edges}:
        own = [(a, b) for p, a, b in edges if p == post]
        nodes = sorted({x for e in own for x in e})
        pairs = {tuple(sorted(e)) for e in own if e[0] != e[1]}
        n = len(nodes)
        k, side = 1 / math.sqrt(n), math.floor(2.0 * UNIT / math.sqrt(n))
        at = {v: [int(hashlib.md5(f"{seed}:{post}:{v}:{axis}".encode()).hexdigest()[:8], 16) >> 2 for axis in "xy"] for v in nodes}
        whole = lambda value: math.floor(value * UNIT + 0.5)
        for r in range(rounds):
            cells = defaultdict(list)
            for v in nodes:
                cells[at[v][0] // side, at[v][1] // side].append(v)
            force = {v: [0, 0] for v in nodes}
            for v in nodes:
                cx, cy = (c // side for c in at[v])
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        others = [u for u in cells.get((cx + i, cy + j), []) if u != v]
                        if others:
                            d = [(at[v][c] - sum(at[u][c] for u in others) / len(others)) / UNIT for c in (0, 1)]
                            size = max(math.sqrt(d[0] * d[0] + d[1] * d[1]), 0.01)
                            for c in (0, 1):
                                force[v][c] += whole(d[c] * (len(others) * k * k) / (size * size))
            for a, b in pairs:
                d = [(at[a][c] - at[b][c]) / UNIT for c in (0, 1)]
                pull = max(math.sqrt(d[0] * d[0] + d[1] * d[1]), 0.01) / k
                for c in (0, 1):
                    force[a][c] += whole(d[c] * pull * -1.0)
                    force[b][c] += whole(d[c] * pull)
            step = layout.STEP * (1 - r / (rounds + 1))
            for v in nodes:
                f = [c / UNIT for c in force[v]]
                size = math.sqrt(f[0] * f[0] + f[1] * f[1])
                share = step / (0.1 if size < 0.01 else size)
                at[v] = [x + whole(c * share) for x, c in zip(at[v], f)]
        mean = [sum(at[v][c] for v in nodes) / n for c in (0, 1)]
        far = max(abs(at[v][c] - mean[c]) for v in nodes for c in (0, 1))
        for v in nodes:
            out[post, v] = tuple((at[v][c] - mean[c]) / far if far else 0.0 for c in (0, 1))
    return out


EDGES = (
    [("p", f"u{i}", f"u{i // 2}") for i in range(1, 24)] + [("p", "u3", "u3"), ("p", "u1", "u0"), ("p", "u0", "u1")]
    + [("q", "a", "b")] + [("r", "me", "me")] + [("s", f"x{i}", "hub") for i in range(12)] + [("t", "a", "b"), ("t", "c", "d")]
)


@pytest.mark.parametrize("rounds", [1, 4])
def test_positions_equal_the_plain_version(spark, rounds):
    df = spark.createDataFrame(EDGES, "post_id string, source string, target string")
    got = {(r.post_id, r.node): (r.x, r.y) for r in layout.network_layout(df, rounds).collect()}
    want = plain(EDGES, rounds)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-6), key
    assert got["r", "me"] == (0.0, 0.0)


def test_same_seed_same_result_however_the_rows_lie(spark):
    df = spark.createDataFrame(EDGES * 2, "post_id string, source string, target string")
    one = sorted(layout.network_layout(df.coalesce(1), 3).collect())
    other = sorted(layout.network_layout(df.repartition(7), 3).collect())
    assert one == other
    assert sorted(layout.network_layout(df, 3, seed=1).collect()) != one
    assert layout.network_layout(df.limit(0), 2).count() == 0


def test_connected_nodes_end_near_each_other(spark):
    pairs = [("p", f"a{i}", f"a{j}") for i in range(6) for j in range(i)] + [("p", f"b{i}", f"b{j}") for i in range(6) for j in range(i)]
    df = spark.createDataFrame(pairs, "post_id string, source string, target string")
    at = {r.node: (r.x, r.y) for r in layout.network_layout(df, 12).collect()}
    assert all(math.isfinite(c) and abs(c) <= 1 for p in at.values() for c in p)
    apart = lambda u, v: math.dist(at[u], at[v])
    inside = [apart(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)]
    between = [apart(f"a{i}", f"b{j}") for i in range(6) for j in range(6)]
    assert sum(inside) / len(inside) < sum(between) / len(between)


def test_rounds_shuffle_numbers_and_cells(spark, monkeypatch):
    """No name travels in a round, and what is dealt to the cells around is one row a cell."""
    plans, write = [], layout.materialise

    def spy(df, name, *args):
        if name == "positions":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, *args)

    monkeypatch.setattr(layout, "materialise", spy)
    layout.network_layout(spark.createDataFrame(EDGES, "post_id string, source string, target string"), 1)
    moved = plans[-1]
    assert "node#" not in moved and "post_id#" not in moved
    spread = next(line for line in moved.splitlines() if "Generate explode" in line and "cx" in line)
    assert "sx#" in moved[moved.index(spread):].splitlines()[1] or "Aggregate" in "".join(moved[moved.index(spread):].splitlines()[1:3])
