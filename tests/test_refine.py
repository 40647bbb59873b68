"""Nested refinement against exhaustive search."""

from __future__ import annotations

from itertools import groupby, product

import numpy as np
import pytest

from gridloom.operators import refine as R


def objective(mask, gain, cost):
    total, runs, before = 0.0, [], False
    for i, on in enumerate([*mask, False]):
        if on != before:
            total -= R.EDGE if i in (0, len(mask)) else cost
            total -= cost if on else 0.0
        before = on
    runs = [len(list(g)) for on, g in groupby(mask) if on]
    return total + sum(g for g, on in zip(gain, mask, strict=True) if on), runs


def exhaustive(gain, cost, must, least):
    """Best value, of equal ones the fewest bins; all masks."""
    found = []
    for mask in product([False, True], repeat=len(gain)):
        value, runs = objective(mask, gain, cost)
        if mask[must] and all(r >= least for r in runs):
            found.append((round(value, 9), -sum(mask), mask))
    return max(found)


def sequential(scores, raw, selected, gamma, penalty, least, scale, rounds, jaccard):
    """The whole refinement by exhaustive search over each parent's masks."""
    def bounds(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        return list(zip(edges[::2], edges[1::2], strict=True))

    cost, mask, nodes = max(0.25 * gamma, 1000 * R.EDGE), selected.copy(), []
    frontier = bounds(mask)
    for layer in range(rounds):
        new, ahead = mask.copy(), []
        for a, b in frontier:
            if b - a < least:
                nodes.append((layer, a, b - a, "skipped_short", 1))
                continue
            s = scores[a:b]
            floor = np.quantile(s, 0.25) if layer else 0.0
            pos = s[s > 0]
            paid = 0.0 if layer else max(penalty, 0.0) + (1 - scale) * (np.quantile(pos, 0.75) - np.quantile(pos, 0.25) if len(pos) else 0.0)
            gain = s - floor - paid
            value, _, chosen = exhaustive(gain, cost, int(np.argmax(raw[a:b])), least)
            better = value - objective([True] * (b - a), gain, cost)[0]
            chosen = np.array(chosen)
            kids = bounds(chosen)
            decision = "split" if len(kids) >= 2 and better > 1e-9 else "shrink" if not chosen.all() and better > 1e-9 else "keep_parent"
            nodes.append((layer, a, b - a, decision, len(kids) if decision in ("split", "shrink") else 1))
            if decision in ("split", "shrink"):
                new[a:b] = chosen
                ahead += [(a + x, a + y) for x, y in kids]
        share = new.sum() / max(mask.sum(), 1)
        mask, frontier = new, ahead
        if not frontier or share >= jaccard:
            break
    return bounds(mask), nodes


@pytest.mark.parametrize("least", [1, 2, 4])
def test_pieces_against_all_masks(least):
    rng = np.random.default_rng(least)
    for _ in range(40):
        n = int(rng.integers(least, 11))
        gain, must, cost = rng.integers(-4, 5, n) / 2, int(rng.integers(0, n)), float(rng.choice([0.25, 1.0]))
        cuts = sorted({0, n, *map(int, rng.integers(0, n + 1, 2))})
        costs = np.full(n, cost)
        costs[0] = R.EDGE
        at = np.arange(n) == must
        p = R.Pieces([gain[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [costs[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [at[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], np.full(len(cuts) - 1, cost), least)
        value, count = np.full(least + 1, -np.inf), np.zeros(least + 1, dtype=np.int64)
        value[0] = 0.0
        for v, c in p.folded():
            value, count, _ = R._best(value[:, None] + v, count[:, None] + c, 0)
        top, few, _ = R._best(np.array([value[0], value[least] - R.EDGE]), np.array([count[0], count[least]]), 0)
        best = (float(top), -few)
        want = exhaustive(gain, cost, must, least)
        assert round(best[0], 9) == want[0] and best[1] == want[1]


@pytest.mark.parametrize("tile", [3])
def test_refinement(spark, tile):
    rng, rows, want = np.random.default_rng(11), [], {}
    for contig, n in (("a", 90), ("b", 40), ("flat", 12)):
        scores = np.round(rng.normal(1.0, 2.0, n), 3)
        raw = np.round(scores + rng.normal(0, 0.3, n), 3)
        selected = np.zeros(n, dtype=bool)
        at = 1
        while at < n:
            width = int(rng.integers(1, 12))
            selected[at : at + width] = True
            at += width + int(rng.integers(1, 5))
        if contig == "flat":
            scores[:], raw[:] = 2.0, 2.0
        rows += [(contig, i, float(scores[i]), float(raw[i]), bool(selected[i])) for i in range(n)]
        want[contig] = sequential(scores, raw, selected, 2.0, 0.3, 3, 0.75, 3, 0.999)
    df = spark.createDataFrame(rows, "contig string, bin long, score double, raw double, selected boolean").repartition(3)
    leaves, nodes = R.refine_runs(df, 2.0, 0.3, least=3, tile=tile)
    got = {c: sorted((r["first_bin"], r["last_bin"] + 1) for r in leaves.filter(leaves.contig == c).collect()) for c in want}
    told = nodes.collect()
    for contig, (bounds, hierarchy) in want.items():
        assert got[contig] == [(int(a), int(b)) for a, b in bounds]
        mine = sorted((r["layer"], r["region"], r["size"], r["decision"], r["children"]) for r in told if r["contig"] == contig)
        assert mine == sorted((k, int(a), int(n), d, c) for k, a, n, d, c in hierarchy)
    assert any(r["decision"] == "split" for r in told) and any(r["layer"] > 0 for r in told)


def test_nothing_selected(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1.0, False) for i in range(5)], "contig string, bin long, score double, raw double, selected boolean")
    leaves, nodes = R.refine_runs(df, 1.0, 0.0)
    assert leaves.count() == 0 and nodes.count() == 0
