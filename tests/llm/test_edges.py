"""Overlap, copies and components against brute force on small, dirty and skewed edges."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, dedup, overlap


def near(a, b):
    """At most one edit apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def mutate(rng, s):
    i = rng.randrange(len(s) + 1)
    kind = rng.choice("sdix")
    if kind == "s" and i < len(s):
        return s[:i] + rng.choice("AB12") + s[i + 1 :]
    if kind == "d" and len(s) > 1:
        return s[:i] + s[i + 1 :]
    return s[:i] + rng.choice("AB12") + s[i:] if kind == "i" else s


def random_edges(seed, n=250, hub_share=0.35):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("AB12") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 13, 25]))) for _ in range(40)]
    rows = []
    for _ in range(n):
        a = "HUB7" if rng.random() < hub_share else mutate(rng, rng.choice(pool))
        b = mutate(rng, rng.choice(pool))
        rows.append((a, b, "inhibits", rng.choice(["train", "train", "valid", "test", None])))
    return rows


def brute_overlaps(rows):
    key = lambda x: "".join(c for c in x if c.isalnum()).upper() or None if x else None
    out = set()
    data = [(i + 1, key(a), key(b), s) for i, (a, b, _, s) in enumerate(rows)]
    for i, a, b, s in data:
        for j, c, d, t in data:
            if a and b and c and d and s in ("valid", "test") and t == "train":
                if any(x == u and near(y, v) for x, y in ((a, b), (b, a)) for u, v in ((c, d), (d, c))):
                    out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_equal_brute_force(make_edges, seed):
    rows = random_edges(seed)
    got = [tuple(r) for r in overlap.found(make_edges(rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_overlaps(rows)


def test_overlaps_with_hot_parts_cut_into_grids(make_edges, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_PAIRS", 7)
    monkeypatch.setattr(overlap, "STREAM_PAIRS", 11)
    rows = random_edges(3, 160, 0.7)
    assert {tuple(r) for r in overlap.found(make_edges(rows)).collect()} == brute_overlaps(rows)


def test_overlaps_of_dirty_and_empty_tables(make_edges):
    rows = [("w-1.0", "63,7.0", "a", "train"), ("637", "W10", "b", "test"), (None, "W1", "a", "valid"), ("", "W1", "a", "valid"), ("637", "W10", "b", None), ("x" * 5000, "W10", "b", "test"), ("x" * 2500 + "y" + "x" * 2499, "W10", "b", "train")]
    df = make_edges(rows)
    assert {tuple(r) for r in overlap.found(df).collect()} == {(1, 2), (6, 7)}
    assert overlap.found(df.limit(0)).count() == 0
    report = {r.split_name: (r.n_rows, r.n_exact, r.n_near) for r in overlap.report(df).collect()}
    assert report == {"test": (2, 1, 1)}


def test_index_finds_maximal_matches():
    import numpy as np

    index = overlap.FMIndex(["P1", "P1", "P2"], ["abcd", "abxd", "abcd"])
    lo, hi = index.find(["P1", "P9", "P2", "P"])
    assert (hi - lo).tolist() == [2, 0, 1, 0]
    p, r, e, span = index.search(lo, hi, ["abcd", "abcd", "abd", "abcd"], np.zeros(4, np.int64))
    assert sorted(set(zip(p.tolist(), r.tolist(), e.tolist()))) == [(0, 0, 0), (0, 1, 1), (2, 2, 1)]
    assert max(s for i, j, s in zip(p, r, span) if (i, j) == (0, 1)) == 1


def test_spans_of_both_sides_are_merged():
    import pandas as pd

    work = overlap.ShardIndex(["P1", "P1", "P2"], ["abcdefgh", "abcxefgh", "zzz"])
    rows = work.stream(pd.Series(["P1", "P2"]), pd.Series(["abcdefgh", "zz"])).sort_values("eval_other")
    assert rows[["eval_other", "train_other", "edits", "prefix", "suffix"]].values.tolist() == [["abcdefgh", "abcdefgh", 0, 8, 8], ["abcxefgh", "abcdefgh", 1, 0, 4], ["zzz", "zz", 1, 2, 2]]


def test_wavelet_counts():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, sigma in ((1, 2), (64, 3), (1000, 40), (70_000, 300), (65_536, 5)):
        text = rng.integers(1, sigma + 1, n)
        w = overlap.Wavelet(text)
        i, c = rng.integers(0, n + 1, 300), rng.integers(1, sigma + 1, 300)
        assert w.rank(c, i).tolist() == [int((text[:x] == y).sum()) for x, y in zip(i, c)]
        at = rng.integers(0, n, 300)
        assert w.at(at).tolist() == text[at].tolist()


def test_copies(make_edges):
    rows = [("637 44.0", "W1", "Inhibits"), ("w-1", "63744", "in_hibits"), ("63744", "W1", "inhibits"), ("63744", "W2", "inhibits"), (None, "W1", "inhibits"), (None, "W1", "inhibits"), ("", "W1", "inhibits"), ("63744", "W1", None), ("1W", "44736", "inhibits")]
    df = make_edges(rows)
    assert sorted(map(tuple, dedup.found(df).collect())) == [(1, 2), (1, 3)]
    got = {r.keep_id: r.n_copies for r in dedup.collapsed(df).collect()}
    assert got == {1: 3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    assert dedup.found(df.limit(0)).count() == 0
    assert dedup.collapsed(df.limit(0)).count() == 0


def test_copies_in_a_hot_group(make_edges):
    rng = random.Random(5)
    rows = [("A1", "B2", "r")] * 100 + [("".join(rng.choice("XY") for _ in range(9)), "B2", "r") for _ in range(200)]
    want = {}
    for i, (a, b, r) in enumerate(rows):
        want.setdefault((min(a, b), max(a, b), r), []).append(i + 1)
    want = {(min(g), i) for g in want.values() for i in g if i != min(g)}
    assert {tuple(r) for r in dedup.found(make_edges(rows)).collect()} == want


def union(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in rows:
        for x in (a, b):
            if x:
                find(x)
        if a and b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    out = {x: find(x) for x in parent}
    least = {}
    for x, r in out.items():
        least[r] = min(least.get(r, x), x)
    return {(x, least[r]) for x, r in out.items()}


@pytest.mark.parametrize("links", [0, 200_000])
def test_components(make_edges, monkeypatch, links):
    monkeypatch.setattr(components, "TASK_LINKS", links)
    rng = random.Random(links)
    rows = [(f"N{rng.randrange(300)}", f"N{rng.randrange(300)}", "r") for _ in range(150)]
    rows += [("HUB", f"N{i}", "r") for i in range(60)] + [(f"C{i}", f"C{i + 1}", "r") for i in range(300)] + [(None, "Z1", "r"), ("Z2", "", "r"), (None, None, "r"), ("L1", "L1", "r")]
    df = make_edges(rows)
    assert {tuple(r) for r in components.entity_groups(df).collect()} == union(rows)
    assert components.entity_groups(df.limit(0)).count() == 0


def test_splits_keep_groups_together(make_edges):
    rng = random.Random(9)
    rows = [("BIG", f"B{i}", "r") for i in range(400)] + [(f"S{i}", f"T{i}", "r") for i in range(500) for _ in range(rng.choice([1, 1, 2, 3]))] + [(None, None, "r")] * 5
    df = make_edges(rows)
    got = components.assign_splits(df).collect()
    assert len(got) == len(rows) and len({r.interaction_id for r in got}) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.group_id, set()).add(r.split_name)
    assert all(len(s) == 1 for s in per.values())
    share = {s: sum(r.split_name == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    again = components.assign_splits(df.repartition(5)).collect()
    assert {(r.interaction_id, r.split_name) for r in got} == {(r.interaction_id, r.split_name) for r in again}
    assert components.assign_splits(df.limit(0)).count() == 0
    assert df.agg(F.count("*")).first()[0] == len(rows)
