"""Core numbers block by block against peeling one by one, and the number of rounds of a long chain."""

import random

from cladeworks.operators import graph


def peeled(edges, n):
    near = {v: set() for v in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    core, level, left = {}, 0, set(near)
    while left:
        v = min(left, key=lambda x: len(near[x] & left))
        level = max(level, len(near[v] & left))
        core[v] = level
        left.remove(v)
    return core


def frames(spark, edges, n):
    both = [(a, b) for x in edges for a, b in (x, x[::-1])]
    return spark.createDataFrame(both, "src bigint, dst bigint"), spark.range(n)


def test_blocks_and_hubs_settle_at_the_core_numbers(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)] + [(41, v) for v in range(41)] + [(5, 5)]
    both, nodes = frames(spark, edges, 44)  # 40, 42 and 43 have few or no links
    want = peeled(edges, 44)
    for size in (30, 120, 1 << 19):
        assert dict(map(tuple, graph.kcore(both, nodes, size).collect())) == want


def test_a_chain_takes_a_round_a_block(spark, monkeypatch):
    rounds, stage = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: (rounds.append(label), stage(df, label))[1])
    n = 120
    edges = [(i, i + k) for i in range(n) for k in (1, 2, 3) if i + k < n]
    both, nodes = frames(spark, edges, n)
    assert dict(map(tuple, graph.kcore(both, nodes).collect())) == peeled(edges, n) == dict.fromkeys(range(n), 3)
    assert rounds.count("kcore") <= 4
