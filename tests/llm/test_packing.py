import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stocklore.llm.packing import ExactComplement, fill_report, pack, plan


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_places_everything(histogram):
    load, used = defaultdict(int), Counter()
    for u in plan(histogram, 40):
        used[u.length] += u.each * u.containers
        for c in range(u.base, u.base + u.containers):
            load[c] += u.length * u.each
    assert used == Counter(histogram) and all(0 < x <= 40 for x in load.values())
    assert sorted(load) == list(range(len(load)))
    total = sum(k * n for k, n in histogram.items())
    assert len(load) <= 1 + 2 * total // 40  # never two containers that would fit one


def test_pack_whole_tables(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([100, 100, 100, rnd.randrange(1, 700)])) for i in range(2000)] + [(9001, 1700), (9002, 0), (9003, None), (9004, 512)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    got = pack(df, 512).collect()
    load, per = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container_id] += r.length
        per[r.doc_id].append((r.start, r.length))
    assert max(load.values()) <= 512
    for i, n in rows:
        pieces = sorted(per.get(i, []))
        assert sum(x for _, x in pieces) == (n or 0)
        assert len(pieces) == (-(-n // 512) if n else 0)  # only what exceeds the capacity is split
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    report = fill_report(pack(df, 512), 512).first()
    assert report.containers <= 1.02 * report.least_containers + 1
    assert sorted(map(tuple, pack(df, 512).collect())) == sorted(map(tuple, got))
    assert pack(df.limit(0), 512).count() == 0


def test_triples_beyond_the_largest_lengths():
    counts = np.zeros(2049, np.int64)
    counts[1001:1401] = 5
    counts[500] = 3
    assert ExactComplement(counts).find(1500) == (500, 500, 500)
    counts[500] = 2
    assert ExactComplement(counts).find(1500) is None
    rng = np.random.default_rng(3)
    for _ in range(300):
        counts = np.zeros(41, np.int64)
        counts[rng.integers(1, 41, 4)] = rng.integers(1, 4, 4)
        items = [i for i in range(41) for _ in range(counts[i])]
        for gap in range(1, 41):
            found = ExactComplement(counts).find(gap)
            possible = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
            assert bool(found) == possible and (not found or (sum(found) == gap and all(counts[x] >= found.count(x) for x in found)))
