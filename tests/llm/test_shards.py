import random
import zlib
from collections import defaultdict

import pytest

from sparkloom.llm import shards


def naive(sizes, capacity, bins):
    """Best-fit decreasing, one item at a time; the loads of the bins."""
    room = [capacity] * (bins or 0)
    for size in sorted((s for s, n in sizes for _ in range(n)), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= size]
        if fits:
            k = min(fits, key=lambda k: (room[k], k))
        elif bins:
            k = max(range(bins), key=lambda k: room[k])
        else:
            room.append(max(capacity, size))
            k = len(room) - 1
        room[k] -= size
    return sorted(room)


def loads(sizes, runs, capacity, count):
    room = defaultdict(int)
    seen = defaultdict(list)
    for k, rank, n, first, each in runs:
        seen[k] += range(rank, rank + n)
        for i in range(n):
            room[first + i // each] += sizes[k][0]
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, (_, n) in enumerate(sizes) if n}
    return room


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [(s, rng.randint(1, 9)) for s in rng.sample(range(1, 60), 12)]
    capacity = shards.even_capacity(sizes, 5)
    own = loads(sizes, shards.plan(sizes, capacity, 5), capacity, 5)
    assert sorted(capacity - own[k] for k in range(5)) == naive(sizes, capacity, 5)
    opened = loads(sizes, shards.plan(sizes, 80), 80, None)
    assert len(opened) == len(naive(sizes, 80, None)) and max(opened.values()) <= 80


def test_shards(documents, prose):
    rows = [(k, prose(prose.rng.randint(1, 40))) for k in range(400)] + [(1000 + k, "a hot text of some length") for k in range(300)] + [(5000, None), (5001, ""), (None, "x"), (7, "y")]
    found = shards.shard_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    by_text, by_shard = defaultdict(set), defaultdict(list)
    texts = defaultdict(set)
    for k, t in rows:
        texts[k].add(t or "")
    for r in found:
        match = [t for t in texts[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32 and len(t.encode()) + 1 == r.size]
        assert match and r.law == "bytes" and r.grown_shard is None
        by_text[match[0]].add(r.shard)
        by_shard[r.shard].append((r.slot, r.size))
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by_shard.values())
    total = {k: sum(s for _, s in v) for k, v in by_shard.items()}
    hot = next(iter(by_text["a hot text of some length"]))
    rest = [v for k, v in total.items() if k != hot]
    assert set(total) <= set(range(16)) and max(rest) - min(rest) <= 8


def test_empty_table(documents):
    assert shards.shard_documents(documents([])).count() == 0


def test_large_sizes_share_classes(spark):
    rows = [(k,) for k in (1, 65_536, 65_537, 65_538, 10**6, 10**6 + 1, 2**40)]
    found = [r[0] for r in spark.createDataFrame(rows, "s long").select(shards.size_class(shards.F.col("s"))).collect()]
    assert found[0] == 1 and found[1] == 65_536 and found[2] == found[3] and found[4] == found[5] and found[6] == 2**40
    assert all(c <= s < c * (1 + 2**-9) for (s,), c in zip(rows, found, strict=True))
