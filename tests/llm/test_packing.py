from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_item_once_and_fits(histogram):
    runs, made = packing.plan(histogram, 64)
    used, slots, placed = Counter(), set(), Counter()
    for size, lo, hi, first, each, slot, offset in runs:
        assert lo == placed[size]
        placed[size] = hi
        for r in range(lo, hi):
            c, k = first + (r - lo) // each, slot + (r - lo) % each
            assert (c, k) not in slots and offset + (r - lo) % each * size + size <= 64
            slots.add((c, k))
            used[c] += size
    assert placed == Counter(histogram) and set(used) == set(range(made))
    assert all(v <= 64 for v in used.values())


def best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fit = [k for k, f in enumerate(free) if f >= s]
        if fit:
            free[min(fit, key=lambda k: free[k])] -= s
        else:
            free.append(capacity - s)
    return len(free)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_as_few_containers_as_best_fit_over_items(sizes):
    _, made = packing.plan(Counter(sizes), 32)
    assert made <= best_fit(sizes, 32) + 1


def test_too_large_for_a_plan():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_BUCKET", 50)
    data = [(i, [3, 5, 8, 8, 8, 0, 21, None][i % 8], "z") for i in range(800)] + [(5000, 3, "z"), (5000, 3, "z")]
    df = spark.createDataFrame(data, "doc_id bigint, n bigint, slot string").cache()
    out = packing.pack(df, "doc_id", "n", 8).collect()
    assert sum(r["size"] for r in out) == sum(n or 0 for _, n, _ in data)
    spans, docs = defaultdict(list), Counter()
    for r in out:
        docs[r.doc_id] += r["size"]
        if r["size"]:
            spans[r.container_id].append((r.container_offset, r.container_offset + r["size"], r.slot))
    assert len(docs) == 801 and docs[5000] == 6
    for v in spans.values():
        v.sort()
        assert v[-1][1] <= 8 and all(a[1] <= b[0] for a, b in zip(v, v[1:])) and len({k for *_, k in v}) == len(v)
    whole = Counter(r.doc_id for r in out if r.doc_id < 800)
    assert all(whole[i] == (3 if i % 8 == 6 else 1) for i in range(800))
    zero = [r for r in out if not r["size"]]
    assert all(r.slot is None for r in zero) and len({r.container_id for r in zero}) > 1
    assert packing.pack(df.limit(0), "doc_id", "n", 8).count() == 0


def test_kinds_of_containers(spark):
    counts = spark.createDataFrame([(1, 3), (2, 6)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("a", 8), ("b", 16), ("none", 0), ("null", None)], "container_name string, capacity_tokens int")
    got = {(r.container_name, r.doc_id): r.container_id for r in packing.pack_by_tokens(counts, kinds, "doc_id").collect()}
    assert len(got) == 4 and got["b", 1] == got["b", 2] and got["a", 1] != got["a", 2]
    assert packing.pack_by_tokens(counts, kinds.limit(0), "doc_id").count() == 0
