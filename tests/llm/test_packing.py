"""Containers: nothing lost, nothing over capacity, little unused."""

import random

import pytest

from anamnesis.llm.packing import Stock, container_report, fill_containers, plan_containers, plan_ranks


def check(plan, histogram, capacity):
    left = dict(histogram)
    for times, chosen in plan:
        assert times > 0 and sum(chosen) <= capacity
        for x in chosen:
            left[x] -= times
    assert all(v == 0 for v in left.values())


@pytest.mark.parametrize("seed", range(4))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 512])
    histogram = {x: rng.randrange(1, 50) for x in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    plan = plan_containers(histogram, capacity)
    check(plan, histogram, capacity)
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    big = sum(v for k, v in histogram.items() if 2 * k > capacity)
    assert sum(t for t, _ in plan) <= 1.15 * max(least, big) + 2


def test_the_index_of_sums_stays_exact():
    rng = random.Random(4)
    histogram = {x: rng.randrange(1, 4) for x in rng.sample(range(1, 90), 30)}
    stock = Stock(histogram, 100)
    while len(left := [x for x in range(101) if stock.counts[x]]) > 2:
        for gap in range(2, 101):
            assert stock.ways[gap] == sum(a < gap - a and gap - a in left for a in left)
            found = stock.complement(gap)
            exact = any(stock.counts[a] for a in (gap,)) or any((a != gap - a or stock.counts[a] > 1) and gap - a in left for a in left)
            triples = any(a + b + c == gap and all([a, b, c].count(x) <= stock.counts[x] for x in (a, b, c)) for a in left for b in left for c in left)
            assert (found is not None) == (exact or triples)
            assert found is None or (sum(found) == gap and len(found) <= 3 and all(found.count(x) <= stock.counts[x] for x in found))
        stock.take(rng.choice(left))


def test_many_lengths_are_planned_in_seconds():
    import time

    rng = random.Random(6)
    histogram = {min(131_072, max(1, int(rng.lognormvariate(8.5, 1.2)))): 1 for _ in range(60_000)}
    began = time.time()
    plan = plan_containers(histogram, 131_072)
    assert time.time() - began < 60
    check(plan, histogram, 131_072)
    least = -(-sum(k * v for k, v in histogram.items()) // 131_072)
    assert sum(t for t, _ in plan) <= 1.01 * least + 2


def test_exact_complements_fill_completely():
    histogram = {7: 10, 3: 10, 5: 4, 2: 3, 4: 6}
    plan = plan_containers(histogram, 10)
    check(plan, histogram, 10)
    assert sum(t for t, _ in plan) == -(-sum(k * v for k, v in histogram.items()) // 10)


def test_one_hot_length():
    plan = plan_containers({6: 1_000_000}, 10)
    assert sum(t for t, _ in plan) == 1_000_000 and len(plan) == 1
    assert plan_ranks(plan)[6].tolist() == [[0, 0, 1]]
    assert plan_containers({}, 10) == []


def test_frame(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([3, 3, 3, rng.randrange(1, 40)])) for i in range(500)] + [(500, 25), (501, 20), (502, 0), (503, None), (501, 20)]
    sizes = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 AS capacity")
    budgets = spark.createDataFrame([("small", 10), ("large", 100), ("small", 10), ("none", None), ("zero", 0)], "budget_name string, capacity bigint")
    got = fill_containers(sizes, budgets).collect()
    for name, cap in (("small", 10), ("large", 100)):
        own = [r for r in got if r["budget_name"] == name]
        used, by_doc = {}, {}
        for r in own:
            used[r["container_no"]] = used.get(r["container_no"], 0) + r["n_tokens"]
            by_doc.setdefault(r["doc_id"], []).append((r["part_no"], r["n_tokens"]))
        assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
        for d in {d for d, n in items if n}:
            assert sum(n for _, n in by_doc[d]) == sum(n for i, n in items if i == d)
        assert [n for _, n in sorted(by_doc[500])] == ([10, 10, 5] if cap == 10 else [25])
    assert {r["budget_name"] for r in got} == {"small", "large"}
    report = {r["budget_name"]: r for r in container_report(fill_containers(sizes, budgets)).collect()}
    assert report["large"]["containers"] - report["large"]["least_containers"] <= 1
    assert fill_containers(sizes.limit(0), budgets).count() == 0
