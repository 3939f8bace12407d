"""The pending-orphan ledger: any order of arrival leads to the same orphans."""

import random

import pytest

from tidemark.operators.orphans import DELETIONS, PARENTS, REFERENCES, OrphanLedger, replay

DAY = 86_400_000_000


def world(seed):
    rng = random.Random(seed)
    parents, deletions = [], []
    for i in range(30):
        key, a = rng.choice("ABCDE"), rng.randrange(300) * DAY
        parents.append((i, "pairs", key, a))
        if rng.random() < 0.6:
            deletions.append((i, "pairs", key, a + rng.randrange(-5, 60) * DAY))
    refs = [("pairs", rng.choice("ABCDEF"), "orders", i, rng.randrange(400) * DAY) for i in range(150)]
    refs += refs[:5] + [("pairs", None, "orders", 900, DAY), ("pairs", "A", "orders", 901, None)]
    ends = {i: t for i, _, _, t in deletions}
    wanted = sorted(r[3] for r in refs if r[1] and r[4] is not None and not any(k == r[1] and a <= r[4] < ends.get(i, 10**18) for i, _, k, a in parents))
    return refs, parents, deletions, wanted


def frames(spark, refs, parents, deletions):
    return spark.createDataFrame(refs, REFERENCES), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(deletions, DELETIONS)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, seed):
    refs, parents, deletions, wanted = world(seed)
    rng, ledger = random.Random(seed), OrphanLedger(spark)
    parts = [[[], [], []] for _ in range(3)]
    for which, rows in enumerate((refs, parents, deletions)):
        for r in rows:
            rng.choice(parts)[which].append(r)
    for p in parts:
        ledger.apply(*frames(spark, *p))
    assert sorted(r["row_id"] for r in ledger.waiting().collect()) == wanted
    counts = ledger.snapshots().where("epoch = 2").groupBy().sum("orphans").head()[0]
    assert counts == len(wanted)


def test_replay_by_time(spark):
    refs, parents, deletions, wanted = world(3)
    got = replay(spark, *frames(spark, refs, parents, deletions), epochs=2).waiting().collect()
    assert sorted(r["row_id"] for r in got) == wanted


def test_resolve_reopen_resolve(spark):
    ledger = OrphanLedger(spark)
    step = lambda r=(), p=(), d=(): ledger.apply(*frames(spark, list(r), list(p), list(d)))
    ids = lambda: [r["row_id"] for r in ledger.waiting().collect()]
    step(r=[("l", "A", "t", 1, 10)])
    assert ids() == [1]
    step(p=[(1, "l", "A", 5)])
    assert ids() == []
    step(d=[(1, "l", "A", 8)])
    assert ids() == [1]
    step(p=[(2, "l", "A", 9), (1, "l", "A", 5)])
    assert ids() == []
    step(d=[(2, "l", "A", 10)])
    assert ids() == [1]


def test_nothing_at_all(spark):
    assert replay(spark, *frames(spark, [], [], []), epochs=1).waiting().count() == 0
