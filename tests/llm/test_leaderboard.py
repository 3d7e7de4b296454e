"""Operator 13 against a day-by-day replay, and a part's board against sorting all items."""

import datetime
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import leaderboard

SALES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, part string, `odd name` string"


def test_fold_keeps_the_best():
    rng = np.random.default_rng(2)
    items = np.sort(rng.choice(500, 60, replace=False)).astype(np.int64)
    standing, total = leaderboard.Standing(items, np.zeros(60, np.int64)), dict.fromkeys(items.tolist(), 0)
    for _ in range(300):
        some = np.sort(rng.choice(items, rng.integers(1, 9), replace=False))
        cents = rng.integers(-40, 40, len(some))
        before = standing.board
        told = standing.fold(some, cents)
        for i, c in zip(some.tolist(), cents.tolist(), strict=True):
            total[i] += c
        best = sorted(((i, r) for i, r in total.items() if r > 0), key=lambda x: (-x[1], x[0]))[:10]
        assert standing.board == best
        gone = [(i, total[i], False) for i, _ in before if i not in {j for j, _ in best}]
        assert told == ([] if best == before else [(i, r, True) for i, r in best] + gone)


def replay(sales, prices, homes):
    """The feed by its definition, line by line."""
    text = lambda v: "" if v is None else str(v)
    told, latest = [], defaultdict(lambda: -1)
    for sale, no, item, vendor, quantity, amount, _, flag, shipped, *_ in sales:
        h = zlib.crc32(",".join(map(text, (sale, item, vendor, no))).encode())
        s = 19723 + h % 150 if shipped is None else (shipped.date() - datetime.date(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        batch = min(8, 1 + math.floor((a - 19723) * 8 / 180))
        cents = math.floor(100 * amount + 0.5) if amount is not None else None
        if cents is None:
            price = prices.get(item)
            cents = quantity * math.floor(100 * price + 0.5) if quantity is not None and price is not None else 0
        told.append((a, s, batch, homes.get(vendor) if item in prices else None, item, -cents if flag == "swapped" else cents))
        latest[batch] = max(latest[batch], s)
    revenue, boards, out = defaultdict(lambda: defaultdict(int)), defaultdict(dict), set()
    for day in sorted({x[0] for x in told}):
        for a, s, batch, nation, item, cents in told:
            if a == day and nation is not None and s + 15 >= max([v for k, v in latest.items() if k < batch], default=-1):
                revenue[nation][item] += cents
        for nation, own in revenue.items():
            best = sorted(((i, r) for i, r in own.items() if r > 0), key=lambda x: (-x[1], x[0]))[:10]
            new, old = {i: k + 1 for k, (i, _) in enumerate(best)}, boards[nation]
            for item in new.keys() | old.keys():
                o, n = old.get(item), new.get(item)
                if o != n:
                    change = "enter" if o is None else "exit" if n is None else "move"
                    out.add((nation, day, item, min(8, 1 + math.floor((day - 19723) * 8 / 180)), change, o, n, own[item]))
            boards[nation] = new
    return out


def test_feed_against_replay(spark):
    rng = random.Random(4)
    maybe = lambda v, p=0.05: None if rng.random() < p else v
    first, sales = datetime.datetime(2024, 1, 1), []
    for k in range(1500):
        shipped = maybe(first + datetime.timedelta(days=rng.randrange(150), hours=rng.randrange(24)))
        item = 7 if rng.random() < 0.3 else rng.randrange(45)
        amount = maybe(rng.choice([0.005, 1.115, rng.random() * 900]), 0.1)
        sales.append((maybe(k // 3), rng.randrange(1, 4), maybe(item), maybe(rng.randrange(12)), maybe(rng.randrange(1, 9)), amount, 0.0, maybe(rng.choice(["kept", "swapped", "kept"])), shipped, "p", "x"))
    sales += sales[:40]
    prices = {i: maybe(round(1 + i * 1.37, 2)) for i in range(40)}
    homes = {v: maybe(v % 3, 0.1) for v in range(10)}
    made = (
        spark.createDataFrame(sales, SALES),
        spark.createDataFrame([(i, p, "n") for i, p in prices.items()], "item_id long, price double, part string"),
        spark.createDataFrame([(v, n, "n") for v, n in homes.items()], "vendor_id long, nation_id int, latest string"),
    )
    columns = ("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue")
    want = replay(sales, prices, homes)
    got = leaderboard.change_feed(*made, parts=3).collect()
    assert len(got) == len(want) and {tuple(r[c] for c in columns) for r in got} == want
    assert {r["change"] for r in got} == {"enter", "exit", "move"}


def test_empty_tables(spark):
    made = (
        spark.createDataFrame([], SALES),
        spark.createDataFrame([], "item_id long, price double"),
        spark.createDataFrame([], "vendor_id long, nation_id int"),
    )
    assert leaderboard.change_feed(*made).count() == 0


def test_starts_are_the_batches_and_one(spark):
    """Each start goes through all state, so the flush takes one beside the batches'; lines of the last batch are not late for it."""
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    sales = [(k, 1, k % 4, 0, 1, 10.0 + k, 0.0, "kept", day(k), "p", "x") for k in (*range(0, 150, 30), *range(160, 175))]
    made = (
        spark.createDataFrame(sales, SALES),
        spark.createDataFrame([(i, 1.0) for i in range(4)], "item_id long, price double"),
        spark.createDataFrame([(0, 1)], "vendor_id long, nation_id int"),
    )
    starts, given = [], leaderboard.publish
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(leaderboard, "publish", lambda s, source, target: starts.append(source) or given(s, source, target))
        got = leaderboard.change_feed(*made, parts=2).collect()
    columns = ("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue")
    want = replay(sales, dict.fromkeys(range(4), 1.0), {0: 1})
    assert len([x for x in starts if x]) == leaderboard.BATCHES + 1 and {tuple(r[c] for c in columns) for r in got} == want
