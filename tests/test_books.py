"""Nested order books: rows of both sides, and what changes between pulls."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.operators import series as s
from marketlens.sources import scans

ORDER = "array<struct<amount:int,price_per_unit:double,orders:smallint>>"
SCHEMA = f"event_id long, products array<struct<product_id:string,buy_summary:{ORDER},sell_summary:{ORDER}>>"
A, B, C = (1, 2.0, 1), (1, 2.5, 1), (2, 2.0, 1)
BOOKS = [[A, B], [A, B], [B, A], [A, A, B], None, [C], []]


@pytest.fixture(scope="module")
def pulls(spark):
    return spark.createDataFrame([(n, [("X", book, [C] if n else None), ("Y", [A], [])]) for n, book in enumerate(BOOKS)], SCHEMA)


def test_rows_of_both_sides(pulls, rows_of):
    rows = scans.order_rows(pulls)
    assert rows.count() == sum(len(b or []) for b in BOOKS) + 6 + 7
    first = rows.filter("event_id = 0 AND product_id = 'X'")
    assert rows_of(first, "side", "level", "amount", "price_per_unit") == [("buy_summary", 0, 1, 2.0), ("buy_summary", 1, 1, 2.5)]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_changes_are_a_difference_of_bags(pulls, block):
    """Places do not count, repeated orders do, a missing book is an empty one; the cut into blocks changes nothing."""
    found = {}
    for r in s.book_changes(scans.book_rows(pulls), ["product_id", "side"], "event_id", F.floor(F.col("event_id") / block)).collect():
        found.setdefault((r.product_id, r.side, r.event_id, r.change), Counter())[r.amount, r.price_per_unit, r.orders] = r.copies
    expected, before = {}, Counter()
    for n, book in enumerate(BOOKS):
        now = Counter(book or [])
        for change, diff in (("added", now - before), ("gone", before - now)):
            if diff:
                expected["X", "buy_summary", n, change] = diff
        before = now
    expected["X", "sell_summary", 1, "added"] = expected["Y", "buy_summary", 0, "added"] = None
    assert set(found) == set(expected)
    assert all(found[k] == v for k, v in expected.items() if v is not None)
