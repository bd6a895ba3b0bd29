"""Concurrent calls with deadlines and waits."""

import threading
import time

from vitrine.operators.calls import Expired, windowed


class Counter:
    def __init__(self):
        self.lock, self.now, self.most = threading.Lock(), 0, 0

    def __enter__(self):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)

    def __exit__(self, *_):
        with self.lock:
            self.now -= 1


def test_slow_calls_overlap_up_to_the_width():
    counter = Counter()

    def slow(item):
        with counter:
            time.sleep(0.05)
        return item * 2

    start = time.monotonic()
    found = list(windowed(range(100), slow))
    took = time.monotonic() - start
    assert sorted((i, r) for i, r, e in found if e is None) == [(i, 2 * i) for i in range(100)]
    assert counter.most == 10
    assert took < 100 * 0.05 / 5  # one by one it takes 5 s


def test_answers_come_as_they_end():
    order = [i for i, _, _ in windowed([0.4, 0.01, 0.1], lambda s: time.sleep(s))]
    assert order == [0.01, 0.1, 0.4]


def test_a_waiting_item_holds_up_no_other():
    tried = {}

    def call(item):
        tried.setdefault(item, []).append(time.monotonic())
        if item == "bad":
            raise OSError("down")
        return item

    found = list(windowed(["bad", *range(30)], call, width=1, tries=4, first=0.05, longest=0.1))
    assert found[-1][0] == "bad" and str(found[-1][2]) == "down" and found[-1][1] is None
    assert [i for i, _, _ in found[:-1]] == list(range(30))
    gaps = [b - a for a, b in zip(tried["bad"], tried["bad"][1:])]
    assert len(gaps) == 3 and gaps[0] >= 0.05 and all(g >= 0.1 for g in gaps[1:])
    assert gaps[2] < 0.3  # the wait no longer doubles


def test_a_hung_call_expires_and_is_tried_again():
    seen = []

    def call(item):
        seen.append(item)
        if item == "hangs" or (item == "once" and seen.count("once") == 1):
            time.sleep(1.0)
        return item

    found = {i: (r, e) for i, r, e in windowed(["hangs", "once", "fine"], call, deadline=0.1, tries=2, first=0.01)}
    assert found["fine"] == ("fine", None) and found["once"] == ("once", None)
    assert isinstance(found["hangs"][1], Expired) and seen.count("hangs") == 2


def test_few_items_wait_at_once_and_none_is_lost():
    drawn = []

    def source():
        for i in range(60):
            drawn.append(i)
            yield i

    failed = {}

    def call(item):
        failed[item] = failed.get(item, 0) + 1
        if failed[item] < 3:
            assert len(drawn) <= item + 2 * 5 + 4
            raise ValueError(item)
        return item

    found = list(windowed(source(), call, width=2, tries=3, first=0.001, waiting=5))
    assert sorted(i for i, _, _ in found) == list(range(60))
    assert list(windowed([], call)) == []
