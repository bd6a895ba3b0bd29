"""Calls to a slow service from inside a task: several at once, each with its own deadline."""

import heapq
import itertools
import queue
import threading
import time

# Calls at once, seconds for each, calls per item, and seconds to wait
# between them at least and at most.
WIDTH = 10
DEADLINE = 120.0
TRIES = 5
FIRST_WAIT, LONGEST_WAIT = 2.0, 30.0
#: Items that may wait for another try before no new ones are taken in.
WAITING = 100


class Expired(Exception):
    """A call that had not ended by its deadline."""


def pause(turn, first=FIRST_WAIT, longest=LONGEST_WAIT):
    """Seconds before the next call once ``turn`` + 1 have failed."""
    return min(longest, first * 2**turn)


def windowed(items, call, width=WIDTH, deadline=DEADLINE, tries=TRIES, first=FIRST_WAIT, longest=LONGEST_WAIT,
             waiting=WAITING):
    """(item, result, error) of ``call(item)`` for every item, in the order in which they end.

    At most ``width`` calls run at once; the next item is drawn when one ends, so a slow
    call holds up no other. A call that raises, or has not ended after ``deadline``
    seconds, counts as failed; its item is called again after a wait that doubles from
    ``first`` to ``longest``, during which it takes no place among the running ones. After
    ``tries`` calls the last error is given and the result is None. A call past its deadline
    can't be stopped: its late result is ignored and its thread, until then, of no use, so a client
    should have a time limit of its own too. Otherwise threads serve one call after the other. The client must bear calls from several threads.
    """
    ended, given, numbers = queue.SimpleQueue(), queue.SimpleQueue(), itertools.count()
    threads, idle = [], 0  # idle: those that wait for a call
    source, more = iter(items), True
    running, due = {}, []  # call number: (item, turn, end of its time); (time, number, item, turn)

    def work():
        for number, item in iter(given.get, None):
            try:
                ended.put((number, call(item), None))
            except Exception as error:  # noqa: BLE001 - given to the caller with the item
                ended.put((number, None, error))

    def start(item, turn):
        nonlocal idle
        number = next(numbers)
        running[number] = (item, turn, time.monotonic() + deadline)
        given.put((number, item))
        if idle:
            idle -= 1
        else:
            threads.append(threading.Thread(target=work, daemon=True))
            threads[-1].start()

    try:
        while True:
            now = time.monotonic()
            while len(running) < width:
                if due and due[0][0] <= now:
                    start(*heapq.heappop(due)[2:])
                elif more and len(due) < waiting:
                    try:
                        item = next(source)
                    except StopIteration:
                        more = False
                    else:
                        start(item, 0)
                else:
                    break
            if not running and not due:
                return
            wake = min([end for _, _, end in running.values()] + ([due[0][0]] if due and len(running) < width else []))
            finished = []
            try:
                finished.append(ended.get(timeout=max(0.0, wake - now)))
                while not ended.empty():
                    finished.append(ended.get())
                idle += len(finished)
            except queue.Empty:
                now = time.monotonic()
                late = [n for n, (_, _, end) in running.items() if end <= now]
                finished += [(n, None, Expired(f"no answer within {deadline:g} s")) for n in late]
            for number, result, error in finished:
                if number not in running:  # answered after its deadline
                    continue
                item, turn, _ = running.pop(number)
                if error is None or turn + 1 == tries:
                    yield item, result, error
                else:
                    at = time.monotonic() + pause(turn, first, longest)
                    heapq.heappush(due, (at, number, item, turn + 1))
    finally:
        for _ in threads:  # one left behind ends when its call does
            given.put(None)
