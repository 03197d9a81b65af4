import numpy as np
import pytest

from lintlake.llm.induced import TupleQueue, suffix_lcp


def brute(text):
    t = [int(x) for x in text]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


def check(text, **how):
    order, lcp = suffix_lcp(text, **how)
    want = brute(text)
    limit = how.get("limit", 65_000)
    assert order.tolist() == want[0] and lcp.tolist() == [min(x, limit) for x in want[1]]


@pytest.mark.parametrize("symbols", [2, 3, 5, 200])
@pytest.mark.parametrize("seed", range(12))
def test_random_texts(symbols, seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, symbols, rng.integers(4, 300)).astype(np.uint16)
    check(np.append(text, 0).astype(np.uint16))


@pytest.mark.parametrize("queue_bytes", [1, 1 << 20])
def test_copies_runs_and_a_queue_on_disk(queue_bytes):
    rng = np.random.default_rng(1)
    part = rng.integers(97, 101, 90)
    text = np.concatenate([part, [1], part[10:70], [1], np.full(60, 98), [1], part, np.tile([97, 98], 30), [0]]).astype(np.uint16)
    check(text, queue_bytes=queue_bytes)
    check(text, queue_bytes=queue_bytes, limit=25)


@pytest.mark.parametrize("text", [[0], [1, 0], [2, 1, 0], [1, 2, 0], [3, 3, 3, 0], [1, 2, 3, 4, 5, 0], [5, 4, 3, 2, 1, 0], [2, 1, 2, 1, 0]])
def test_small_texts(text):
    check(np.array(text, np.uint16))


def test_large_symbols_and_recursion():
    rng = np.random.default_rng(5)
    words = [rng.integers(1, 30, rng.integers(3, 9)) for _ in range(40)]
    text = np.concatenate([words[i] for i in rng.integers(0, 40, 300)] + [[0]]).astype(np.uint16)
    check(text)
    check(np.append(rng.integers(1, 50_000, 500), 0))


def test_queue_keeps_order():
    queue = TupleQueue(3, 40)
    for i in range(20):
        queue.push(i % 2, np.array([i], np.int32), np.array([i], np.uint16))
    assert queue.pop(0)[0].tolist() == list(range(0, 20, 2))
    assert queue.pop(1)[1].tolist() == list(range(1, 20, 2))
    assert queue.pop(2) is None
    queue.close()
