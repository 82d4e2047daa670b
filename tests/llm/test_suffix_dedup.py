import collections
import hashlib

import numpy as np
import pytest

from metaeval.llm import suffix_dedup as s


def brute_force(rows, match):
    """Per row: bytes, bytes that go, runs of them, digest of the rest."""
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[p:p + match] for b in data for p in range(len(b) - match + 1))
    out = []
    for (name, _), b in zip(rows, data):
        mark = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - match + 1):
            if seen[b[p:p + match]] > 1:
                mark[p] += 1
                mark[p + match] -= 1
        gone = np.cumsum(mark)[:len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((name, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in s.dedup_digests(df).collect()), key=str)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_suffix_arrays_and_common_prefixes(letters):
    rng = np.random.default_rng(letters)
    for _ in range(20):
        text = rng.integers(97, 97 + letters, rng.integers(1, 200)).astype(np.uint8)
        order, rank = s.suffix_array(text)
        whole = text.tobytes()
        assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        assert (rank[order] == np.arange(len(whole))).all()
        shared = s.common_prefixes(text, order, rank, np.array([0]), np.array([len(text)]), 50)
        for place in range(1, len(whole)):
            a, b = whole[order[place - 1]:], whole[order[place]:]
            assert shared[place] == min(50, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_windows_found_in_another_array():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 99, 300).astype(np.uint8) for _ in range(2))
    b[100:140] = a[20:60]
    hit = s.repeated_in_other(a, np.array([0]), np.array([292]), b, s.suffix_array(b)[0], np.array([0]), np.array([292]), match=9)
    others = {b[i:i + 9].tobytes() for i in range(292)}
    assert hit.tolist() == [i < 292 and a[i:i + 9].tobytes() in others for i in range(300)]


def test_runs_name_equal_anchors_for_equal_windows():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    text[250:330] = text[30:110]
    row, first, windows, anchor, _ = s.find_runs(text, np.array([0, 200, 400]), match=24, gram=6)
    by_window, names = {}, {}
    for r, f, w, a in zip(row, first, windows, anchor):
        for p in range(f, f + w):
            assert 200 * r <= p <= 200 * (r + 1) - 24
            by_window[p] = a
            names.setdefault(text[p:p + 24].tobytes(), set()).add(int(a))
    assert len(by_window) == 2 * (200 - 23) and all(len(v) == 1 for v in names.values())


def test_documents(docs, texts):
    got = result(docs)
    assert got == brute_force(list(texts.items()), s.MATCH) and any(r[2] for r in got)


@pytest.mark.parametrize("size", [None, 2000])
def test_odd_rows(odd, none, size, monkeypatch):
    """With small shards an anchor has several, which are merged."""
    if size:
        monkeypatch.setattr(s, "SHARD_BYTES", size)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == brute_force(rows, s.MATCH)
    assert result(none) == []
    kept = s.without_repeats(odd).collect()
    assert len(kept) == len(rows) and sum(r["text"] is None for r in kept) == sum(t is None for _, t in rows)


def test_ranges_that_touch_are_one_run():
    first, end = s.merged(np.array([0, 3, 9, 10]), np.array([3, 5, 10, 20]))
    assert (first.tolist(), end.tolist()) == ([0, 9], [5, 20])
