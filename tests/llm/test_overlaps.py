"""Every overlap that counts is found, by going through all substitutions."""

import itertools
import math

import numpy as np

from tidemark.llm import decontaminate as D


def counts(equal):
    a, b, n = D.stretch(np.array(equal))
    return n >= min(D.MATCHED, math.ceil(D.SHARE * len(equal)))


def test_short_items_are_found_whatever_words_differ():
    for n in range(D.SHORTEST, 16):
        words = [f"w{i}" for i in range(n)]
        items = D.Items([(1, " ".join(words))], D.LIGHT)
        hashes, accepted = D.WordHashes(), 0
        for k in range(n - math.ceil(D.SHARE * n) + 1):
            for places in itertools.combinations(range(n), k):
                if counts([i not in places for i in range(n)]):
                    accepted += 1
                    text = ["before"] * 3 + [f"other{i}" if i in places else w for i, w in enumerate(words)] + ["after"] * 3
                    assert D.overlaps(hashes(text), items), (n, places)
        assert accepted > 1


def test_long_overlaps_hold_a_seed():
    """In its first 13 equal words an overlap has never more differing words than half the equal ones so far."""
    held = [("1", 1, 0)]
    full = []
    while held:
        p, ones, zeros = held.pop()
        if ones == D.MATCHED:
            full.append(p)
            continue
        held.append((p + "1", ones + 1, zeros))
        if ones >= 2 * (zeros + 1):
            held.append((p + "0", ones, zeros + 1))
    assert len(full) > 3000
    for p in full:
        assert any(all(p[s + x] == "1" for x in mask) for mask in D.LIGHT for s in range(len(p) - mask[-1])), p


def test_enough_in_chunks():
    r = np.random.default_rng(2)
    items = D.Items([(i, " ".join(r.choice(list("abcdefgh"), int(r.integers(5, 40))))) for i in range(30)], D.LIGHT)
    h = D.WordHashes()(r.choice(list("abcdefgh"), 300).tolist())
    pairs = sorted(map(tuple, items.laid(h).T.tolist()))
    assert pairs == sorted(map(tuple, items.laid(h, 7).T.tolist()))
    want = [sum(0 <= s + i < len(h) and h[s + i] == w for i, w in enumerate(items.words[k])) >= items.least[k] for k, s in pairs]
    assert D.enough(h, items, *np.array(pairs).T).tolist() == want
    assert D.overlaps(np.zeros(0, np.uint64), items) == {}


def brute(text, item):
    """Overlap by laying the item over the text at every place."""
    return any(
        counts([0 <= s + i < len(text) and text[s + i] == w for i, w in enumerate(item)][max(0, -s) : min(len(item), len(text) - s)] + [False] * (len(item) - (min(len(item), len(text) - s) - max(0, -s))))
        for s in range(-len(item) + 1, len(text))
    )


def test_recall_by_length_and_rate():
    r = np.random.default_rng(8)
    for n in (5, 8, 11, 12, 14, 20, 30, 60):
        for rate in (0.05, 0.1, 0.2, 0.25, 0.3):
            for _ in range(12):
                item = [f"w{x}" for x in r.integers(0, 5000, n)]
                text = [f"x{x}" for x in r.integers(0, 5000, 9)] + [f"y{i}" if r.random() < rate else w for i, w in enumerate(item)] + ["z"] * 4
                got = D.overlaps(D.WordHashes()(text), D.Items([(1, " ".join(item))], D.LIGHT))
                assert bool(got) == brute(text, item), (n, rate)


def test_repeated_words_stay_bounded():
    items = D.Items([(1, "a " * 400), (2, "a b " * 100)], D.LIGHT)
    h = D.WordHashes()(["a"] * 10_000)
    assert items.laid(h).shape[1] <= 2 * (len(h) + 400)
    assert set(D.overlaps(h, items)) == {0}


def test_short_items_are_whole_lines(spark):
    d = spark.createDataFrame([(1, "one\nWhat is  it?\nwhat is it"), (2, "so what is it then"), (3, None), (4, "")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "what is it"), (8, "one"), (9, "??"), (10, None)], "item_id long, text string")
    assert sorted(tuple(x)[:6] for x in D.find(d, b).collect()) == [(1, 7, 3, 3, 1, 4), (1, 8, 1, 1, 0, 1)]
    assert sorted(x.doc_id for x in D.apply(d, b).collect()) == [2, 3, 4]
    assert D.find(d, b.limit(0)).count() == 0 and D.apply(d.limit(0), b).count() == 0
