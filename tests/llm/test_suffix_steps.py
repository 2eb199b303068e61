"""Steps of the suffix dedup against plain forms of them."""

from __future__ import annotations

import random

import numpy as np

from tallyforge.llm import lyndon
from tallyforge.llm import suffixdedup as sd


def test_groups_of_one_member_stay_in_order():
    """The suffix array with groups that are not moved when nothing is left behind, against sorting."""
    pick = random.Random(3)
    for _ in range(3000):
        text = [pick.randrange(pick.choice((1, 2, 3, 60))) for _ in range(pick.randrange(40))] * pick.choice((1, 1, 2, 3))
        assert lyndon.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_picks_are_the_leftmost_least_hash_of_each_window():
    """Any proportion of gram and window, texts of just one window included."""
    pick = random.Random(4)
    for length, gram in ((20, 12), (20, 19), (20, 20), (9, 1), (200, 120)):
        picker = sd.Picker(length, gram)
        for extra in (0, 1, 7, 300):
            raw = np.array([pick.randrange(3) for _ in range(length + extra)], np.uint8)
            ((offset, grams, place, first, last),) = picker.records(raw)
            hashes = {raw[i : i + gram].tobytes(): None for i in range(len(raw) - gram + 1)}
            for g, p in zip(grams.tolist(), place.tolist()):
                assert hashes[raw[p : p + gram].tobytes()] in (None, g)
                hashes[raw[p : p + gram].tobytes()] = g
            assert offset == first[0] == 0 and last[-1] == extra and (first[1:] == last[:-1] + 1).all()
            assert (place >= last).all() and (place + gram <= first + length).all()
            high = lambda h: (h % (1 << 64)) >> 20
            for k, p in enumerate(place.tolist()):  # the window that a pick begins or ends with has no lower known hash, nor an equal one to its left
                for w in (int(first[k]), int(last[k])):
                    for i in range(w, w + length - gram + 1):
                        other = hashes[raw[i : i + gram].tobytes()]
                        assert other is None or (high(grams[k].item()), p) <= (high(other), i)


def test_only_records_that_can_repeat_are_looked_at():
    """A gram's only record, counted once, is passed over, but for the first and last row of a batch."""
    gram = np.array([1, 2, 3, 3, 4, 5, 6])
    assert sd.may_repeat(gram, np.array([1, 1, 1, 1, 2, 1, 1])).tolist() == [True, False, True, True, True, False, True]
    assert sd.may_repeat(gram[:1], np.array([1])).tolist() == [True]
    assert sd.may_repeat(gram[:0], np.array([], np.int64)).tolist() == []
