import random
from collections import Counter
from itertools import combinations

from assaylens.llm import packing


def _helps(low, high, room):
    """Whether any exchange of one or two pieces that improve() lists makes *high* fuller."""
    mine, theirs = ([s for s, n in kind for _ in range(n)] for kind in (low, high))
    pairs = lambda sizes: [sum(p) for p in combinations(sizes, 2)]
    given = [(x, 0) for x in mine] + [(x, y) for x in mine for y in theirs + pairs(theirs)] + [(x, y) for x in pairs(mine) for y in theirs]
    return any(0 < x - y <= room for x, y in given)


def test_one_for_two_tries_the_next_partner():
    assert packing._exchange(((13, 1),), ((20, 1), (7, 1), (5, 1)), 5) == ({13: 1}, {5: 1, 7: 1})


def test_no_exchange_is_left():
    rng = random.Random(3)
    for _ in range(300):
        low, high = (packing._with((), Counter(rng.randint(3, 30) for _ in range(rng.randint(1, 4)))) for _ in "ab")
        room = rng.randint(0, 6)
        assert bool(packing._exchange(low, high, room)) == _helps(low, high, room), (low, high, room)
    for _ in range(40):
        capacity = rng.randint(30, 60)
        counts = Counter(rng.randint(3, capacity // 2) for _ in range(rng.randint(10, 60)))
        bins = packing.improve(packing.best_fit(counts, capacity), capacity)
        if bins.total() > -(-sum(s * n for s, n in counts.items()) // capacity):
            under = [k for k in bins if packing._fill(k) < capacity]
            for low in under:
                for high in under:
                    if packing._fill(high) >= packing._fill(low) and (high != low or bins[low] > 1):
                        assert not _helps(low, high, capacity - packing._fill(high))
