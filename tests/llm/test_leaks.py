import random
import tracemalloc

import pytest

from anchorspan.llm import leaks
from tests.llm.test_llm import search_distance


def brute(items, docs, window, errors):
    want = {}
    for d, text in enumerate(docs):
        words = leaks.words_of(text)
        for i, passage in items:
            p = leaks.words_of(passage)
            least = min((search_distance(p[k : k + window], words) for k in range(len(p) - window + 1)), default=99)
            if least <= errors:
                want[d, i] = least
    return want


@pytest.mark.parametrize(("seed", "window", "errors", "hits"), [(1, 13, 1, 7), (2, 13, 1, 200_000), (3, 8, 2, 5), (4, 5, 0, 1), (5, 13, 0, 11), (6, 70, 1, 50)])
def test_shared_openings_against_brute_force(monkeypatch, seed, window, errors, hits):
    """Items that begin alike, texts that repeat themselves, copies of texts, and blocks of any size."""
    monkeypatch.setattr(leaks, "BLOCK_HITS", hits)
    rng = random.Random(seed)
    opening = "which of the following is the".split()
    some = lambda n: rng.choices(["alpha", "beta", "gamma", "delta", "of", "the", "is"], k=n)
    items = [(i, " ".join(opening[: rng.randint(2, 6)] * rng.randint(1, 2) + some(rng.randint(3, window + 12)))) for i in range(14)]
    docs = [None, "", " ".join(opening * 40)]
    for _ in range(25):
        words = some(rng.randint(0, 6))
        for _ in range(rng.randint(1, 3)):
            passage = rng.choice(items)[1].split()
            at = rng.randint(0, len(passage) - 1)
            part = passage[at : at + window + rng.randint(-2, 3)]
            if part and rng.random() < 0.6:
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["new"], [part[k], "new"]])
            words += part + some(rng.randint(0, 2))
        docs.append(" ".join(words))
    docs += docs[3:8]
    got = {(d, i): dist for d, i, dist, _ in leaks.Matcher(items, window, errors).find(docs)}
    assert got == brute(items, docs, window, errors) and got


def test_the_first_place_of_the_least_distance():
    item = "a b c d e f g h i j k l m n o p"
    near, exact = "x a b c d e f g Q i j k l m", "y a b c d e f g h i j k l m"
    assert list(leaks.Matcher([(7, item)], 13, 1).find([f"{near} {exact} {exact}"])) == [(0, 7, 0, 15)]


def test_twenty_thousand_items_with_one_opening_in_bounded_memory():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    opening = "which of the following is"
    items = [(i, f"{opening} {' '.join(rng.choices(words, k=20))}") for i in range(20_000)]
    texts = [(opening + " ") * (leaks.SLICE // len(opening + " "))] + [f"{' '.join(rng.choices(words, k=60))} {opening} {' '.join(rng.choices(words, k=60))}" for _ in range(60)] + [items[77][1]]
    tracemalloc.start()
    got = list(leaks.Matcher(items, 13, 1).find(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:3] for r in got] == [(61, 77, 0)]
    assert peak < 500e6
