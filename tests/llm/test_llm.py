import functools
import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorspan.llm import boosting, bpe, leaks, quality, queries
from anchorspan.llm.holdout import HOLDOUT

FILE = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
here = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")
ODD = ["", None, "a", " ", "\n\n x ", "<|endoftext|> hi", "\x1c\x85\xa0 c", "é́ 漢字 🙂", "\x00", "don't 'S", "0123456789" * 30, "x" * 700, "ab" * 900, "​﻿", "line\r\nline\t end  "]
ALPHABET = "ab1 \n\t.,'é漢　\x1c"


@functools.cache
def loaded():
    return bpe.Vocabulary.from_file(FILE)


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(FILE):
        pytest.skip("no vocabulary file")
    return loaded()


def parted(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def naive(piece: bytes, vocabulary: bpe.Vocabulary) -> list[int]:
    """Merge the leftmost pair of the least rank until there is none."""
    ids = [vocabulary.ranks[bytes([b])] for b in piece]
    while True:
        ranked = [(vocabulary.pairs[a << 32 | b], i) for i, (a, b) in enumerate(itertools.pairwise(ids)) if a << 32 | b in vocabulary.pairs]
        if not ranked:
            return ids
        rank, i = min(ranked)
        ids[i : i + 2] = [rank]


@here
@given(st.binary(min_size=1, max_size=80))
@settings(max_examples=150, deadline=None)
def test_segment_tree_merges_like_the_naive_way(piece):
    vocabulary = loaded()
    want = naive(piece, vocabulary)
    assert bpe.encode_piece(piece, vocabulary) == want
    if 2 <= len(piece) <= 64:
        ids, counts = bpe.encode_block([piece, piece[:2]], 64, vocabulary)
        assert parted(ids, counts)[0] == want


@here
def test_ids_equal_those_of_the_public_library(vocabulary):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 120))) for _ in range(200)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert parted(*bpe.Encoder(vocabulary).encode(texts)) == want


@here
def test_round_trip(vocabulary):
    back = {v: k for k, v in vocabulary.ranks.items()}
    for text, ids in zip(ODD, parted(*bpe.Encoder(vocabulary).encode(ODD)), strict=True):
        assert b"".join(back[i] for i in ids) == (text or "").encode()


@here
def test_ascii_pattern_is_the_pattern():
    import regex

    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choices("aZ09 \n\t\x0b\x1c.'_s-tre", k=rng.randint(0, 30)))
        assert bpe.re.findall(bpe.ASCII_PATTERN, text) == regex.findall(bpe.PATTERN, text)


@here
def test_memory_of_pieces_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(vocabulary)
    first = parted(*encoder.encode(["one two three four five"]))
    assert parted(*encoder.encode(["one two three four five"])) == first
    assert len(encoder.code) == 5


@here
def test_encode_corpus(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ""), (50, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_corpus(df, FILE).collect()
    assert len(got) == len(rows) and got[0].ids == [] and got[1].ids == []
    assert next(len(r.ids) for r in got if r.doc_id == 50) > 1
    assert bpe.encode_corpus(df.limit(0), FILE).collect() == []


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def search_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, start=1):
            new.append(min(row[i - 1] + (p != w), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_distance(pattern, text):
    want = search_distance(pattern, text)
    assert leaks.distance_within(pattern, text) == want
    if text:
        assert leaks.distances_within(np.array([pattern, pattern]), np.array([text, text])).tolist() == [want, want]


@pytest.mark.parametrize(("window", "errors"), [(13, 0), (13, 1), (13, 2), (5, 1)])
def test_pieces_leave_one_whole_per_error(window, errors):
    length = leaks.piece_length(window, errors)
    for begin in range(40):
        whole = [o for o in range(0, 200, length) if o >= begin and o + length <= begin + window]
        assert len(whole) >= errors + 1
    with pytest.raises(ValueError):
        leaks.piece_length(3, 5)


def made_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps", "12", "Straße", "éa", "x"])
    items = [[word() for _ in range(rng.randint(3, 40))] for _ in range(12)]
    docs = []
    for _ in range(60):
        doc = [word() + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 20))]
        item = rng.choice(items)
        begin, size = rng.randint(0, len(item)), rng.choice([4, 12, 13, 14, 30])
        part = list(item[begin : begin + size])
        if part and rng.random() < 0.5:
            i = rng.randrange(len(part))
            part[i : i + 1] = rng.choice([[], ["new"], [part[i], "new"]])
        doc += part + [word() for _ in range(rng.randint(0, 5))]
        docs.append("".join(w.upper() + rng.choice([" ", ", ", "\n", " -- ", "_"]) if rng.random() < 0.3 else w + " " for w in doc))
    return [(i, " ".join(x)) for i, x in enumerate(items)], docs


@pytest.mark.parametrize(("seed", "errors"), [(1, 0), (2, 1), (3, 2)])
def test_leaks_against_brute_force(seed, errors):
    items, docs = made_texts(seed)
    got = {(d, i): dist for d, i, dist, _ in leaks.Matcher(items, 13, errors).find(docs)}
    want = {}
    for d, text in enumerate(docs):
        words = leaks.words_of(text)
        for i, passage in items:
            p = leaks.words_of(passage)
            least = min((search_distance(p[k : k + 13], words) for k in range(len(p) - 12)), default=99)
            if least <= errors:
                want[d, i] = least
    assert got == want and want


def test_find_leaks(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [
        (1, "so ONE, two; three four five\nsix seven eight nine ten eleven twelve thirteen ."), (1, "so ONE, two; three four five\nsix seven eight nine ten eleven twelve thirteen ."), (2, "one two three four five six seven eight nine ten eleven twelve"),
        (3, None), (4, ""), (5, "one two three four five six seven eight nine ten ELEVEN and twelve thirteen"), (6, "x " * 30_000 + passage), (7, "\n \t"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, passage), (11, passage + " fifteen"), (12, "too short"), (13, None), (14, "")], "item_id long, item_text string")
    for block in (20_000, 1):
        got = leaks.find_leaks(df, items, block_items=block).collect()
        exact = sorted((r.doc_id, r.item_id) for r in got if r.distance == 0)
        assert exact == [(1, 10), (1, 10), (1, 11), (1, 11), (6, 10), (6, 11)]
        assert {(r.doc_id, r.item_id) for r in got if r.distance == 1} == {(2, 10), (2, 11), (5, 10), (5, 11)}
        assert all(r.word_no >= 30_000 for r in got if r.doc_id == 6)
    assert leaks.find_leaks(df, items.limit(0)).count() == leaks.find_leaks(df.limit(0), items).count() == 0


COMMON = frozenset("the of a and to in is was it for we not that this with be are on at had have by or from an as so but they them were all there which one die der und la le de les et el que y en no".split())


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 5))
    y = (x[:, 0] > 0.3).astype(int) + 2 * (x[:, 1] * x[:, 2] > 0.2).astype(int)
    model = boosting.BoostedTrees(4).fit(x[:700], y[:700]).calibrate(x[700:], y[700:])
    p = model.probabilities(x[700:])
    assert (p.argmax(axis=1) == y[700:]).mean() > 0.85
    assert np.allclose(p.sum(axis=1), 1)
    again = boosting.BoostedTrees(4).fit(x[:700], y[:700])
    assert (again.scores(x) == model.scores(x)).all()


def test_one_class_is_learned():
    model = boosting.BoostedTrees(2, rounds=3).fit(np.zeros((5, 2)), np.zeros(5, dtype=int))
    assert model.probabilities(np.zeros((1, 2))).argmax() == 0


def corpus(seed, n=90):
    """Made-up texts of each kind with their kind."""
    rng = random.Random(seed)
    name = lambda: rng.choice("QXZK") + rng.choice("VWRT") + str(rng.randint(1, 99))
    sentence = lambda: f"The {rng.choice(['block', 'gap', 'record'])} at {rng.randint(1, 9999)} was {rng.choice(['lost', 'found', 'moved'])} in the {rng.choice(['first', 'last'])} run, and we do not know which of them is {name()}."
    out = []
    for _ in range(n):
        kind = rng.choice(quality.KINDS)
        k = rng.randint(5, 14)
        if kind == "prose":
            text = rng.choice([" ", "\n", "\n\n"]).join(sentence() for _ in range(k))
        elif kind == "list":
            mark = rng.choice(["- ", "* ", "{}. ", "", "[ ] "])
            text = "\n".join(mark.format(i + 1) + rng.choice([name(), f"all of {name()}"]) for i in range(k))
        elif kind == "table":
            sign = rng.choice([",", ";", "\t", " | "])
            text = "\n".join(sign.join([name(), str(rng.randint(1, 999)), name(), f"{rng.random():.2f}"]) for _ in range(k))
        else:
            text = "\n".join(rng.choice([lambda: "".join(rng.choices("ACGT", k=60)), lambda: "".join(rng.choices("abcXYZ019+/", k=64))])() for _ in range(k))
        out.append((text, kind))
    return out


def test_kinds_on_held_out_texts(spark):
    model = quality.train([t for t, _ in corpus(1, 300)], COMMON, HOLDOUT, mixed=150)
    for held in (corpus(2, 200), HOLDOUT):
        p = model.probabilities([t for t, _ in held])
        right = np.mean([quality.KINDS[k] == kind for k, (_, kind) in zip(p.argmax(axis=1), held, strict=True)])
        assert right > 0.95
    rows = [(i, t) for i, (t, _) in enumerate(corpus(3, 40))] + [(100, None), (101, ""), (102, " \n\t "), (103, "word"), (104, "x" * 50_000), (105, "a b " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_kind", F.lit("clash"))
    got = {r.doc_id: (r.text_kind, r.probability) for r in quality.classify(df, model).collect()}
    assert set(got) == {i for i, t in rows if t and t.strip()}
    assert all(0.25 <= p <= 1 for _, p in got.values())
    assert np.mean([got[i][0] == kind for i, (_, kind) in enumerate(corpus(3, 40))]) > 0.95
    assert quality.classify(df.limit(0), model).count() == 0
    small = quality.fit_model(df, COMMON, HOLDOUT, fit_rows=10)
    assert small.probabilities([HOLDOUT[0][0]]).shape == (1, 4)
    assert quality.fit_model(df.limit(0), COMMON, HOLDOUT).temperature > 0


def test_document_stats(spark):
    rows = [(1, "The cat, the dog.\n\nno end\nyes!  "), (2, None), (3, ""), (4, " \n "), (5, "!!!"), (1, "Été là-bas")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash"))
    words = spark.createDataFrame([("en", "the"), ("en", "The"), ("fr", "là"), (None, None)], "lang string, word string")
    got = sorted(quality.document_stats(df, words).collect(), key=lambda r: (r.doc_id, r.n_words))
    none = (0, None, None, None, None)
    assert [tuple(r)[1:] for r in got] == [
        (3, round(8 / 3, 6), round(1 / 9, 6), 0.0, round(1 / 3, 6)), (7, round(20 / 7, 6), round(3 / 23, 6), round(2 / 3, 6), round(2 / 7, 6)), none, none, none, (0, None, 1.0, 1.0, None),
    ]
    joined = quality.document_stats(df, words, listed_common=1)  # more common words than are listed in the plan
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_every_query_is_there():
    assert {"p6_ids", "p7_found", "p8_found"} <= set(queries.QUERIES)
    assert set(queries.SQL) <= set(queries.QUERIES)
