import random

import numpy as np
import pytest

from anchorspan.llm import generated, linestats, quality
from anchorspan.llm.holdout import HOLDOUT
from tests.llm.test_llm import COMMON, corpus


def test_statistics_do_not_depend_on_the_texts_around():
    texts = [t for t, _ in HOLDOUT] + ["x", "\n\n a \r\n\tb", "İstanbul ÉÀ 😀 ok", "a" * 3000]
    hashes = linestats.common_hashes(COMMON)
    x, doc, visible, names = linestats.line_statistics(texts, hashes)
    assert x.shape[1] == len(names) == len(set(names)) and np.isfinite(x).all()
    assert not {n for n in names if n.startswith(("share", "shape"))}
    for i, t in enumerate(texts):
        alone, _, size, _ = linestats.line_statistics([t], hashes)
        assert np.allclose(x[doc == i], alone, atol=1e-5) and size.sum() == len("".join(t.split())) == visible[doc == i].sum()


def test_common_words_are_found_without_case_and_in_any_place():
    x, _, _, names = linestats.line_statistics(["The cat and THE dog", "ab the\nthes the"], linestats.common_hashes(["the", "and", ""]))
    assert x[:, names.index("common_words")].tolist() == [3, 1, 1] and x[:, names.index("words")].tolist() == [5, 2, 2]
    none, _, _, _ = linestats.line_statistics(["The cat"], linestats.common_hashes([]))
    assert none[0, names.index("common")] == 0


def test_made_up_texts_are_of_their_kind_and_fixed():
    made = generated.texts([t for t, k in HOLDOUT if k == "prose"], 40, 3)
    assert made == generated.texts([t for t, k in HOLDOUT if k == "prose"], 40, 3) and generated.texts([], 5, 1) == []
    label = [(quality.weak_label(t, COMMON), k) for t, k in made]
    known = [(a, k) for a, k in label if a is not None]
    assert len(known) > 60 and np.mean([a == k for a, k in known]) > 0.85  # two labellers that know nothing of one another


@pytest.fixture(scope="module")
def model():
    return quality.train([t for t, _ in corpus(1, 300)], COMMON, HOLDOUT)


def test_calibration(model):
    """The temperature lies within its grid, and on texts that it was not fitted to, probabilities are near the share of right ones."""
    assert 0.1 < model.temperature < 10 and model.error < 0.06
    texts, kinds = quality.calibration_texts(HOLDOUT, seed=99)
    p = model.probabilities(texts)
    assert len(texts) > 300 and (p.argmax(axis=1) == kinds).mean() > 0.93
    assert quality.calibration_error(np.array([[0.9, 0.1]] * 10), np.zeros(10, dtype=int)) == pytest.approx(0.1)


def test_the_larger_part_decides(model):
    prose, dump = HOLDOUT[0][0], "\n".join("".join(random.Random(k).choices("ACGT", k=60)) for k in range(40))
    assert quality.KINDS[model.shares([f"{prose}\n{dump}"]).argmax()] == "junk"
    assert quality.KINDS[model.shares([f"{prose} {prose} {prose}\n{dump[:61]}"]).argmax()] == "prose"


def test_texts_of_any_length_are_scored_whole(model, monkeypatch):
    monkeypatch.setattr(linestats, "SLICE", 5_000)
    prose, dump = "\n".join(t for t, k in HOLDOUT if k == "prose"), "\n".join(["ACGTTGCATGCCGATAGCTAGGCTTACGATCGGATCCTAGG"] * 900)
    assert "".join(quality._stretches(prose + dump)) == prose + dump
    assert quality.KINDS[model.shares([prose + "\n" + dump]).argmax()] == "junk"
    assert quality.KINDS[model.shares([dump[:2000] + "\n" + prose * 3]).argmax()] == "prose"
    assert quality.KINDS[model.shares(["ACGT" * 9_000]).argmax()] == "junk"
