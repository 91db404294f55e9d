from collections import defaultdict

import numpy as np

from anchorspan.llm import bpe
from tests.llm.test_llm import here, loaded


@here
def test_every_entry_is_what_the_merges_give():
    """Pieces that are entries are looked up whole; the tree gives the same single id for each of them."""
    vocabulary = loaded()
    by_width = defaultdict(list)
    for token in vocabulary.ranks:
        if len(token) > 1:
            by_width[max(4, 1 << (len(token) - 1).bit_length())].append(token)
    unlike = []
    for width, tokens in by_width.items():
        flat, counts = bpe.encode_block(tokens, width, vocabulary)
        begins = np.cumsum(counts) - counts
        unlike += [t for t, b, n in zip(tokens, begins.tolist(), counts.tolist(), strict=True) if n != 1 or flat[b] != vocabulary.ranks[t]]
    assert sum(map(len, by_width.values())) > 49_000 and unlike == []
