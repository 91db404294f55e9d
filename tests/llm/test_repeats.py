from anchorspan.llm import quality

COMMON = frozenset("the of and to a in is that it was for on are with as at be this have from".split())
SENTENCE = "The lift of the record was checked with a table that is kept for all of the runs."
LONG = "This is the part of the text that was put on every page as a note for readers, and it has more than twenty words in it to be read."
PROSE = """The block at the end of the chain was split in two, and one part of it is on the other strand.
It is not clear from the notes why the run of last week was so much slower than this one.
A reader that has to find the place of a gene should look at the table in the appendix first.
We have asked the authors for the files, but they are on holiday and the answer is to come in May."""


def shapes(text):
    return quality.Lines(text, COMMON).shape


def test_the_same_words_over_and_over_are_junk():
    for text in ("\n".join([SENTENCE] * 30), "\n".join([LONG] * 8), " ".join([LONG] * 40), "\n".join(["the lift of record nine was kept again"] * 6)):
        assert set(shapes(text)) == {quality.JUNK}
        assert quality.KINDS[quality.weak_label(text, COMMON)] == "junk"


def test_prose_and_a_sentence_that_comes_back_stay_prose():
    assert set(shapes(PROSE)) == {quality.PROSE}
    back = "\n".join(f"{line}\n{SENTENCE}" for line in PROSE.split("\n"))
    assert set(shapes(back)) == {quality.PROSE}
    assert shapes("\n".join([PROSE, *[SENTENCE] * 5])) == [quality.PROSE] * 4 + [quality.JUNK] * 5
