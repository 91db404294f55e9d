"""Per-document text statistics, and the kind of a text: prose, list, table or junk.

Gradient-boosted trees see statistics of the lines of a text, of the lines around them and of the document (linestats): what
characters, words, separators and gaps they are made of. A text is of the kind that the larger part of its non-blank characters
is, by the trees' probabilities of its lines.

The trees learn from weakly labelled texts. Labels come from elsewhere than from these statistics: one labeller reads the
shapes of lines by rules (Lines) and labels a text that is of one kind nearly throughout, another one asks prose for ends of
sentences, and a text on which they disagree is left out. Texts made up as lists, tables, junk or prose out of the words of
the sample join them, their kind being known, and texts put together from two of all these keep the label of each line's source. The probabilities are calibrated on hand-checked texts and mixtures of them; of these only every second is
used to fit, and the calibration error is that of the others.

The sample for training is bounded by ``fit_rows`` and chosen by a hash of the id; every document is scored whole.

Defined results: a null, empty or blank text has zero words and lines, null means and shares, and is no case of any
kind; common words are compared without case over all languages given; repeated rows give repeated rows. The context of a
line is its document, or of a text of more than linestats.SLICE characters the stretch of so many that it lies in.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.llm import generated, linestats
from anchorspan.llm.boosting import BoostedTrees, softmax
from anchorspan.session import ship

KINDS = ["prose", "list", "table", "junk"]
#: Rows of the training sample, the longest text in it (in characters), and texts put together from two of its rows.
FIT_ROWS, FIT_CHARS, MIXED = 2000, 20_000, 600
#: Texts made up of each kind out of the words of the sample.
GENERATED = 120
#: Lines that the trees learn from of one text of prose, and of one of another kind, which are fewer.
FIT_LINES = (2, 7)
#: Common words that are taken as one array in the plan; more are joined.
LISTED_COMMON = 5_000

# Marks of list entries, and parts of junk.
BULLET = re.compile(r"\s*(?:[-*•–—+·‣▪◦○●■□✓✔]|->|=>|→|\[[ xX✓]?\]|\(?[0-9]{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])\s{1,4}(?=\S)")
QUOTE = re.compile(r"\s*(?:>\s?)+")
TALK = re.compile(r"\s*(?:\[?[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\]?|[QA]:|[A-Za-z]+_?[0-9]*:)\s+")
HEXDUMP = re.compile(r"\s*(?:0x)?[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,8}\s+){3,}")
HEXROW = re.compile(r"\s*(?:[0-9a-fA-F]{2,8}[\s:]+){6,}[0-9a-fA-F]{0,8}\s*$")
SEQUENCE = re.compile(r"\s*(?:[ACGTUNacgtun]{16,}|[ACDEFGHIKLMNPQRSTVWYX*]{30,})\s*$")
FASTA_NAME = re.compile(r">\S+(?:\s\S+){0,4}\s*$")
BLOB = re.compile(r"[A-Za-z0-9+/=_\-%]{24,}")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>|&#?[A-Za-z0-9]+;|\{\{[^{}]*\}\}|\{%[^{}]*%\}|\[/?[a-z]{2,}(?:=[^\]]*)?\]")
MOJIBAKE = re.compile(r"[ÃÂâï][\u0080-ÿ‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ€Ÿžž]+|�+|ï¿½")
SENTENCE_END = tuple(".!?…:\"”»。！？")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
GAPS = re.compile(r"(?<=\S)[  ]{2,}(?=\S)|\t+")
CELL_SIGN = re.compile(r"[|\t;,^~/:#=!@&§¦·_]")
THOUSANDS = re.compile(r"(?<![\w,.])\d{1,3}(?:,\d{3})+(?!\d|,\d)")
OTHER_SIGN = re.compile(r"[|<{~^\ufffdÃâ]")
WORD_ASCII = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*")
ODD_INSIDE = re.compile(r"[^\W\d_][!;|:#~^$%&*=<>?@{}\[\]\\]+[^\W_]|^[!;|:#~^$%&*=?@{}\\]+[^\W_]|[^\W_][!|#~^$%&*=@{}\\]+$")
VOWEL = re.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüåæøœãõаеёиоуыэюя]", re.I)
PROSE, ITEM, BARE, ROW, JUNK, SHORT = range(6)
SHAPES = ["prose", "item", "bare", "row", "junk", "short"]
def common_set(common_words: DataFrame) -> list[str]:
    """The common words in lower case, sorted: a list of function words, which every worker has as a whole."""
    return sorted(r[0] for r in common_words.select(F.lower("word").alias("w")).where(F.col("w").isNotNull()).distinct().collect())


def document_stats(docs: DataFrame, common_words: DataFrame, id_column: str = "doc_id", text_column: str = "text", listed_common: int = LISTED_COMMON) -> DataFrame:
    """(id, n_words, mean_word_length, symbol_ratio, end_punct_share, common_share) by JVM-side expressions alone.

    Words are maximal runs of letters and digits; symbols are non-blank characters that are neither; a line counts if it
    has a non-blank character. Up to listed_common common words are one array in the plan; more are joined to the distinct words of
    each text, which gives the same.
    """
    known = common_words.select(F.lower("word").alias("common_word")).where(F.col("common_word").isNotNull()).distinct()
    listed = sorted(r[0] for r in known.limit(listed_common + 1).collect())
    text = F.col(text_column)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select(id_column, text_column, F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    n = F.size("w")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part / whole, 6))

    letters = F.length(F.array_join(F.col("w"), ""))
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    bare_text = F.length(F.regexp_replace(F.regexp_replace(text, r"(?U)\s", ""), r"[\p{L}\p{N}]", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)\S"))
    ended = F.filter(lines, lambda x: x.rlike(r"(?U)[.!?…:;,\"”»]\s*\z"))
    columns = [id_column, n.cast("bigint").alias("n_words"), share(letters, n).alias("mean_word_length"), share(bare_text, visible).alias("symbol_ratio"), share(F.size(ended), F.size(lines)).alias("end_punct_share")]
    if len(listed) <= listed_common:
        return rows.select(*columns, share(F.size(F.filter("w", lambda x: x.isin(listed) if listed else F.lit(False))), n).alias("common_share"))
    # Rows are told apart by a digest of their words, for ids may repeat: rows of equal words have equal counts.
    marked = rows.withColumn("_key", F.sha2(F.array_join("w", " "), 256))
    one = marked.groupBy("_key").agg(F.first("w").alias("w")).select("_key", F.explode("w").alias("common_word")).groupBy("_key", "common_word").agg(F.count(F.lit(1)).alias("n"))
    found = one.join(known, "common_word").groupBy("_key").agg(F.sum("n").alias("_found"))
    return marked.join(found, "_key", "left").select(*columns, share(F.coalesce("_found", F.lit(0)), n).alias("common_share"))


def _cells(line: str) -> tuple[str, int] | None:
    """(separator, count of cells) if the line looks like a row of short cells."""
    best = None
    line = THOUSANDS.sub("0", line)
    for sign in sorted(set(CELL_SIGN.findall(line))):
        count = line.count(sign)
        if count < 2 or (best and count <= best[1]):
            continue
        cells = line.strip().strip("|").split(sign)
        sizes = [len(c.strip()) for c in cells]
        spaces = sum(len(c.split()) for c in cells)
        if max(sizes) <= 40 and sum(sizes) <= 22 * len(cells) and spaces <= 2.6 * len(cells):
            best = (sign, count)
    return best


class Lines:
    """The shapes of the lines of one text, each with its count of non-blank characters."""

    def __init__(self, text: str, common: frozenset[str]):
        self.common = common
        self.lines = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
        self.visible = [len("".join(x.split())) for x in self.lines]
        find = (WORD_ASCII if text.isascii() else WORD).findall
        self.words = [find(x.lower()) for x in self.lines]
        self.bullets = [BULLET.match(x) for x in self.lines]
        self.blobs = self.odd = 0
        self.over = self._over()
        first = [self._alone(i) for i in range(len(self.lines))]
        self.shape = self._among(first)

    @staticmethod
    def _plain(line: str, words: list[str], letters: int, visible: int, common: int) -> bool:
        """A sentence beyond doubt: many words, enough of them common and unlike, and nothing in it that other shapes have."""
        count = len(words)
        return (
            count >= 9 and len(line) > 50 and common >= 0.15 * count and letters > 0.75 * visible and 3 * (line.count(",") + line.count(";") + line.count("/")) < count and len(set(words)) > 0.35 * min(count, 60)
            and "\t" not in line and "   " not in line.strip() and not OTHER_SIGN.search(line)
        )

    def _over(self) -> set[int]:
        """The lines of 8 or more words whose pairs of words come four times each, or more: over the whole text, and if it is not made of such lines alone, in a run of them.

        Each pair of a line counts as one by how often the text has it; the sum over a text is its count of distinct pairs.
        """
        pairs = [list(zip(ws, ws[1:], strict=False)) for ws in self.words]
        found = Counter(chain.from_iterable(pairs))
        total = found.total()
        if total - len(found) < 3 * 7:  # fewer repeats than the shortest such line has
            return set()
        lines = [i for i, ps in enumerate(pairs) if len(ps) >= 7 and sum([1 / found[p] for p in ps]) <= 0.25 * len(ps)]
        if len(found) <= 0.25 * total:
            return set(lines)
        runs = [[i for _, i in run] for _, run in groupby(enumerate(lines), lambda x: x[1] - x[0])]
        return {i for run in runs if len(set().union(*(pairs[i] for i in run))) <= 0.25 * sum(len(pairs[i]) for i in run) for i in run}

    def _repeats(self, i: int) -> bool:
        """The words of the line, with those of its neighbours if it is short, are the same few over and over, or the line is one of _over()."""
        if i in self.over:
            return True
        words = list(self.words[i])
        for near in (i - 1, i + 1, i + 2):
            if len(words) < 24 and 0 <= near < len(self.words):
                words += self.words[near]
        return len(self.words[i]) >= 3 and len(words) >= 10 and len(set(words)) <= 0.25 * len(words)

    def _alone(self, i: int) -> int:
        line, visible, words = self.lines[i], self.visible[i], self.words[i]
        letters = sum(map(len, words))
        common = sum(map(self.common.__contains__, words))
        if i not in self.over and self._plain(line, words, letters, visible, common):
            return PROSE
        compact = "".join(line.split())
        if HEXDUMP.match(line) or HEXROW.match(line) and re.search(r"[a-fA-F]", line) or SEQUENCE.match(line):
            self.blobs += visible
            return JUNK
        if letters < 0.12 * visible and "|" not in line and "\t" not in line and visible >= 4:
            return JUNK
        if letters < 0.12 * visible and re.fullmatch(r"[\s|:+\-=]+", line):
            return ROW if "|" in line and ("-" in line) else JUNK
        blob = sum(len(b) for b in BLOB.findall(compact) if b in line and not b.isdigit() and not b.isalpha() or (b in line and len(b) > 40))
        if blob > 0.6 * visible and len(words) <= 6 + visible // 16 and len(line.split()) <= 2 + visible // 40:
            self.blobs += visible
            return JUNK
        if sum(len("".join(t.split())) for t in TAG.findall(line)) > 0.4 * visible:
            return JUNK
        if sum(map(len, MOJIBAKE.findall(line))) > 0.2 * visible:
            return JUNK
        if self._aligned(i):
            return ROW
        tokens = line.split()
        odd = sum(1 for t in tokens if ODD_INSIDE.search(t))
        if len(tokens) >= 4 and odd >= 0.25 * len(tokens) and common <= 0.1 * len(words) and not _cells(line):
            self.odd += visible
            return JUNK
        if len(tokens) >= 6 and common <= 0.08 * len(words):
            alpha = "".join(w for w in WORD.findall(line) if w.isalpha() and w.islower() and w.isascii())
            if len(alpha) > 0.5 * visible and len(VOWEL.findall(alpha)) < 0.2 * len(alpha):
                self.odd += visible
                return JUNK
        if self._repeats(i) and not self.bullets[i] and not GAPS.search(line.strip()):
            return JUNK
        if self._row(i):
            return ROW
        body = line[self.bullets[i].end() :] if self.bullets[i] else line
        body = QUOTE.sub("", body, count=1)
        talk = TALK.match(body)
        if talk and len(body) - talk.end() > 40:
            body = body[talk.end() :]
        count = len(WORD.findall(body))
        sentence = count >= 9 and common >= 0.15 * count or count >= 7 and body.rstrip().endswith(SENTENCE_END) and common >= 0.2 * count or len(body) > 55 and common >= 0.12 * count
        if self.bullets[i]:
            return PROSE if sentence and len(body) > 45 else ITEM
        if sentence and len(body) > 40:
            return PROSE
        return SHORT

    def _row(self, i: int) -> bool:
        line = self.lines[i]
        near = [self.lines[k] for k in (i - 1, i + 1, i - 2, i + 2) if 0 <= k < len(self.lines)]
        cells = _cells(line)
        if cells and not (self.bullets[i] and cells[0] not in "|\t;"):
            sign, count = cells
            if sign in "|\t" and (count >= 2 or line.strip().startswith("|")):
                return True
            if any(x.count(sign) == count for x in near[:4]) and (sign not in ":/_=!&·" or count >= 2):
                return True
        return False

    def _aligned(self, i: int) -> bool:
        """Whether the line is parted by tabs or wide gaps into short cells, like the lines around it or widely by itself."""
        line = self.lines[i]
        bare = line.strip()
        if "\t" not in bare and "  " not in bare:
            return False
        near = [self.lines[k] for k in (i - 1, i + 1, i - 2, i + 2) if 0 <= k < len(self.lines)]
        if "\t" in bare:
            return any("\t" in x for x in near)
        gaps = list(GAPS.finditer(bare))
        if not gaps or self.bullets[i]:
            return False
        starts = {m.end() + len(line) - len(line.lstrip()) for m in gaps}
        wide = sum(m.end() - m.start() >= 3 for m in gaps)
        parts = [p for p in GAPS.split(bare) if p]
        if sum(map(len, parts)) > 26 * len(parts):
            return False
        shared = any(len(starts & {m.end() for m in GAPS.finditer(x.rstrip())}) >= max(1, len(starts) // 2) for x in near)
        uneven = shared and all(len(p.split()) == 1 for p in parts) and len({len(m.group()) for m in gaps}) > 1
        return bool(wide and (wide >= len(gaps) / 3 or shared) or uneven)

    def _among(self, first: list[int]) -> list[int]:
        """Shapes again, now by the lines around: short lines in a row are entries, or the ends of prose, or parts of what is beside them."""
        shape, n, i = list(first), len(first), 0
        while i < n:
            if shape[i] != SHORT:
                i += 1
                continue
            j = i
            while j < n and shape[j] == SHORT:
                j += 1
            sizes = [len(self.lines[k].strip()) for k in range(i, j)]
            before, after = (shape[i - 1] if i else None), (shape[j] if j < n else None)
            if all(FASTA_NAME.match(self.lines[k]) for k in range(i, j)) and JUNK in (before, after):
                to = JUNK
            elif before == JUNK and j - i == 1 and len(self.lines[i].split()) <= 2 and after in (JUNK, None):
                to = JUNK
            elif j - i >= 3 and sum(sizes) <= 44 * (j - i):
                words = [w for k in range(i, j) for w in self.words[k]]
                mixed = len(words) >= 12 and sum(w in self.common for w in words) >= 0.3 * len(words) and sum(sizes) > 30 * (j - i)
                to = PROSE if mixed else BARE
            elif ITEM in (before, after) and j - i <= 2:
                to = ITEM if before == ITEM and (after == ITEM or after is None) else SHORT
            elif ROW in (before, after) and j - i == 1 and (len(self.words[i]) <= 6 and GAPS.search(self.lines[i].strip()) or any(s in self.lines[i] for s in "|\t;,")):
                to = ROW
            elif before == PROSE:
                to = PROSE
            else:
                to = SHORT
            shape[i:j] = [to] * (j - i)
            i = j
        return shape


def shape_shares(text: str, common: frozenset[str]) -> list[float]:
    """The shares of SHAPES in a text by non-blank characters."""
    got = Lines(text, common)
    total, parts = sum(got.visible), [0.0] * len(SHAPES)
    for s, v in zip(got.shape, got.visible, strict=True):
        parts[s] += v / total
    return parts


def weak_label(text: str | None, common: frozenset[str]) -> int | None:
    """The kind of a text that is of one kind nearly throughout by the shapes of its lines, unless it is prose without ends of sentences; else None."""
    if not text or not text.strip():
        return None
    prose, item, bare, row, junk, _ = shape_shares(text, common)
    kind = next((k for k, share in enumerate((prose, item + bare, row, junk)) if share >= 0.95), None)
    if kind == 0 and 60 * len(SENTENCE.findall(text)) < len(text.split()):
        return None
    return kind


SENTENCE = re.compile(r"[.!?…](?=[\s\"”»)\]]|$)|[。！？]")


def _lines(text: str) -> list[str]:
    return [x for x in re.split(r"[\n\r]", text) if x.strip()]


def _stretches(text: str) -> list[str]:
    """The text, cut at line ends into stretches of linestats.SLICE characters at most; a longer line is cut, too."""
    out, begin = [], 0
    while len(text) - begin > linestats.SLICE:
        cut = text.rfind("\n", begin, begin + linestats.SLICE) + 1
        out.append(text[begin : cut if cut > begin else begin + linestats.SLICE])
        begin += len(out[-1])
    return [*out, text[begin:]]


class TextKinds:
    """Trees on line statistics, the common words as hashes, and the temperature of the probabilities."""

    def __init__(self, trees: BoostedTrees, common: Iterable[str]):
        self.trees, self.common, self.temperature, self.error = trees, linestats.common_hashes(common), 1.0, None

    def shares(self, texts: list[str]) -> np.ndarray:
        """The shares of KINDS in each non-blank text, by non-blank characters and the trees' probabilities of its lines."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = _stretches(t)
            parts += cut
            owner += [i] * len(cut)
        out = np.zeros((len(texts), len(KINDS)))
        for lo, hi in linestats.slices(parts):
            x, part, visible, _ = linestats.line_statistics(parts[lo:hi], self.common)
            p = softmax(self.trees.scores(x)) * visible[:, None]
            of = np.array(owner[lo:hi], dtype=np.int64)[part]
            for k in range(len(KINDS)):
                out[:, k] += np.bincount(of, weights=p[:, k], minlength=len(texts))
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(np.log(self.shares(texts) + 1e-3) / self.temperature)

    def calibrate(self, texts: list[str], kinds: np.ndarray) -> TextKinds:
        """Sets the temperature of least log loss on every second text, and ``error``, the calibration error on the others."""
        scores = np.log(self.shares(texts) + 1e-3)
        fit, rest = np.arange(len(texts)) % 2 == 0, np.arange(len(texts)) % 2 == 1
        grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
        loss = [-np.log(np.maximum(softmax(scores[fit] / t)[np.arange(fit.sum()), kinds[fit]], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.error = calibration_error(softmax(scores[rest] / self.temperature), kinds[rest])
        return self


def calibration_error(p: np.ndarray, kinds: np.ndarray, bins: int = 5) -> float:
    """How far the probability of the kind chosen lies from how often it is right, as a mean over bins by their texts."""
    top, right = p.max(axis=1), p.argmax(axis=1) == kinds
    place = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[place == b].mean() - right[place == b].mean()) * (place == b).mean() for b in range(bins) if (place == b).any()))


def mixtures(texts: list[tuple[str, int]], count: int, seed: int) -> list[list[tuple[str, int]]]:
    """Texts put together from two: (lines, kind) of a part of prose and of a part of another kind, either one first."""
    rng = np.random.default_rng(seed)
    by = {k: [t for t, kind in texts if kind == k] for k in range(len(KINDS))}
    others = [k for k in range(1, len(KINDS)) if by[k]]
    out = []
    for _ in range(count if by[0] and others else 0):
        k = int(rng.choice(others))
        a, b = (_lines(by[j][int(rng.integers(len(by[j])))]) for j in (0, k))
        a, b = a[: int(rng.integers(1, len(a) + 1)) if rng.random() < 0.5 else 1], b[: int(rng.integers(1, len(b) + 1))]
        parts = [("\n".join(a), 0), ("\n".join(b), k)]
        out.append(parts if rng.random() < 0.75 else parts[::-1])
    return out


def _size(text: str) -> int:
    return len("".join(text.split()))


def calibration_texts(holdout: Iterable[tuple[str, str]], mixed: int = 300, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """The hand-checked texts and mixtures of them, with the kind of the larger part; where no part is clearly larger, the mixture is left out."""
    held = [(t, KINDS.index(k)) for t, k in holdout]
    made = [(p, [_size(t) for t, _ in p]) for p in mixtures(held, mixed, seed)]
    clear = [("\n".join(t for t, _ in p), p[int(np.argmax(n))][1]) for p, n in made if max(n) >= 0.53 * sum(n)]
    texts = held + clear
    return [t for t, _ in texts], np.array([k for _, k in texts])


def train(texts: Iterable[str], common: frozenset[str], holdout: Iterable[tuple[str, str]], mixed: int = MIXED, seed: int = 7) -> TextKinds:
    """Trees on the lines of weakly labelled texts and of mixtures of them, calibrated on the (text, kind) pairs of holdout."""
    holdout = list(holdout)
    pure = [(t, k) for t in texts if (k := weak_label(t, common)) is not None]
    if len({k for _, k in pure}) < 2:  # nothing to learn from: the holdout alone
        pure = [(t, KINDS.index(k)) for t, k in holdout]
    pure += [(t, k) for t, k in generated.texts([t for t, k in pure if k == 0], GENERATED, seed) if t.strip()]
    made = [[x] for x in pure] + mixtures(pure, mixed, seed)
    lines = [[(line, k) for t, k in parts for line in _lines(t)] for parts in made]
    hashes, rng = linestats.common_hashes(common), np.random.default_rng(seed)
    joined, rows, labels = ["\n".join(x for x, _ in doc) for doc in lines], [], []
    for lo, hi in linestats.slices(joined):
        x, _, _, _ = linestats.line_statistics(joined[lo:hi], hashes)
        kinds = np.array([k for doc in lines[lo:hi] for _, k in doc])
        owner = np.repeat(np.arange(hi - lo), [len(doc) for doc in lines[lo:hi]])
        order = np.lexsort((rng.random(len(x)), kinds > 0, owner))
        group = owner[order] * 2 + (kinds[order] > 0)
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
        chosen = order[place < np.where(kinds[order] > 0, FIT_LINES[1], FIT_LINES[0])]
        rows.append(x[chosen])
        labels.append(kinds[chosen])
    trees = BoostedTrees(len(KINDS), rounds=30, depth=4, step=2).fit(np.concatenate(rows), np.concatenate(labels))
    return TextKinds(trees, common).calibrate(*calibration_texts(holdout))


def fit_model(docs: DataFrame, common: frozenset[str], holdout: Iterable[tuple[str, str]], fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> TextKinds:
    """Trains on about ``fit_rows`` texts of at most FIT_CHARS characters, twice as many at most, chosen by a hash of the id.

    The share of hashes taken follows from the count of rows, so what the tasks send to the driver has a fixed size.
    """
    share = min(1.0, fit_rows / max(1, docs.count()))
    chosen = F.xxhash64(id_column) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
    usable = docs.where(F.col(text_column).isNotNull() & (F.length(text_column) <= FIT_CHARS) & chosen)
    sample = sorted(r[0] for r in usable.select(text_column).limit(2 * fit_rows).collect())
    return train(sample, common, holdout)


def classify(docs: DataFrame, model: TextKinds, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_kind, probability) of every document with a non-blank text. Row by row, without a shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = [i for i, t in enumerate(texts) if t and t.strip()]
            p = model.probabilities([texts[i] for i in kept]) if kept else np.zeros((0, len(KINDS)))
            kinds = [KINDS[k] for k in p.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, type=pa.int64())), pa.array(kinds, type=pa.string()), pa.array(p.max(axis=1))], names=[id_column, "text_kind", "probability"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, text_kind string, probability double")
