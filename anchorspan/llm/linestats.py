"""Statistics of the lines of many texts at once, by array operations over their characters.

A line is described by what its characters, words and gaps are, by the same of the lines around it, and by its document. No
line is looked at by itself: the characters of a slice of texts are one array, and everything is a sum over parts of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

# The signs told apart.
CLASSES = {
    "comma": ",", "semicolon": ";", "colon": ":", "pipe": "|", "slash": "/", "dash": "-–—", "underscore": "_", "equal": "=", "plus": "+", "star": "*", "hash": "#", "angle": "<>", "ampersand": "&",
    "round": "()", "square": "[]", "curly": "{}", "quote": "\"“”„«»", "apostrophe": "'’‘", "percent": "%", "dot": ".", "end": "!?…。！？", "rare": "@$^~`\\§¦·", "broken": "ÃÂâ€™œ¿½�¢Å", "bullet": "•‣▪◦○●■□✓✔→‹›",
}
_FIRST = ["lower", "upper", "digit", "letter", "blank", "tab", "line_end", "symbol"]
NAMES = [*_FIRST, *CLASSES]
SEPARATORS = ["comma", "semicolon", "colon", "pipe", "slash", "tab", "underscore", "equal", "hash", "ampersand", "rare", "end", "angle"]
VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüåæøœãõаеиоуыэюя"
#: Characters of text that are worked on at once: the arrays of so many fit a processor's cache.
SLICE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """By code point: class, lower case, whether a vowel, a letter of a sequence dump, a hexadecimal digit."""
    kind = np.full(1 << 16, NAMES.index("symbol"), dtype=np.uint8)
    lower = np.arange(1 << 16, dtype=np.uint64)
    for code in range(1 << 16):
        c = chr(code)
        if c.isspace():
            kind[code] = NAMES.index("line_end" if c in "\n\r" else "tab" if c == "\t" else "blank")
        elif c.isdigit():
            kind[code] = NAMES.index("digit")
        elif c.isalpha():
            kind[code] = NAMES.index("lower" if "a" <= c <= "z" else "upper" if c.isupper() else "letter")
            low = c.lower()
            lower[code] = ord(low) if len(low) == 1 else code
        elif unicodedata.category(c) == "Mn":
            kind[code] = NAMES.index("letter")
    for name, signs in CLASSES.items():
        for c in signs:
            kind[ord(c)] = NAMES.index(name)
    marks = []
    for chosen in (VOWELS + VOWELS.upper(), "ACGTUNacgtun", "0123456789abcdefABCDEF"):
        table = np.zeros(1 << 16, dtype=bool)
        table[[ord(c) for c in chosen]] = True
        marks.append(table)
    return kind, lower, *marks


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, dtype=np.uint64)
    return tuple(np.concatenate((one, np.multiply.accumulate(np.full(n, b, dtype=np.uint64)))) for b in (_BASE, inverse))


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of a mask."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lower-case text of each span; it doesn't depend on where the span lies."""
    power, inverse = _powers(2 * SLICE)
    if len(codes) >= len(power):
        power, inverse = _powers(1 << len(codes).bit_length())
    upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((_tables()[1][codes] + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))
    return (upto[ends] - upto[begins]) * inverse[begins]


def common_hashes(words: Iterable[str]) -> np.ndarray:
    """The sorted hashes of words, as they are looked for in lines."""
    out = [_hashes(np.minimum(np.array([ord(c) for c in w], dtype=np.uint32), 65535), np.array([0]), np.array([len(w)]))[0] for w in set(words) if w]
    return np.sort(np.array(out, dtype=np.uint64))


def _fresh(keys: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """For each line the mean of one by how often its keys come; 1 for a line without any."""
    if not len(keys):
        return np.ones(lines)
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    n = np.bincount(line, minlength=lines)
    return np.where(n > 0, np.bincount(line, weights=1 / count[back], minlength=lines) / np.maximum(n, 1), 1.0)


def _most(values: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """The largest value of each line; 0 for a line without any. Values come in order of their line."""
    out = np.zeros(lines)
    if len(values):
        firsts = np.flatnonzero(np.diff(line, prepend=-1))
        out[line[firsts]] = np.maximum.reduceat(values, firsts)
    return out


def _beside(x: np.ndarray, doc: np.ndarray, step: int) -> np.ndarray:
    """The rows of the lines ``step`` before, zero where these are of another document."""
    out = np.zeros_like(x)
    if step > 0:
        out[step:] = np.where((doc[step:] == doc[:-step])[:, None], x[:-step], 0)
    else:
        out[:step] = np.where((doc[:step] == doc[-step:])[:, None], x[-step:], 0)
    return out


def line_statistics(texts: list[str], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(statistics, text number, non-blank characters, names) of every line with a non-blank character."""
    kinds, _, vowel, dump, hexadecimal = _tables()
    codes = np.minimum(np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 65535)
    kind = kinds[codes]
    of = {n: i for i, n in enumerate(NAMES)}
    line_end = kind == of["line_end"]
    blank = line_end | (kind == of["blank"]) | (kind == of["tab"])
    breaks = np.flatnonzero(line_end)
    starts, stops = np.append(0, breaks + 1), np.append(breaks, len(codes))
    seen = np.concatenate(([0], np.cumsum(~blank)))
    visible = seen[stops] - seen[starts]
    kept = np.flatnonzero(visible)
    lines = len(kept)
    number = np.full(len(starts), -1)
    number[kept] = np.arange(lines)
    row = np.repeat(number, stops - starts + 1)[: len(codes)]  # the line of each character; a break belongs to the line it ends
    real = row >= 0
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.searchsorted(np.cumsum(sizes), starts[kept], side="right")
    visible = visible[kept].astype(np.float64)
    tally = np.bincount(row[real] * len(NAMES) + kind[real], minlength=lines * len(NAMES)).reshape(lines, len(NAMES)).astype(np.float64)
    begin, end = starts[kept], stops[kept]

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(mask, dtype=np.int32)))
        return (upto[end] - upto[begin]).astype(np.float64)

    lower, upper, digit = (kind == of[n] for n in ("lower", "upper", "digit"))
    latin = lower | upper
    word_sign = latin | digit | (kind == of["letter"])
    letters = tally[:, of["lower"]] + tally[:, of["upper"]] + tally[:, of["letter"]]

    token, token_end = _spans(~blank)
    token_line, token_size = row[token], token_end - token
    tokens = np.bincount(token_line, minlength=lines).astype(np.float64)
    word, word_end = _spans(word_sign)
    word_line, word_size, key = row[word], word_end - word, _hashes(codes, word, word_end)
    words = np.bincount(word_line, minlength=lines).astype(np.float64)
    is_common = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key if len(common) else np.zeros(len(key), dtype=bool)
    common_words = np.bincount(word_line[is_common], minlength=lines).astype(np.float64)
    in_doc = key * np.uint64(3) + doc[word_line].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    pair = np.flatnonzero((word_line[1:] == word_line[:-1])) if len(word) else np.zeros(0, dtype=np.int64)
    fresh_pairs = _fresh(in_doc[pair] * _BASE + key[pair + 1], word_line[pair], lines)
    fresh_words = _fresh(in_doc, word_line, lines)
    in_line = key + word_line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    fresh_here = _fresh(in_line, word_line, lines)

    # Gaps: tokens behind two or more blanks or a tab, and whether the lines around have a token behind a gap at the same column.
    back = lambda k: np.where(token >= k, blank[np.maximum(token - k, 0)] & ~line_end[np.maximum(token - k, 0)], False)
    inner = np.flatnonzero(np.diff(token_line, prepend=-1) == 0)
    wide = inner[(back(1) & back(2))[inner] | (kind[token[inner] - 1] == of["tab"])]
    wider = inner[(back(1) & back(2) & back(3))[inner]]
    column = (token_line[wide] + doc[token_line[wide]]) * 4096 + np.minimum(token[wide] - starts[kept][token_line[wide]], 4095)
    gap_count, wider_count = (np.bincount(token_line[x], minlength=lines).astype(np.float64) for x in (wide, wider))
    aligned = np.bincount(token_line[wide], weights=np.isin(column, column - 4096) | np.isin(column, column + 4096), minlength=lines)

    first = token[np.flatnonzero(np.diff(token_line, prepend=-1))]
    last_token = np.flatnonzero(np.diff(token_line, append=lines + 1))
    last = token_end[last_token] - 1
    first_size = token_end[np.flatnonzero(np.diff(token_line, prepend=-1))] - first
    first_end = kind[first + first_size - 1]
    opens, ends = kind[first], kind[last]
    is_in = lambda x, *names: np.isin(x, [of[n] for n in names]).astype(np.float64)
    mark = is_in(opens, "dash", "star", "bullet", "plus", "equal") * (first_size <= 2)
    numbered = is_in(opens, "digit", "round", "lower", "upper", "square") * is_in(first_end, "dot", "round", "square", "colon") * (first_size <= 5)
    finished = is_in(ends, "dot", "end", "colon", "quote", "semicolon", "comma")
    before, after = np.append(False, word_sign[:-1]), np.append(word_sign[1:], False)
    within = ~blank & ~word_sign & before & after
    same = np.append(False, codes[1:] == codes[:-1]) & ~blank
    up = np.append(False, upper[1:] & lower[:-1])
    mixed = np.append(False, (digit[1:] & latin[:-1]) | (digit[:-1] & latin[1:]))

    counts = tally[:, [of[s] for s in SEPARATORS]]
    equal = [np.where((counts == _beside(counts, doc, k)) & (counts > 0), counts, 0).max(axis=1) for k in (1, -1, 2, -2)]
    most = counts.max(axis=1)
    per = lambda x: x / visible
    own = {
        "visible": np.log1p(visible), "length": np.log1p(stops[kept] - starts[kept]), "indent": np.minimum(first - starts[kept], 40), "tokens": tokens, "token_mean": visible / tokens, "token_most": np.log1p(_most(token_size, token_line, lines)),
        "words": words, "word_most": np.log1p(_most(word_size, word_line, lines)), "word_mean": (letters + tally[:, of["digit"]]) / np.maximum(words, 1), "common": common_words / np.maximum(words, 1), "common_words": common_words,
        "letters": per(letters), "foreign": per(tally[:, of["letter"]]), "upper": per(tally[:, of["upper"]]), "digits": per(tally[:, of["digit"]]), "vowels": total(vowel[codes]) / np.maximum(letters, 1), "dump": per(total(dump[codes])), "hex": per(total(hexadecimal[codes])),
        "signs": per(visible - letters - tally[:, of["digit"]]), **{c: per(tally[:, of[c]]) for c in ("comma", "semicolon", "colon", "pipe", "slash", "dash", "underscore", "equal", "angle", "ampersand", "curly", "square", "percent", "dot", "broken", "rare", "symbol", "quote")},
        "tabs": tally[:, of["tab"]], "most_separators": most, "cell": visible / (most + 1), "cell_tokens": tokens / (most + 1), "same_before": equal[0], "same_after": equal[1], "same_near": np.maximum(equal[2], equal[3]),
        "gaps": gap_count, "wider_gaps": wider_count, "gap_share": gap_count / np.maximum(tokens - 1, 1), "aligned": aligned, "mark": mark, "numbered": numbered, "opens_upper": is_in(opens, "upper"), "opens_digit": is_in(opens, "digit"), "quoted": is_in(opens, "angle"),
        "finished": finished, "full_stop": is_in(ends, "dot", "end"), "within": per(total(within)), "repeated": per(total(same)), "case_turns": per(total(up)), "digit_turns": per(total(mixed)), "fresh_words": fresh_words, "fresh_pairs": fresh_pairs, "fresh_here": fresh_here,
    }
    names = list(own)
    base = np.stack([np.broadcast_to(v, lines).astype(np.float64) for v in own.values()], axis=1) if lines else np.zeros((0, len(names)))
    shown = [names.index(n) for n in ("visible", "words", "common", "finished", "mark", "numbered", "digits", "signs", "most_separators", "gaps", "letters", "opens_upper", "within", "word_most")]
    near = [_beside(base[:, shown], doc, k) for k in (1, -1)]
    ring = sum(_beside(np.column_stack((base[:, shown], np.ones(lines))), doc, k) for k in (-3, -2, -1, 1, 2, 3))
    around = ring[:, :-1] / np.maximum(ring[:, -1:], 1)
    # Of the document: means over its lines and over its characters.
    texts_n = len(texts)
    per_doc = lambda w: np.bincount(doc, weights=w, minlength=texts_n)
    n, size = np.maximum(per_doc(np.ones(lines)), 1), np.maximum(per_doc(visible), 1)
    whole = [np.log1p(n), np.log1p(size), per_doc(common_words) / np.maximum(per_doc(words), 1), per_doc(finished) / n, per_doc(mark + numbered) / n, per_doc(tally[:, of["digit"]]) / size, per_doc(visible - letters) / size, per_doc((gap_count > 0) * visible) / size]
    whole += [per_doc(np.maximum(equal[0], equal[1]) * visible) / size, per_doc(fresh_words * words) / np.maximum(per_doc(words), 1), per_doc(fresh_pairs * words) / np.maximum(per_doc(words), 1), per_doc(tally[:, of["upper"]]) / size]
    x = np.concatenate((base, *near, around, np.stack(whole, axis=1)[doc] if lines else np.zeros((0, len(whole)))), axis=1)
    all_names = [*names, *[f"{w}_{names[k]}" for w in ("before", "after", "around") for k in shown], *[f"document_{k}" for k in ("lines", "visible", "common", "finished", "marks", "digits", "signs", "gaps", "same", "fresh_words", "fresh_pairs", "upper")]]
    return x.astype(np.float32), doc, visible, all_names


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
