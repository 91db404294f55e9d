"""Made-up texts of each kind out of the words of prose: their kind is known, as they are built as such."""

from __future__ import annotations

import base64
import random
import re
import textwrap
from collections.abc import Callable

_MARKS = ["- ", "* ", "+ ", "• ", "– ", "-> ", "[ ] ", "[x] ", "{n}. ", "{n}) ", "({n}) ", "{a}) ", "({a}) ", "", "", "  - ", "◦ "]
_SIGNS = [",", ";", "\t", " | ", "|", ", ", "; ", "~", "^", " : ", "/", " / "]


def _value(rng: random.Random, words: list[str]) -> str:
    return rng.choice(
        [
            lambda: str(rng.randint(0, 10 ** rng.randint(1, 6))), lambda: f"{rng.random() * 10 ** rng.randint(0, 3):.{rng.randint(1, 3)}f}", lambda: rng.choice(words), lambda: rng.choice(["NA", "-", "+", ".", "ok", "yes", "no", ""]),
            lambda: "".join(rng.choices("ABCDKQRXZ", k=3)) + str(rng.randint(1, 99)), lambda: f"{rng.randint(1, 99)}%", lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}", lambda: f"chr{rng.randint(1, 22)}",
        ]
    )()


def _phrase(rng: random.Random, words: list[str], most: int = 7) -> str:
    at = rng.randrange(len(words))
    return re.sub(r"[.!?:;,]+(?=\s|$)", "", " ".join(words[at : at + rng.randint(1, most)]))


def listing(rng: random.Random, words: list[str]) -> str:
    """Entries line by line."""
    mark, tail, n = rng.choice(_MARKS), rng.choice(["", "", "", ";", ",", "."]), rng.randint(4, 25)
    entry = rng.choice([lambda: _phrase(rng, words), lambda: _phrase(rng, words, 3), lambda: f"{_phrase(rng, words, 3)}: {_value(rng, words)}", lambda: _value(rng, words), lambda: f"{_phrase(rng, words, 4)}, {_phrase(rng, words, 2)}"])
    return "\n".join(mark.format(n=i + 1, a="abcdefghijklmnopqrstuvwxyz"[i % 26]) + entry() + tail for i in range(n))


def table(rng: random.Random, words: list[str]) -> str:
    """Rows of cells, parted by a sign or lined up by blanks."""
    columns, n, sign = rng.randint(3, 9), rng.randint(4, 20), rng.choice([*_SIGNS, "", ""])
    makers = [rng.choice([lambda: _value(rng, words), lambda: str(rng.randint(1, 9999)), lambda: _phrase(rng, words, 2)]) for _ in range(columns)]
    rows = [[m() for m in makers] for _ in range(n)]
    if rng.random() < 0.5:
        rows.insert(0, [rng.choice(words).strip(".,;:") for _ in makers])
    if not sign:
        width = [max(len(r[k]) for r in rows) + rng.randint(2, 5) for k in range(columns)]
        return "\n".join("".join((c or "-").ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows)
    lines = [sign.join(r) for r in rows]
    if "|" in sign and rng.random() < 0.5:
        lines = [f"| {x.strip()} |" for x in lines]
        if rng.random() < 0.5:
            lines.insert(1, "|" + "---|" * columns)
    return "\n".join(lines)


def junk(rng: random.Random, words: list[str]) -> str:
    """Dumps, encoded or random characters, rows of signs, markup, broken encoding, the same words over and over."""
    n, width = rng.randint(3, 14), rng.randint(30, 90)
    some = lambda letters, k=width: "".join(rng.choices(letters, k=k))
    few = words[(at := rng.randrange(len(words))) : at + rng.randint(1, 14)]
    makers: list[Callable[[], str]] = [
        lambda: "\n".join(some("ACGT") for _ in range(n)), lambda: f">{rng.choice(words)} {rng.randint(1, 9)}\n" + "\n".join(some("ACGT", 60) for _ in range(n)), lambda: "\n".join(some("ACDEFGHIKLMNPQRSTVWY", 60) for _ in range(n)),
        lambda: textwrap.fill(base64.b64encode(rng.randbytes(width * n)).decode(), 76), lambda: "\n".join(f"{16 * i:08x}: " + " ".join(rng.randbytes(2).hex() for _ in range(8)) for i in range(n)), lambda: "\n".join(rng.randbytes(width // 2).hex() for _ in range(n)),
        lambda: "\n".join(some(rng.choice(["-", "=", "*", "~", "#", "_.", "/\\", "%", "-=", "+-"])) for _ in range(n)), lambda: "\n".join(f"<{(t := rng.choice(['div', 'td', 'li', 'span', 'p']))} class='{some('abc', 3)}'>&nbsp;</{t}><br/>" + rng.choice(["", "{{" + some("abcd_", 6) + "}}"]) for _ in range(n)),
        lambda: "\n".join(" ".join(some("xqzkwvbn!;|~#0", rng.randint(2, 8)) for _ in range(9)) for _ in range(n)), lambda: "\n".join(" ".join(some("bcdfghjklmnpqrstvwxz", rng.randint(2, 9)) for _ in range(9)) for _ in range(n)),
        lambda: "\n".join(" ".join(some("éüñäö’“Â", rng.randint(1, 5)).encode().decode("cp1252", "replace") for _ in range(9)) for _ in range(n)), lambda: " ".join(few * (200 // len(few) + 3)), lambda: "\n".join([" ".join(few)] * (n + 6)),
        lambda: "\n".join(" ".join([rng.choice(words)] * 12) for _ in range(n)),
    ]
    return rng.choice(makers)()


def prose(rng: random.Random, words: list[str]) -> str:
    """The running words in another layout."""
    at = rng.randrange(len(words))
    text = " ".join(words[at : at + rng.randint(25, 200)])
    text = rng.choice([str, str, str, str.upper, str.lower, lambda t: re.sub(r"[.,;:!?]", "", t.lower())])(text)
    sentences = re.split(r"(?<=[.!?])\s+", text)
    wrapped = lambda indent, width: textwrap.fill(text, width, initial_indent=indent, subsequent_indent=indent)
    return rng.choice(
        [
            lambda: text, lambda: wrapped("", rng.randint(35, 80)), lambda: wrapped(rng.choice(["> ", "  ", "    "]), rng.randint(40, 80)), lambda: "\n".join(f"- {s}" if len(s) > 50 else s for s in sentences), lambda: rng.choice(["\n", "\n\n"]).join(sentences),
            lambda: "\n".join(f"[{rng.randint(0, 23):02}:{rng.randint(0, 59):02}] {s}" if len(s) > 40 else s for s in sentences), lambda: text.replace(" ", "  "),
        ]
    )()


MAKERS = [prose, listing, table, junk]


def texts(prose_texts: list[str], count: int, seed: int) -> list[tuple[str, int]]:
    """(text, place of its maker) of ``count`` texts for each kind."""
    words = [w for t in prose_texts for w in t.split()]
    rng = random.Random(seed)
    return [(make(rng, words), k) for k, make in enumerate(MAKERS) for _ in range(count)] if words else []
