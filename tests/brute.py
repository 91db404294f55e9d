"""Plain one-row-after-the-other versions of the operators, for tests."""

from __future__ import annotations

import re


def runs(points: list[tuple], tolerance: float = 1e-10) -> list[tuple]:
    """points: (id, entity, start, end, value). (entity, start, end, n) of every run."""
    once = {}
    for p in points:
        if None not in (p[0], p[1], p[2], p[3]):
            once.setdefault((p[0], p[2]), p)
    out, run, last = [], None, None
    for _, entity, start, end, value in sorted(once.values(), key=lambda p: (p[1], p[2], p[0])):
        void = value is None or value != value
        if run and entity == last and not void and abs(value - run[4]) < tolerance and start <= run[2]:
            run = (run[0], run[1], max(run[2], end), run[3] + 1, run[4])
            continue
        if run:
            out.append(run[:4])
        run, last = (None if void else (entity, start, end, 1, value)), entity
    return sorted([*out, *([run[:4]] if run else [])])


def covered(intervals: list[tuple[int, int]]) -> int:
    return len({p for s, e in intervals for p in range(s, e)})


def cut(line: str) -> list[str]:
    out, inside = [""], False
    for c in line:
        inside ^= c == '"'
        if c == "\t" and not inside:
            out.append("")
        else:
            out[-1] += c
    return out[:-1] if not inside and len(out) > 1 and line.endswith("\t") else out


def bare(f: str) -> str:
    return f[1:-1] if len(f) > 1 and f[0] == f[-1] == '"' else f


def fault(line: str, kind: str, least: int, most: int, at: dict[str, int]) -> str | None:
    """The fault of a data line by the stated order of checks."""
    if not line.strip():
        return "empty_line"
    if line.count('"') % 2:
        return "broken_quoting"
    fields = cut(line)
    if not least <= len(fields) <= most:
        return "wrong_field_count"
    got = {k: bare(fields[i - 1]) for k, i in at.items() if i <= len(fields)}
    if "chrom" in got and not re.fullmatch(r"[A-Za-z0-9_.\-]+", got["chrom"]):
        return "invalid_chrom"
    numbers = [got[k] for k in ("start", "end") if k in got]
    if any(not re.fullmatch(r"\+?[0-9]+", v) or int(v) >= 2**63 for v in numbers):
        return "invalid_number"
    if kind != "vcf" and len(numbers) == 2 and int(numbers[0]) > int(numbers[1]):
        return "invalid_range"
    if "strand" in got and got["strand"] not in (["+", "-"] if kind == "maf" else ["+", "-", "."]):
        return "invalid_strand"
    if "allele" in got and not re.fullmatch("[ACGTRYSWKMBVDHNacgtryswkmbvdhn]+", got["allele"]) and not (kind == "maf" and got["allele"] == "-"):
        return "invalid_allele"
    return None


def unquote(span: str) -> str:
    return (span[1:-1] if len(span) > 1 and span.endswith('"') else span[1:]).replace('""', '"')


def unpacked(text: str | None, pairs: bool) -> list[tuple[str, str]]:
    if text is None:
        return []
    whole = text.strip()
    if re.fullmatch(r'"(?:[^"]|"")*"', whole):
        whole = unquote(whole)
    if whole.strip() == ".":
        return []
    tokens = re.findall(r'"(?:[^"]|"")*(?:"|\Z)|[^"]', whole, re.S)
    plain = "".join("\0" if t[0] == '"' else t for t in tokens)
    groups: list[list[str]] = [[]]
    for i, t in enumerate(tokens):
        c = plain[i]
        comma = pairs and c == "," and re.match(r"\s*\w+(=|\s+\0)", plain[i + 1 :])
        if comma or (pairs and c in ";|") or (not pairs and (c in ",;/|" or c.isspace())):
            groups.append([])
        else:
            groups[-1].append(t)
    out = []

    def trimmed(g: list[str]) -> list[str]:
        """Without outer blanks; those within quotes stay."""
        while g and g[0].isspace():
            g = g[1:]
        while g and g[-1].isspace():
            g = g[:-1]
        return g

    value = lambda g: "".join(unquote(t) if t[0] == '"' else t for t in trimmed(g))
    for g in map(trimmed, groups):
        if not g:
            continue
        if not pairs:
            out.append(("", value(g)))
        elif "=" in g:
            at = g.index("=")
            out.append(("".join(g[:at]).strip(), value(g[at + 1 :])))
        elif g[-1][0] == '"' and len(g) > 2 and g[-2].isspace() and not re.search(r"\s", "".join(g[:-1]).strip()):
            out.append(("".join(g[:-1]).strip(), unquote(g[-1])))
        else:
            out.append(("".join(g), ""))
    return out


def diff(left: dict, right: dict, tolerance: list[int]) -> set[tuple]:
    """left, right: key to field values; (key, kind) with the number of the field as kind."""
    out = {(k, "missing_right") for k in left if k not in right} | {(k, "missing_left") for k in right if k not in left}
    for k in left.keys() & right.keys():
        for i, (a, b, t) in enumerate(zip(left[k], right[k], tolerance, strict=True)):
            if (a is None) != (b is None) or (a is not None and (abs(a - b) > t if t else a != b)):
                out.add((k, str(i)))
    return out
