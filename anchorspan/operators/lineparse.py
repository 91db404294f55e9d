"""Rows that fail to parse, parted from those that load, with the reason and the edits that would mend them.

Delimited lines are cut at tabs outside double quotes by JVM-side expressions, and a line whose field count, quoting
and field types are all right has cost zero and loads. Only lines with a cost go to the minimum-cost parse: a dynamic
programme that inserts or deletes quotes and delimiters until the line has an even number of quotes and a legal field
count, at the least number of edits, and among those so that as few fields as can be are of a wrong type. Its edits state
the reason. It keeps, over the places of the line, the least count of wrong fields up to the end of each field that has a
type; fields without a type cost nothing wherever they end, so its work grows with the line and not with its square.

Defined results: a null line or an unknown file kind is no data line; a file without the header that gives its field
count is checked against the least count of its kind; a column that a header lacks is not checked; copies of a line
give equal rows. Lines of any length are parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.session import bounded, ship

#: Faults in the order in which they apply.
FAULTS = ["empty_line", "broken_quoting", "wrong_field_count", "invalid_chrom", "invalid_number", "invalid_range", "invalid_strand", "invalid_allele"]
CHROM = r"[A-Za-z0-9_.\-]+"
NUMBER = r"\+?[0-9]+"
ALLELE = r"[ACGTRYSWKMBVDHNacgtryswkmbvdhn]+"
INT64_MAX = "9223372036854775807"
MAF_COLUMNS = {"chrom": "Chromosome", "start": "Start_Position", "end": "End_Position", "strand": "Strand", "allele": "Reference_Allele"}
LEAST_FIELDS = {"bed": 3, "vcf": 8, "maf": 1}
BED_MOST = 12

_TAB = "\x01"


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def clean(raw: Column) -> Column:
    """The line without one carriage return at its very end."""
    return F.when(raw.endswith("\r"), raw.substr(F.lit(1), F.length(raw) - 1)).otherwise(raw)


def fields_of(line: Column) -> Column:
    """The fields of a line, parted by tabs outside pairs of double quotes; a final tab opens no field. Quotes stay."""
    marked = F.replace(F.replace(line, F.lit("\x02"), F.lit("\x02b")), F.lit(_TAB), F.lit("\x02a"))
    parts = F.split(marked, '"', -1)
    shielded = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\t"), F.lit(_TAB))).otherwise(p)), '"')
    cut = F.split(F.regexp_replace(shielded, "\t\\z", ""), "\t", -1)
    back = F.transform(cut, lambda f: F.replace(F.replace(F.replace(f, F.lit(_TAB), F.lit("\t")), F.lit("\x02a"), F.lit(_TAB)), F.lit("\x02b"), F.lit("\x02")))
    return F.when(F.instr(line, '"') > 0, back).otherwise(F.split(F.regexp_replace(line, "\t\\z", ""), "\t", -1))


def bare(field: Column) -> Column:
    """A field's value: without one pair of quotes around all of it."""
    return F.when((F.length(field) >= 2) & field.startswith('"') & field.endswith('"'), field.substr(F.lit(2), F.length(field) - 2)).otherwise(field)


def is_number(value: Column) -> Column:
    digits = F.regexp_replace(value, r"^\+?0*", "")
    return _full(value, NUMBER) & ((F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= INT64_MAX)))


def layout(lines: DataFrame) -> DataFrame:
    """(file_kind, file_name, head_no, n_fields, chrom_at, ...): what the header line of each file fixes. One row per file with a header.

    The first header line's number is a hash aggregate; the few lines with these numbers are then looked up.
    """
    raw, kind = F.col("raw_line"), F.col("file_kind")
    heads = lines.where(((kind == "vcf") & raw.startswith("#CHROM")) | ((kind == "maf") & ~raw.startswith("#"))).select("file_kind", "file_name", "line_no", "raw_line")
    first = heads.groupBy("file_kind", "file_name").agg(F.min("line_no").alias("line_no"))
    found = heads.join(first, ["file_kind", "file_name", "line_no"]).groupBy("file_kind", "file_name", "line_no").agg(F.min("raw_line").alias("raw_line"))
    named = found.select("file_kind", "file_name", F.col("line_no").alias("head_no"), fields_of(clean(raw)).alias("head"))
    at = {k: F.when(kind == "maf", F.array_position(F.transform("head", bare), name)) for k, name in MAF_COLUMNS.items()}
    return named.select("file_kind", "file_name", "head_no", F.size("head").alias("n_fields"), *[c.cast("int").alias(f"{k}_at") for k, c in at.items()])


def data_lines(lines: DataFrame) -> DataFrame:
    """The data lines with the layout of their file: (line_id, file_kind, file_name, line_no, line, least, most, chrom_at, ...).

    The layout has one row per file. It is taken first and sent to the workers if it is small (bounded() counts it), so that no line
    is moved to meet it, however large its file; else lines and layout are joined by file, and adaptive execution parts a
    file with most lines.
    """
    named = lines.select("line_id", "file_kind", "file_name", "line_no", "raw_line").where(F.col("raw_line").isNotNull() & F.col("file_kind").isin("bed", "vcf", "maf"))
    raw, kind = F.col("raw_line"), F.col("file_kind")
    header = ((kind == "bed") & (raw.startswith("#") | raw.startswith("track") | raw.startswith("browser"))) | (kind.isin("vcf", "maf") & raw.startswith("#"))
    joined = named.where(~header).join(bounded(layout(named)), ["file_kind", "file_name"], "left")
    kept = joined.where(~((kind == "maf") & F.col("line_no").eqNullSafe(F.col("head_no"))))
    fixed = {"bed": {"chrom": 1, "start": 2, "end": 3, "strand": 6}, "vcf": {"chrom": 1, "start": 2, "allele": 4}}
    places = []
    for k in MAF_COLUMNS:
        at = F.when(kind == "bed", F.lit(fixed["bed"].get(k))).when(kind == "vcf", F.lit(fixed["vcf"].get(k))).otherwise(F.col(f"{k}_at"))
        places.append(F.when(at > 0, at).cast("int").alias(f"{k}_at"))
    known = F.coalesce(F.col("n_fields"), *[F.when(kind == k, F.lit(v)) for k, v in LEAST_FIELDS.items()])
    least = F.when(kind == "bed", F.lit(LEAST_FIELDS["bed"])).otherwise(known)
    most = F.when(kind == "bed", F.lit(BED_MOST)).otherwise(F.coalesce(F.col("n_fields"), F.lit(2_000_000_000)))
    return kept.select("line_id", kind, "file_name", "line_no", clean(raw).alias("line"), least.cast("int").alias("least"), most.cast("int").alias("most"), *places)


def checked(lines: DataFrame) -> DataFrame:
    """data_lines with their values and ``zero_cost``: whether the line loads as it is."""
    rows = data_lines(lines).withColumn("fields", fields_of(F.col("line")))
    value = {k: bare(F.get("fields", F.col(f"{k}_at") - 1)) for k in MAF_COLUMNS}
    for k, c in value.items():
        rows = rows.withColumn(k, c)
    maf, has = F.col("file_kind") == "maf", lambda k: F.col(k).isNotNull()
    even = F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 0
    size = F.size("fields").between(F.col("least"), F.col("most"))
    digits = lambda k: F.lpad(F.regexp_replace(F.col(k), r"^\+?0*", ""), 19, "0")
    ordered = (F.col("file_kind") == "vcf") | ~(has("start") & has("end")) | (digits("start") <= digits("end"))
    strand = ~has("strand") | F.col("strand").isin("+", "-") | (~maf & (F.col("strand") == "."))
    allele = ~has("allele") | _full(F.col("allele"), ALLELE) | (maf & (F.col("allele") == "-"))
    numbers = (~has("start") | is_number(F.col("start"))) & (~has("end") | is_number(F.col("end")))
    sound = F.col("line").rlike(r"[^\s]") & even & size & (~has("chrom") | _full(F.col("chrom"), CHROM)) & numbers & ordered & strand & allele
    return rows.withColumn("zero_cost", F.coalesce(sound, F.lit(False)))


def loaded(lines: DataFrame) -> DataFrame:
    """(line_id, file_kind, file_name, line_no, fields): the lines that load, their fields without enclosing quotes."""
    rows = checked(lines).where("zero_cost")
    return rows.select("line_id", "file_kind", "file_name", "line_no", F.transform("fields", bare).alias("fields")).dropDuplicates(["line_id"])


def _value(field: str) -> str:
    return field[1:-1] if len(field) >= 2 and field[0] == field[-1] == '"' else field


def _number(value: str) -> int | None:
    digits = value[1:] if value[:1] == "+" else value
    if not (digits.isascii() and digits.isdigit()):
        return None
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) <= 19 and int(digits) < 1 << 63 else None


def _wrong_types(fields: list[str], at: dict[str, int], kind: str) -> list[str]:
    """The type faults of a row of fields, in order."""
    got = {k: _value(fields[i - 1]) for k, i in at.items() if i <= len(fields)}
    out = []
    if "chrom" in got and not re.fullmatch(CHROM, got["chrom"]):
        out.append("invalid_chrom")
    numbers = [_number(got[k]) for k in ("start", "end") if k in got]
    if None in numbers:
        out.append("invalid_number")
    elif kind != "vcf" and len(numbers) == 2 and numbers[0] > numbers[1]:
        out.append("invalid_range")
    if "strand" in got and got["strand"] not in (("+", "-") if kind == "maf" else ("+", "-", ".")):
        out.append("invalid_strand")
    if "allele" in got and not (re.fullmatch(ALLELE, got["allele"]) or (kind == "maf" and got["allele"] == "-")):
        out.append("invalid_allele")
    return out


def _type_cost(value: str, role: str | None, kind: str) -> int:
    if role is None:
        return 0
    if role in ("start", "end"):
        return int(_number(_value(value)) is None)
    return int(bool(_wrong_types([value], {role: 1}, kind)))


#: Costs: one quote edit costs more than any delimiter edits, one delimiter edit more than any fields of a wrong type.
_TYPE, _DELIMITER = 1, 1_000
_NEVER = 1 << 30


def least_cost_edits(line: str, least: int, most: int, at: dict[str, int], kind: str) -> tuple[int, list[str], list[str]]:
    """(cost, edits, fields) of the cheapest way to make the line a row with an even number of quotes and least..most fields.

    One quote edit mends any parity, so an odd line gets exactly one: a quote deleted, or one inserted at the begin, the
    end or beside a tab. What is a delimiter before the edit has an even count of quotes before it, after the edit an odd
    one; so the field counts for an edit in each stretch between two tabs come from sums over the tabs, in one pass.
    """
    roles = {i: k for k, i in at.items() if i <= most}
    if line.count('"') % 2 == 0:
        return _fit(line, least, most, roles, kind)
    outer = _DELIMITER * (len(line) + 2)
    best: tuple[int, list[str], list[str]] | None = None
    for edit, text in _quote_edits(line, least, most, max(roles, default=0)):
        cost, more, fields = _fit(text, least, most, roles, kind)
        if best is None or outer + cost < best[0]:
            best = (outer + cost, [edit, *more], fields)
        if cost % _DELIMITER == 0:  # no field is of a wrong type, and the other edits leave as many delimiters to mend
            break
    return best


def _quote_edits(line: str, least: int, most: int, typed: int) -> Iterator[tuple[str, str]]:
    """(edit, text) of the quote edits that leave the field count nearest to least..most, as far as they differ in fields up to ``typed``.

    From one stretch to the next the count changes by one. Among the first ``typed`` fields it turns at each delimiter only, so
    few stretches come nearest there; of those behind them one stands for all, as no typed field differs.
    """
    stretches = line.split("\t")
    begins = list(accumulate((len(x) + 1 for x in stretches), initial=0))
    odd = [q % 2 for q in accumulate(x.count('"') for x in stretches)][:-1]  # of the quotes before each tab
    after = sum(odd) - (bool(odd) and not stretches[-1] and odd[-1])  # a final tab opens no field
    before, counts = 0, []
    for i in range(len(stretches)):
        counts.append(before + after + 1)
        if i < len(odd):
            before, after = before + 1 - odd[i], after - odd[i]
    if len(stretches) > 1 and not stretches[-1] and odd[-1]:
        counts[-1] += 1  # an edit behind the final tab makes it one that opens a field
    offs = [max(0, least - n, n - most) for n in counts]
    nearest, done, behind = min(offs), 0, False
    for i, off in enumerate(offs):
        if off == nearest and not behind:
            x, begin = stretches[i], begins[i]
            places = [k for k, c in enumerate(x) if c == '"']
            for k in places if len(places) <= 3 else places[:1]:  # a value with more quotes left is of a wrong type
                yield f"delete quote at {begin + k}", line[: begin + k] + line[begin + k + 1 :]
            for k in sorted({begin, begin + len(x)}):
                yield f"insert quote at {k}", line[:k] + '"' + line[k:]
            behind = done >= typed
        done += i < len(odd) and not odd[i]


def _cut(text: str) -> list[str]:
    """Fields by tabs outside quotes; a final tab opens no field."""
    if '"' not in text:
        out = text.split("\t")
    else:
        out, held, odd = [], [], False
        for x in text.split("\t"):
            held.append(x)
            odd ^= bool(x.count('"') % 2)
            if not odd:
                out.append("\t".join(held))
                held = []
        out += ["\t".join(held)] if held else []
    return out[:-1] if len(out) > 1 and not out[-1] and text.endswith("\t") else out


def _fit(text: str, least: int, most: int, roles: dict[int, str], kind: str) -> tuple[int, list[str], list[str]]:
    """The cheapest tab edits by which the fields of text become least..most many, of as few wrong types as can be.

    A count that is off by k takes k edits, all of them insertions or all deletions. Deleting a tab joins two fields; inserting one
    parts a field at blanks or adds an empty field.
    """
    given = _cut(text)
    n = len(given)
    goal = min(max(n, least), most)
    typed = {i: k for i, k in roles.items() if i <= goal}
    if goal == n:
        return sum(_type_cost(given[i - 1], k, kind) for i, k in typed.items()), [], given
    wrong, edits, fields = (_part if goal > n else _join)(given, goal, typed, kind)
    return abs(goal - n) * _DELIMITER + wrong, edits, fields


def _grown(text: str, piece: str, role: str, kind: str) -> str | None:
    """What stands for text + piece while a typed field is joined: the shortest text that goes on alike; None if no such field is valid any more."""
    if not piece:
        return text
    if '"' in piece or '"' in text:
        return piece if not text and not _type_cost(piece, role, kind) else None
    if role in ("start", "end"):
        whole = text + piece
        digits = whole[1:] if whole[0] == "+" else whole
        if digits and not (digits.isascii() and digits.isdigit()):
            return None
        digits = digits and (digits.lstrip("0") or "0")
        return (digits or "+") if len(digits) <= len(INT64_MAX) else None
    if role == "chrom":
        return "c" if re.fullmatch(CHROM, piece) else None
    if role == "allele" and "-" in (text, piece):
        return "-" if kind == "maf" and not text else None
    if role == "allele":
        return "A" if re.fullmatch(ALLELE, piece) else None
    return text + piece if not _type_cost(text + piece, role, kind) else None


def _join(given: list[str], goal: int, typed: dict[int, str], kind: str) -> tuple[int, list[str], list[str]]:
    """(wrong fields, edits, fields) where len(given) - goal delimiters go.

    least[v] is the least count of wrong fields if the last typed field so far ends after v given ones. A sweep over v keeps the
    texts that a field begun at any place before may still become valid with: equal ones as one, so they are few.
    """
    n = len(given)
    least, spans, made = [0], [], 0  # of no field made: it ends after none
    for place in sorted(typed):
        role, gap = typed[place], place - 1 - made
        begin, source = [_NEVER] * (n + 1), [0] * (n + 1)
        low, low_at = _NEVER, 0
        for u in range(gap, n - (goal - place)):
            v = u - gap
            if v < len(least) and (gap == 0 or least[v] < low):
                low, low_at = least[v], v
            elif gap == 0:
                low = _NEVER
            begin[u], source[u] = low, low_at
        best, ended = [_NEVER] * (n + 1), [0] * (n + 1)
        live: dict[str, tuple[int, int]] = {}
        any_cost, any_at = _NEVER, 0
        for v in range(gap + 1, n - (goal - place) + 1):
            if begin[v - 1] < _NEVER:
                if begin[v - 1] < any_cost:
                    any_cost, any_at = begin[v - 1], v - 1
                live[""] = min(live.get("", (_NEVER, 0)), (begin[v - 1], v - 1))
            grown: dict[str, tuple[int, int]] = {}
            for text, here in live.items():
                to = _grown(text, given[v - 1], role, kind)
                if to is not None and here < grown.get(to, (_NEVER, 0)):
                    grown[to] = here
            live = grown
            best[v], ended[v] = any_cost + 1, any_at
            for text, (cost, u) in live.items():
                if cost < best[v] and not _type_cost(text, role, kind):
                    best[v], ended[v] = cost, u
        spans.append((place, gap, ended, source))
        least, made = best, place
    if made == goal:
        v = n
    else:
        v = min(range(made, n - (goal - made) + 1), key=lambda x: least[x] if x < len(least) else _NEVER)
    wrong, parts, end, last = least[v], [], n, goal
    # From the end: the fields behind the last typed one, that field, those before it, and so on. Untyped ones join at their last.
    for place, gap, ended, source in reversed(spans):
        parts += _cuts(v, end, last - place)
        u = ended[v]
        parts.append((u, v))
        v, end, last = source[u], u, place - 1
        parts += _cuts(v, end, gap)
        end, last = v, place - 1 - gap
    if not spans:
        parts += _cuts(0, n, goal)
    parts.sort()
    edits = [f"delete {b - a - 1} delimiter{'s' * (b - a > 2)} after field {a + 1}" for a, b in parts if b - a > 1]
    return wrong, edits, ["".join(given[a:b]) for a, b in parts]


def _cuts(begin: int, end: int, count: int) -> list[tuple[int, int]]:
    """The given fields begin..end as count fields, the last of them joined of what is too many."""
    return [(begin + i, begin + i + 1) for i in range(count - 1)] + [(begin + count - 1, end)] * (count > 0)


def _part(given: list[str], goal: int, typed: dict[int, str], kind: str) -> tuple[int, list[str], list[str]]:
    """(wrong fields, edits, fields) where goal - len(given) delimiters come in.

    cost[p] is the least count of wrong fields if the fields made so far take the first p words of the line. Every given field
    ends a made one, so only those up to the last typed field have to be looked at; all behind it stays as it is.
    """
    n, spare, typed_end = len(given), goal - len(given), max(typed, default=0)
    words, spans, whole = [], [], []  # the words of the line, and the words and text of each field
    for text in given[:typed_end]:
        inner = [text] if '"' in text or " " not in text.strip() else text.split()
        spans.append((len(words), len(words) + len(inner)))
        whole.append(text)
        words += inner
    size = len(words)
    ended = np.zeros(size + 1, dtype=np.int64)  # given fields that the first p words end
    for _, b in spans:
        ended[b:] += 1
    cost = np.full(size + 1, _NEVER, dtype=np.int64)
    cost[0] = 0
    steps = []
    for made in range(1, typed_end + 1):
        role = typed.get(made)
        new, back = cost + _type_cost("", role, kind), np.full(size + 1, -1, dtype=np.int64)  # -1: an empty field
        for (a, b), text in zip(spans, whole, strict=True):
            if cost[a:b].min(initial=_NEVER) >= _NEVER:
                continue
            low = np.minimum.accumulate(cost[a:b])
            low_at = a + np.maximum.accumulate(np.where(cost[a:b] == low, np.arange(b - a), 0)) if b - a > 1 else np.array([a])
            take, take_at = low + (role is not None), low_at
            single = cost[a:b] + np.array([_type_cost(text if b - a == 1 else w, role, kind) for w in words[a:b]])
            better = single <= take
            take, take_at = np.where(better, single, take), np.where(better, np.arange(a, b), take_at)
            better = take <= new[a + 1 : b + 1]
            new[a + 1 : b + 1] = np.where(better, take, new[a + 1 : b + 1])
            back[a + 1 : b + 1] = np.where(better, take_at, back[a + 1 : b + 1])
        new[made - ended > spare] = _NEVER
        steps.append(back)
        cost = np.minimum(new, _NEVER)
    p = int(np.lexsort((-ended, cost))[0])
    wrong, edits, fields = int(cost[p]), [], []
    begins = {a: (u, b) for u, (a, b) in enumerate(spans)}
    used, inside = int(ended[p]), p not in begins and p < size
    rest = [*([" ".join(words[p : spans[used][1]])] if inside else []), *given[used + inside :]]
    at = p
    for back in reversed(steps):
        a = int(back[at])
        if a < 0:
            edits.append(f"insert delimiter before field {int(ended[at]) + 1}")
            fields.append("")
            continue
        u = int(ended[a])
        if at == spans[u][1]:
            fields.append(whole[u] if a == spans[u][0] else " ".join(words[a:at]))
        else:
            fields.append(" ".join(words[a:at]))
            edits.append(f"insert delimiter in field {u + 1}")
        at = a
    more = spare - (typed_end - used)
    edits.reverse()
    fields.reverse()
    if more:
        edits.append(f"insert {more} delimiter{'s' * (more > 1)} at the end")
    return wrong, edits, [*fields, *rest, *[""] * more]


def diagnose(line: str, least: int, most: int, at: dict[str, int], kind: str) -> tuple[str | None, list[str], int]:
    """(fault, edits, cost): the fault that the cheapest edits of the line state; None if there is nothing to mend."""
    if not line.strip():
        return "empty_line", [], 0
    cost, edits, fields = least_cost_edits(line, least, most, at, kind)
    if any("quote" in e for e in edits):
        return "broken_quoting", edits, cost
    if edits:
        return "wrong_field_count", edits, cost
    wrong = _wrong_types(fields, at, kind)
    return (wrong[0] if wrong else None), [f"replace {w.removeprefix('invalid_')}" for w in wrong], cost


def failed(lines: DataFrame) -> DataFrame:
    """(line_id, file_kind, file_name, line_no, line, fault, edits, cost) of the lines that fail."""
    ship(lines.sparkSession)
    places = [f"{k}_at" for k in MAF_COLUMNS]
    bad = checked(lines).where("not zero_cost").select("line_id", "file_kind", "file_name", "line_no", "line", "least", "most", *places)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("line_id", pa.int64()), ("file_kind", pa.string()), ("file_name", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("fault", pa.string()), ("edits", pa.list_(pa.string())), ("cost", pa.int64())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = {k: r[f"{k}_at"] for k in MAF_COLUMNS if r[f"{k}_at"]}
                fault, edits, cost = diagnose(r["line"], r["least"], r["most"], at, r["file_kind"])
                if fault:
                    out.append({k: r[k] for k in ("line_id", "file_kind", "file_name", "line_no", "line")} | {"fault": fault, "edits": edits, "cost": cost})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return bad.mapInArrow(parse, "line_id bigint, file_kind string, file_name string, line_no bigint, line string, fault string, edits array<string>, cost bigint")
