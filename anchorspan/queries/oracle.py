"""SQL of the core queries."""

from __future__ import annotations


def chrom_key_sql(c: str) -> str:
    """SQL of the chromosome key of a column."""
    t = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    bare = f"upper(CASE WHEN length({t}) > 3 AND lower(substr({t}, 1, 3)) = 'chr' THEN substr({t}, 4) ELSE {t} END)"
    return f"CASE WHEN {bare} = 'M' THEN 'MT' ELSE {bare} END"


PROBLEMS = {
    "p1_found": f"""
WITH r AS (SELECT 'bed_records' AS record_table, {chrom_key_sql("chrom")} AS chrom_key FROM bed_records
UNION ALL SELECT 'vcf_records', {chrom_key_sql("chrom")} FROM vcf_records),
c AS (SELECT record_table, chrom_key, count(*) AS n FROM r WHERE chrom_key IS NOT NULL GROUP BY 1, 2)
SELECT record_table, chrom_key FROM (SELECT *, sum(n) OVER (PARTITION BY record_table) AS t FROM c) WHERE n * 20 >= t
""",
    "p1_chrom_stats": f"""
WITH r AS (SELECT 'bed_records' AS record_table, {chrom_key_sql("chrom")} AS chrom_key, chrom_end - chrom_start AS v FROM bed_records
UNION ALL SELECT 'vcf_records', {chrom_key_sql("chrom")}, length(ref_allele) FROM vcf_records),
f AS (SELECT record_table, chrom_key, v, count(*) AS n FROM r WHERE chrom_key IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT record_table, chrom_key, v AS mode, n AS mode_freq FROM f WHERE v IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY record_table, chrom_key ORDER BY n DESC, v) = 1),
c AS (SELECT record_table, chrom_key, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN v IS NULL THEN 0 ELSE n END) AS BIGINT) AS n_values, count(v) AS n_distinct FROM f GROUP BY 1, 2),
p AS (SELECT record_table, chrom_key, CAST(quantile_disc(v, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(v, 0.9) AS BIGINT) AS p90 FROM r WHERE chrom_key IS NOT NULL GROUP BY 1, 2),
b AS (SELECT {chrom_key_sql("chrom")} AS k, chrom_start AS s, chrom_end AS e FROM bed_records WHERE chrom IS NOT NULL AND chrom_end > chrom_start),
g AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
cov AS (SELECT 'bed_records' AS record_table, k AS chrom_key, CAST(sum(greatest(0, e - greatest(s, coalesce(before, s)))) AS BIGINT) AS covered FROM g GROUP BY k)
SELECT c.record_table, c.chrom_key, n_rows, n_values, n_distinct, CAST(mode AS BIGINT) AS mode, mode_freq, p50, p90, covered
FROM c LEFT JOIN m USING (record_table, chrom_key) LEFT JOIN p USING (record_table, chrom_key) LEFT JOIN cov USING (record_table, chrom_key)
""",
    "p5_found": f"""
WITH a AS (SELECT trim(lift_key) AS k, {chrom_key_sql("chrom")} AS c, chrom_start AS s, chrom_end AS e, strand AS d FROM lift_ref WHERE lift_key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY trim(lift_key) ORDER BY loaded_at DESC) = 1),
b AS (SELECT trim(lift_key) AS k, {chrom_key_sql("chrom")} AS c, chrom_start AS s, chrom_end AS e, strand AS d FROM lift_test WHERE lift_key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY trim(lift_key) ORDER BY loaded_at DESC) = 1)
SELECT k AS lift_key, 'missing_in_test' AS diff_kind FROM a ANTI JOIN b USING (k)
UNION ALL SELECT k, 'missing_in_ref' FROM b ANTI JOIN a USING (k)
UNION ALL SELECT a.k, 'chrom' FROM a JOIN b USING (k) WHERE a.c IS DISTINCT FROM b.c
UNION ALL SELECT a.k, 'chrom_start' FROM a JOIN b USING (k) WHERE (a.s IS NULL) <> (b.s IS NULL) OR abs(a.s - b.s) >= 2
UNION ALL SELECT a.k, 'chrom_end' FROM a JOIN b USING (k) WHERE (a.e IS NULL) <> (b.e IS NULL) OR abs(a.e - b.e) >= 2
UNION ALL SELECT a.k, 'strand' FROM a JOIN b USING (k) WHERE a.d IS DISTINCT FROM b.d
""",
    "p2_found": f"""
WITH RECURSIVE p AS (SELECT DISTINCT ON (point_id) point_id, track_id, {chrom_key_sql("chrom")} AS k, point_start AS s, point_end AS e, CASE WHEN CAST(point_value AS VARCHAR) = 'nan' THEN NULL ELSE point_value END AS v FROM wig_points WHERE chrom IS NOT NULL ORDER BY point_id, loaded_at),
o AS (SELECT *, row_number() OVER (PARTITION BY track_id, k ORDER BY s) AS i FROM p),
f AS (SELECT track_id, k, i, s AS run_start, s AS first_s, e AS reach, v AS head, v FROM o WHERE i = 1
UNION ALL SELECT o.track_id, o.k, o.i,
CASE WHEN abs(o.v - f.head) < 1e-10 AND o.s <= f.reach THEN f.run_start ELSE o.s END, o.s,
CASE WHEN abs(o.v - f.head) < 1e-10 AND o.s <= f.reach THEN greatest(f.reach, o.e) ELSE o.e END,
CASE WHEN abs(o.v - f.head) < 1e-10 AND o.s <= f.reach THEN f.head ELSE o.v END, o.v
FROM f JOIN o ON o.track_id = f.track_id AND o.k = f.k AND o.i = f.i + 1)
SELECT track_id, k AS chrom_key, run_start, max(reach) AS run_end, count(*) AS n_points FROM f WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1
""",
}

_RUNS = PROBLEMS["p2_found"].partition("SELECT track_id, k AS chrom_key")[0]
PROBLEMS["p2_bedgraph"] = f"""{_RUNS}
SELECT track_id, k AS chrom_key, run_start, max(reach) AS run_end, count(*) AS n_points, min(head) AS run_value, max(reach) - run_start AS duration FROM f WHERE v IS NOT NULL GROUP BY 1, 2, 3
"""


def _bare(f: str) -> str:
    """SQL of a field's value without one pair of quotes around all of it."""
    return f"CASE WHEN length({f}) >= 2 AND {f}[1] = '\"' AND {f}[-1] = '\"' THEN substr({f}, 2, length({f}) - 2) ELSE {f} END"


def _bad_number(v: str) -> str:
    return f"(NOT regexp_full_match({v}, '\\+?[0-9]+') OR coalesce(TRY_CAST(ltrim({v}, '+') AS HUGEINT) > 9223372036854775807, true))"


def _fields(line: str) -> str:
    """SQL of the fields of a line: tabs within quotes shielded, a final tab opening no field."""
    shielded = f"array_to_string(list_transform(string_split({line}, '\"'), lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, chr(9), chr(2)) ELSE p END), '\"')"
    return f"string_split(regexp_replace({shielded}, '\\t$', ''), chr(9))"


_MAF = {"chrom": "Chromosome", "start": "Start_Position", "end": "End_Position", "strand": "Strand", "allele": "Reference_Allele"}
_AT = {"chrom": (1, 1), "start": (2, 2), "end": (3, "NULL"), "strand": (6, "NULL"), "allele": ("NULL", 4)}
_VALUES = ", ".join(f"{_bare(f'f[{k}_at]')} AS v_{k}" for k in _MAF)
P3 = f"""
WITH l AS (SELECT DISTINCT line_id, file_kind, file_name, line_no, raw_line AS raw, regexp_replace(raw_line, '\\r$', '') AS line FROM raw_lines WHERE raw_line IS NOT NULL AND file_kind IN ('bed', 'vcf', 'maf')),
hv AS (SELECT file_name, {_fields("line")} AS h, line_no AS head_no FROM l WHERE file_kind = 'vcf' AND starts_with(raw, '#CHROM') QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY line_no) = 1),
hm AS (SELECT file_name, {_fields("line")} AS h, line_no AS head_no FROM l WHERE file_kind = 'maf' AND NOT starts_with(raw, '#') QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY line_no) = 1),
d AS (SELECT l.*, {_fields("line")} AS f, CASE file_kind WHEN 'bed' THEN 3 WHEN 'vcf' THEN coalesce(len(hv.h), 8) ELSE len(hm.h) END AS least, CASE file_kind WHEN 'bed' THEN 12 WHEN 'vcf' THEN coalesce(len(hv.h), 2000000000) ELSE len(hm.h) END AS most,
{", ".join(f"CASE file_kind WHEN 'bed' THEN {b if k != 'allele' else 'NULL'} WHEN 'vcf' THEN {v} ELSE list_position(list_transform(hm.h, lambda x: {_bare('x')}), '{n}') END AS {k}_at" for (k, n), (b, v) in zip(_MAF.items(), _AT.values(), strict=True))}
FROM l LEFT JOIN hv ON file_kind = 'vcf' AND l.file_name = hv.file_name LEFT JOIN hm ON file_kind = 'maf' AND l.file_name = hm.file_name
WHERE NOT starts_with(raw, '#') AND NOT (file_kind = 'bed' AND (starts_with(raw, 'track') OR starts_with(raw, 'browser'))) AND NOT (file_kind = 'maf' AND l.line_no = hm.head_no)),
v AS (SELECT *, {_VALUES} FROM d),
c AS (SELECT line_id, CASE WHEN regexp_full_match(line, '\\s*') THEN 'empty_line'
WHEN (length(line) - length(replace(line, '"', ''))) % 2 = 1 THEN 'broken_quoting'
WHEN len(f) < least OR len(f) > most THEN 'wrong_field_count'
WHEN NOT regexp_full_match(v_chrom, '[A-Za-z0-9_.\\-]+') THEN 'invalid_chrom'
WHEN {_bad_number("v_start")} OR (v_end IS NOT NULL AND {_bad_number("v_end")}) THEN 'invalid_number'
WHEN file_kind <> 'vcf' AND CAST(ltrim(v_start, '+') AS HUGEINT) > CAST(ltrim(v_end, '+') AS HUGEINT) THEN 'invalid_range'
WHEN v_strand IS NOT NULL AND NOT (v_strand IN ('+', '-') OR (v_strand = '.' AND file_kind = 'bed')) THEN 'invalid_strand'
WHEN v_allele IS NOT NULL AND NOT (regexp_full_match(v_allele, '[ACGTRYSWKMBVDHNacgtryswkmbvdhn]+') OR (v_allele = '-' AND file_kind = 'maf')) THEN 'invalid_allele' END AS fault FROM v)
SELECT line_id, fault FROM c WHERE fault IS NOT NULL
"""


def _packed(name: str, key: str, field: str, pairs: bool) -> str:
    """SQL of the rows of one packed field with two values or more."""
    trim = lambda c: f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    whole = f"CASE WHEN regexp_full_match({trim('t')}, '\"(?:[^\"]|\"\")*\"') THEN replace(substr({trim('t')}, 2, length({trim('t')}) - 2), '\"\"', '\"') ELSE {trim('t')} END"
    plain = "regexp_replace(x, '[,;/|\\s]+', chr(1), 'g')"
    if pairs:
        named = "regexp_replace(regexp_replace(x, '[;|]', chr(1), 'g'), ',(\\s*[\\pL\\pN_]+=)', chr(1) || '\\1', 'g')"
        plain = f"CASE WHEN starts_with(coalesce(s[i + 1], ''), '\"') THEN regexp_replace({named}, ',(\\s*[\\pL\\pN_]+\\s+)$', chr(1) || '\\1') ELSE {named} END"
    marked = f"array_to_string(list_transform(s, lambda x, i: CASE WHEN starts_with(x, '\"') THEN x ELSE {plain} END), '')"
    unquote = lambda c: f"CASE WHEN length({c}) >= 2 AND {c}[1] = '\"' AND {c}[-1] = '\"' THEN replace(substr({c}, 2, length({c}) - 2), '\"\"', '\"') ELSE {c} END"
    equals, spaced = "regexp_matches(p, '^[^\"=]*=')", "regexp_full_match(p, '\\S+\\s+\"(?:[^\"]|\"\")*\"')"
    first = "instr(p, '=')"
    if pairs:
        key_sql = f"CASE WHEN {equals} THEN {trim(f'substr(p, 1, {first} - 1)')} WHEN {spaced} THEN regexp_extract(p, '^\\S+') ELSE p END"
        value = f"CASE WHEN {equals} THEN {trim(f'substr(p, {first} + 1)')} WHEN {spaced} THEN regexp_extract(p, '^\\S+\\s+(.*)$', 1) ELSE '' END"
    else:
        key_sql, value = "''", "p"
    return f"""SELECT '{field}' AS field_name, id AS record_id, CAST(n AS INTEGER) AS item_no, {key_sql} AS item_key, {unquote("v")} AS item_value FROM (
SELECT *, {value} AS v FROM (SELECT id, ps[n] AS p, n FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS n FROM (
SELECT id, list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {trim("x")}), lambda x: x <> '') AS ps FROM (
SELECT id, regexp_extract_all(w, '\"(?:[^\"]|\"\")*(?:\"|$)|[^\"]+') AS s FROM (SELECT DISTINCT {key} AS id, {whole} AS w FROM (SELECT {key}, {field} AS t FROM {name} WHERE {field} IS NOT NULL)) WHERE {trim("w")} <> '.'))
WHERE len(ps) > 1)))"""


_BOTH = PROBLEMS["p5_found"].partition("SELECT k AS lift_key")[0]
PROBLEMS["p5_values"] = f"""{_BOTH}
SELECT k AS lift_key, 'missing_in_test' AS diff_kind, NULL::VARCHAR AS ref_value, NULL::VARCHAR AS test_value FROM a ANTI JOIN b USING (k)
UNION ALL SELECT k, 'missing_in_ref', NULL, NULL FROM b ANTI JOIN a USING (k)
UNION ALL SELECT a.k, 'chrom', a.c, b.c FROM a JOIN b USING (k) WHERE a.c IS DISTINCT FROM b.c
UNION ALL SELECT a.k, 'chrom_start', CAST(a.s AS VARCHAR), CAST(b.s AS VARCHAR) FROM a JOIN b USING (k) WHERE (a.s IS NULL) <> (b.s IS NULL) OR abs(a.s - b.s) >= 2
UNION ALL SELECT a.k, 'chrom_end', CAST(a.e AS VARCHAR), CAST(b.e AS VARCHAR) FROM a JOIN b USING (k) WHERE (a.e IS NULL) <> (b.e IS NULL) OR abs(a.e - b.e) >= 2
UNION ALL SELECT a.k, 'strand', a.d, b.d FROM a JOIN b USING (k) WHERE a.d IS DISTINCT FROM b.d
"""
PROBLEMS["p3_found"] = P3
PROBLEMS["p3_loaded"] = P3.replace("c AS (SELECT line_id, CASE", "c AS (SELECT line_id, file_kind, file_name, line_no, f, CASE").replace("SELECT line_id, fault FROM c WHERE fault IS NOT NULL", f"SELECT line_id, file_kind, file_name, line_no, list_transform(list_transform(f, lambda x: replace(x, chr(2), chr(9))), lambda x: {_bare('x')}) AS fields FROM c WHERE fault IS NULL")
PROBLEMS["p4_found"] = "\nUNION ALL\n".join(
    _packed(*x) for x in (("vcf_records", "vcf_id", "info", True), ("vcf_records", "vcf_id", "alt_alleles", False), ("bed_records", "bed_id", "block_sizes", False), ("gff_records", "gff_id", "gff_attributes", True))
)


def all_sql() -> dict[str, str]:
    from anchorspan.queries import domain_sql

    return PROBLEMS | domain_sql.SQL
