"""SQL of the queries of domain.py, put together from common table expressions."""

from __future__ import annotations

from anchorspan.queries.domain import REFERENCE
from anchorspan.queries.oracle import chrom_key_sql

BLOCKS = """
o AS (SELECT l.chain_id, l.block_no, l.block_size, h.t_name, h.t_size, h.t_strand, h.q_name, h.q_size, h.q_strand,
h.t_start + coalesce(sum(block_size + coalesce(dt, 0)) OVER w, 0) AS sp, h.q_start + coalesce(sum(block_size + coalesce(dq, 0)) OVER w, 0) AS tp
FROM chain_lines l JOIN chain_headers h ON l.chain_id = h.chain_id
WINDOW w AS (PARTITION BY l.chain_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CASE WHEN t_strand = '-' THEN t_size - sp - block_size ELSE sp END AS ss, CASE WHEN q_strand = '-' THEN q_size - tp - block_size ELSE tp END AS ts FROM o),
blocks AS (SELECT chain_id * 10000000 + block_no AS block_id, t_name AS source_chrom, CAST(ss AS BIGINT) AS source_start, CAST(ss + block_size AS BIGINT) AS source_end,
q_name AS target_chrom, CAST(ts AS BIGINT) AS target_start, CAST(ts + block_size AS BIGINT) AS target_end, q_strand AS target_strand FROM p)"""


def has_prefix(c: str) -> str:
    return f"(length({c}) > 3 AND lower(substr({c}, 1, 3)) = 'chr')"


def short(c: str) -> str:
    return f"(CASE WHEN {has_prefix(c)} THEN substr({c}, 4) ELSE {c} END)"


def resolved(asked: str) -> str:
    """CTEs that end in r(q_chrom, source_chrom). asked: a query with a column q_chrom."""
    return f"""
asked AS (SELECT DISTINCT q_chrom FROM ({asked})),
known AS (SELECT DISTINCT source_chrom FROM blocks),
al AS (SELECT regexp_replace(lower(source_chrom), '^chr', '') AS a, min(source_chrom) AS source_chrom FROM known GROUP BY 1),
tries AS (SELECT q_chrom, 0 AS rank, q_chrom AS source_chrom FROM asked
UNION ALL SELECT q_chrom, 2, replace(q_chrom, 'chr', '') FROM asked UNION ALL SELECT q_chrom, 3, replace(q_chrom, 'Chr', '') FROM asked
UNION ALL SELECT q_chrom, 4, replace(q_chrom, 'CHR', '') FROM asked UNION ALL SELECT q_chrom, 5, 'chr' || q_chrom FROM asked UNION ALL SELECT q_chrom, 6, 'Chr' || q_chrom FROM asked),
hits AS (SELECT q_chrom, rank, source_chrom FROM tries JOIN known USING (source_chrom)
UNION ALL SELECT q_chrom, 1, al.source_chrom FROM asked JOIN al ON regexp_replace(lower(q_chrom), '^chr', '') = al.a),
r AS (SELECT q_chrom, min_by(source_chrom, rank) AS source_chrom FROM hits GROUP BY 1)"""


def segments(asked: str, style: str = "a") -> str:
    """CTEs that end in s(rid, q_*, seq, n, s_start, s_end, t_chrom, t_start, t_end, t_strand). asked: SQL of (rid, q_chrom, q_start, q_end, q_strand)."""
    target = {
        "a": f"CASE WHEN {has_prefix('q_chrom')} AND NOT {has_prefix('target_chrom')} THEN 'chr' || target_chrom WHEN NOT {has_prefix('q_chrom')} AND {has_prefix('target_chrom')} THEN substr(target_chrom, 4) ELSE target_chrom END",
        "s": short("target_chrom"), "l": f"'chr' || {short('target_chrom')}",
    }[style]
    return f"""
q AS ({asked}),{BLOCKS},{resolved("SELECT q_chrom FROM q WHERE q_chrom IS NOT NULL")},
x AS (SELECT q.*, b.*, greatest(q_start, source_start) AS s_start, least(q_end, source_end) AS s_end
FROM q JOIN r ON q.q_chrom = r.q_chrom JOIN blocks b ON b.source_chrom = r.source_chrom AND b.source_start < q_end AND b.source_end > q_start),
s AS (SELECT rid, q_chrom, q_start, q_end, q_strand, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, CAST(count(*) OVER (PARTITION BY rid) AS INTEGER) AS n, s_start, s_end, {target} AS t_chrom,
CASE WHEN target_strand = '-' THEN target_end - (s_start - source_start) - (s_end - s_start) ELSE target_start + s_start - source_start END AS t_start,
CASE WHEN target_strand = '-' THEN target_end - (s_start - source_start) ELSE target_start + s_end - source_start END AS t_end,
CASE WHEN (coalesce(q_strand, '+') = '-') = (target_strand = '-') THEN '+' ELSE '-' END AS t_strand
FROM x WHERE s_end >= s_start WINDOW w AS (PARTITION BY rid ORDER BY source_start, source_end, block_id))"""


def once(name: str, columns: str) -> str:
    """The rows of a table without repeated deliveries."""
    return f"(SELECT DISTINCT {columns} FROM {name})"


BED = "SELECT bed_id AS rid, chrom AS q_chrom, chrom_start AS q_start, chrom_end AS q_end, strand AS q_strand FROM " + once("bed_records", "bed_id, chrom, chrom_start, chrom_end, strand")
COMPLEMENT = "'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd'"
DNA = "'[ACGTRYSWKMBVDHNacgtryswkmbvdhn]*'"
CIGAR = "(SELECT bed_id, concat(" + ", ".join(f"((z * {k + 3} + bed_id) % 50) + 1, substr('MIDNSHP=XMM', CAST((bed_id + {k * (k + 1) // 2}) % 11 + 1 AS INTEGER), 1)" for k in range(5)) + ") AS cigar FROM (SELECT *, chrom_end - chrom_start AS z FROM " + once("bed_records", "bed_id, chrom_start, chrom_end") + "))"
SIX = "concat_ws(chr(9), chrom, chrom_start, chrom_end, coalesce(bed_name, '.'), coalesce(CAST(score AS VARCHAR), '.'), {strand}{more})"
BED_ROWS = once("bed_records", "bed_id, chrom, chrom_start, chrom_end, bed_name, score, strand, thick_start, thick_end, item_rgb, block_count, block_sizes, block_starts")
IS12 = "(thick_start IS NOT NULL AND thick_end IS NOT NULL AND item_rgb IS NOT NULL AND block_count IS NOT NULL AND block_sizes IS NOT NULL AND block_starts IS NOT NULL)"
NUMBERS = "list_transform(list_filter(string_split({c}, ','), lambda x: regexp_full_match(x, '\\+?[0-9]+')), lambda x: CAST(x AS BIGINT))"
VCF_ROWS = once("vcf_records", "vcf_id, coalesce(chrom, '.') AS chrom, pos, variant_id, ref_allele, alt_alleles, qual, filter_status, info, gt_format, sample_gt")
REGION = "SELECT bed_id AS rid, coalesce(chrom, '.') AS q_chrom, chrom_start AS q_start, chrom_start + (chrom_end - chrom_start) * CASE bed_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 100 END AS q_end, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS q_strand FROM " + once("bed_records", "bed_id, chrom, chrom_start, chrom_end, strand")
REGION_STATUS = f"""
WITH {segments(REGION)},
g AS (SELECT rid, count(*) AS n, count(DISTINCT t_chrom) AS c, sum(s_end - s_start) AS covered, min(t_start) AS t_start, max(t_end) AS t_end, max_by(t_strand, seq) AS t_strand, min(t_chrom) AS t_chrom FROM s GROUP BY 1),
j AS (SELECT q.rid, q_end - q_start AS size, coalesce(n, 0) AS n, c, covered, g.t_start, g.t_end, g.t_strand, g.t_chrom FROM q LEFT JOIN g ON q.rid = g.rid),
k AS (SELECT *, CASE WHEN size = 0 THEN NULL WHEN n = 1 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE CAST(covered AS DOUBLE) / size END AS ratio FROM j),
z AS (SELECT *, CASE WHEN size <= 0 THEN 'InvalidFormat' WHEN n = 0 THEN 'Unmap' WHEN n = 1 THEN 'ok' WHEN c > 1 THEN 'CrossChroms' WHEN ratio < 0.6 THEN 'LowRatio' ELSE 'ok' END AS status FROM k)"""
#: The converted BED records as out(rid, status, line_no, line).
BED_OUT = f"""
WITH b0 AS (SELECT * REPLACE (coalesce(chrom, '.') AS chrom), coalesce(strand, '.') AS st, {IS12} AS w FROM {BED_ROWS}),
b AS (SELECT *, CASE WHEN w THEN {NUMBERS.format(c="block_sizes")} END AS bs, CASE WHEN w THEN {NUMBERS.format(c="block_starts")} END AS bt FROM b0),
blk AS (SELECT *, coalesce(w AND len(bs) = len(bt) AND len(bs) > 0, false) AS blocked FROM b),
parts AS (SELECT bed_id, chrom, chrom_start, CASE WHEN st = '-' THEN '-' ELSE '+' END AS d, unnest(range(1, len(bs) + 1)) AS i, bs, bt FROM blk WHERE blocked),
{segments("SELECT bed_id * 1000 AS rid, chrom AS q_chrom, chrom_start AS q_start, chrom_end AS q_end, CASE WHEN st = '-' THEN '-' ELSE '+' END AS q_strand FROM blk WHERE NOT blocked UNION ALL SELECT bed_id * 1000 + i, chrom, chrom_start + bt[i], chrom_start + bt[i] + bs[i], d FROM parts")},
simple AS (SELECT bed_id, seq AS line_no, CASE WHEN w THEN concat_ws(chr(9), t_chrom, t_start, t_end, coalesce(bed_name, '.'), coalesce(CAST(score AS VARCHAR), '.'), t_strand,
greatest(thick_start + t_start - chrom_start, t_start), least(thick_end + t_start - chrom_start, t_end), item_rgb, block_count, block_sizes,
array_to_string(list_transform(list_filter(string_split(block_starts, ','), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(CAST(x AS BIGINT) + t_start - chrom_start AS VARCHAR) ELSE x END), ','))
ELSE concat_ws(chr(9), t_chrom, t_start, t_end, coalesce(bed_name, '.'), coalesce(CAST(score AS VARCHAR), '.'), t_strand) END AS line
FROM s JOIN blk ON s.rid = blk.bed_id * 1000 WHERE NOT blocked),
one AS (SELECT rid // 1000 AS bed_id, rid % 1000 AS i, t_chrom, t_start, t_end, t_strand FROM s WHERE rid % 1000 > 0 AND n = 1),
gath AS (SELECT bed_id, count(*) AS n, count(DISTINCT t_chrom) AS c, min_by(t_start, i) AS ns, max_by(t_end, i) AS ne, min_by(t_strand, i) AS sd, min(t_chrom) AS tc, min(t_start) AS least_start,
array_to_string(list(CAST(t_end - t_start AS VARCHAR) ORDER BY i), ',') AS sizes, list(t_start ORDER BY i) AS starts FROM one GROUP BY 1),
thick AS (SELECT blk.*, g.*, least(ns + greatest(thick_start - chrom_start, 0), ne) AS nts, greatest(greatest(ne - greatest(chrom_end - thick_end, 0), 0), ns) AS nte
FROM blk JOIN gath g ON blk.bed_id = g.bed_id WHERE blocked AND g.n = len(bs) AND c = 1 AND least_start >= ns),
twelve AS (SELECT bed_id, 0 AS line_no, concat_ws(chr(9), tc, ns, ne, coalesce(bed_name, '.'), coalesce(CAST(score AS VARCHAR), '.'), sd, nts, nte, item_rgb, n, sizes,
array_to_string(list_transform(starts, lambda x: CAST(x - ns AS VARCHAR)), ',')) AS line FROM thick WHERE nts <= nte AND nts >= ns AND nte <= ne),
done AS (SELECT * FROM simple UNION ALL SELECT * FROM twelve),
cnt AS (SELECT bed_id, count(*) AS k FROM done GROUP BY 1),
out AS (SELECT done.bed_id, CASE WHEN k > 1 THEN 'multi' ELSE 'ok' END AS status, CAST(line_no AS INTEGER) AS line_no, line FROM done JOIN cnt USING (bed_id)
UNION ALL SELECT bed_id, 'unmapped', 0, concat_ws(chr(9), chrom, chrom_start, chrom_end, coalesce(bed_name, '.'), coalesce(CAST(score AS VARCHAR), '.'), st,
CASE WHEN w THEN concat_ws(chr(9), thick_start, thick_end, item_rgb, block_count, block_sizes, block_starts) END) FROM blk WHERE bed_id NOT IN (SELECT bed_id FROM cnt))"""


def _alts(ref: str) -> str:
    """The rewritten ALT field against a reference base expression."""
    rest = f"CASE WHEN t_strand = '-' THEN reverse(translate(substr(a, 2), {COMPLEMENT})) ELSE substr(a, 2) END"
    same = f"CASE WHEN t_strand = '-' THEN reverse(translate(a, {COMPLEMENT})) ELSE a END"
    one = f"CASE WHEN NOT regexp_full_match(a, {DNA}) THEN a WHEN length(a) <> length(old_ref) THEN substr({ref}, 1, 1) || {rest} ELSE {same} END"
    return f"array_to_string(list_filter(list_transform(string_split(old_alt, ','), lambda a: {one}), lambda a: a <> {ref}), ',')"


#: The fields of a VCF line that stay, and a line of them.
VCF_MORE = "coalesce(variant_id, '.') AS name, coalesce(regexp_replace(CAST(qual AS VARCHAR), '\\.0$', ''), '.') AS q, coalesce(filter_status, '.') AS fs, CASE WHEN gt_format IS NOT NULL AND sample_gt IS NOT NULL THEN gt_format || chr(9) || sample_gt END AS sample"
VCF_LINE = "concat_ws(chr(9), t_chrom, t_start + 1, name, {ref}, {alt}, q, fs, {info}, sample)"
POINT = "SELECT vcf_id AS rid, chrom AS q_chrom, pos - 1 AS q_start, pos AS q_end, '+' AS q_strand FROM " + VCF_ROWS
VCF_JOINED = f"""
WITH {segments(POINT)},
f AS (SELECT * FROM s WHERE n = 1),
v AS (SELECT vcf_id, coalesce(ref_allele, '.') AS old_ref, coalesce(alt_alleles, '.') AS old_alt, CASE WHEN gt_format IS NOT NULL AND sample_gt IS NOT NULL THEN coalesce(info, '.') ELSE regexp_replace(coalesce(info, '.'), '\\s+$', '') END AS old_info, {VCF_MORE} FROM {VCF_ROWS}),
m AS (SELECT rid, max(n) AS n FROM s GROUP BY 1),
j AS (SELECT v.*, coalesce(m.n, 0) AS n, f.t_chrom, f.t_start, f.t_end, f.t_strand FROM v LEFT JOIN m ON v.vcf_id = m.rid LEFT JOIN f ON v.vcf_id = f.rid)"""


def _bases(begin: str, end: str) -> str:
    """The bases [begin, end) of the made-up reference."""
    return f"substr(repeat('{REFERENCE}', CAST(({end} - {begin}) // {len(REFERENCE)} + 2 AS INTEGER)), CAST({begin} % {len(REFERENCE)} + 1 AS INTEGER), CAST({end} - {begin} AS INTEGER))"


TARGET_SIZES = "(SELECT q_name AS name, max_by(q_size, chain_id) AS size FROM chain_headers GROUP BY 1)"
OTHER = "CASE WHEN starts_with({c}, 'chr') THEN substr({c}, 4) ELSE 'chr' || {c} END"
GVCF_ASKED = "SELECT vcf_id AS rid, chrom AS q_chrom, pos - 1 AS q_start, coalesce(stop, pos) AS q_end, '+' AS q_strand FROM gv"
END_VALUE = "TRY_CAST(regexp_extract(list_extract(list_filter(string_split({i}, ';'), lambda x: x LIKE 'END=%' OR x = 'END'), -1), '^END=\\+?([0-9]+)$', 1) AS BIGINT)"
SET_END = "CASE WHEN len(list_filter(string_split({i}, ';'), lambda x: starts_with(x, 'END='))) > 0 THEN array_to_string(list_transform(string_split({i}, ';'), lambda x: CASE WHEN starts_with(x, 'END=') THEN 'END=' || {e} ELSE x END), ';') ELSE {i} || ';END=' || {e} END"
#: The GVCF records with their place and the turned ALT as j.
GVCF_JOINED = f"""WITH gv AS (SELECT vcf_id, chrom, pos, coalesce(ref_allele, '.') AS old_ref, coalesce(alt_alleles, '.') AS old_alt, coalesce(info, '.') AS old_info, {END_VALUE.format(i="coalesce(info, '.')")} AS stop, {VCF_MORE} FROM {VCF_ROWS}),
{segments(GVCF_ASKED).strip()}, f AS (SELECT * FROM s WHERE n = 1), m AS (SELECT rid, max(n) AS n FROM s GROUP BY 1),
j AS (SELECT gv.*, coalesce(m.n, 0) AS n, f.t_chrom, f.t_start, f.t_end, f.t_strand, CASE WHEN f.t_strand = '-' THEN reverse(translate(old_alt, {COMPLEMENT})) ELSE old_alt END AS turned FROM gv LEFT JOIN m ON vcf_id = m.rid LEFT JOIN f ON vcf_id = f.rid)"""
GVCF_ALT = "CASE WHEN old_alt IN ('<NON_REF>', '<*>', '.') OR NOT regexp_full_match(old_alt, " + DNA + ") THEN old_alt WHEN turned = {ref} THEN '' ELSE turned END"
GVCF_INFO = f"CASE WHEN stop IS NOT NULL THEN {SET_END.format(i='old_info', e='t_end')} ELSE old_info END"
GFF_ROWS = once("gff_records", "gff_id, coalesce(seqname, '.') AS seqname, gff_source, feature, feat_start, feat_end, score, strand, frame_code, gff_attributes")
POINTS = once("wig_points", "point_id, track_id, chrom, point_start, point_end, point_value")
READS = f"""rd AS (SELECT bed_id, chrom, chrom_start, chrom_end, CASE WHEN bed_id % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN bed_id % 3 = 0 THEN 1 ELSE 0 END AS flag0,
coalesce(strand = '-', false) AS rev, substr('ACGTN', CAST(bed_id % 4 + 1 AS INTEGER), 2) || 'acR' AS seq0 FROM {once("bed_records", "bed_id, chrom, chrom_start, chrom_end, strand")})"""
SAM = f"""
WITH {READS}, {segments("SELECT bed_id AS rid, chrom AS q_chrom, chrom_start AS q_start, chrom_end AS q_end, CASE WHEN rev THEN '-' ELSE '+' END AS q_strand FROM rd WHERE bed_id % 7 <> 0").strip()},
j AS (SELECT rd.*, s.t_chrom, s.t_start, s.t_strand, s.n, (s.t_strand = '-') <> rev AS turned, CASE WHEN bed_id % 7 = 0 THEN 'unmapped' WHEN s.rid IS NULL THEN 'failed' ELSE 'mapped' END AS status
FROM rd LEFT JOIN s ON rd.bed_id = s.rid AND s.seq = 0)"""
PAIRED = f"""
WITH a AS (SELECT trim(lift_key) AS k, {chrom_key_sql("chrom")} AS c, chrom_start AS s, chrom_end AS e FROM lift_ref WHERE lift_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(lift_key) ORDER BY loaded_at DESC) = 1),
b AS (SELECT trim(lift_key) AS k, {chrom_key_sql("chrom")} AS c, chrom_start AS s, chrom_end AS e FROM lift_test WHERE lift_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(lift_key) ORDER BY loaded_at DESC) = 1),
j AS (SELECT a.*, b.k AS bk, b.c AS bc, b.s AS bs, b.e AS be FROM a LEFT JOIN b ON a.k = b.k)"""
MAF_INDEX = "list_position(h, '{n}')"

#: The data lines of the MAF files with their header h, fields f and place, as j; and a converted line.
MAF_JOINED = rf"""WITH l AS (SELECT DISTINCT line_id, file_name, line_no, regexp_replace(raw_line, '\r$', '') AS line FROM raw_lines WHERE file_kind = 'maf'),
c AS (SELECT file_name, line_no AS head_no, string_split(line, chr(9)) AS h FROM l WHERE NOT starts_with(line, '#') AND list_has_all(string_split(line, chr(9)), ['Chromosome', 'Start_Position', 'End_Position', 'Strand', 'Reference_Allele', 'NCBI_Build'])
QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY line_no) = 1),
d AS (SELECT l.*, c.h, head_no, string_split(regexp_replace(line, '\t$', ''), chr(9)) AS f FROM l LEFT JOIN c USING (file_name) WHERE NOT starts_with(line, '#') AND line <> '' AND (head_no IS NULL OR line_no <> head_no)),
e AS (SELECT *, head_no IS NULL OR line_no < head_no AS before, f[{MAF_INDEX.format(n="Chromosome")}] AS chrom, f[{MAF_INDEX.format(n="Start_Position")}] AS a, f[{MAF_INDEX.format(n="End_Position")}] AS b,
greatest({", ".join(MAF_INDEX.format(n=n) for n in ("Chromosome", "Start_Position", "End_Position", "Strand", "Reference_Allele", "NCBI_Build"))}) AS last FROM d),
t AS (SELECT *, coalesce(len(f) < last OR NOT regexp_full_match(a, '\+?[0-9]+') OR NOT regexp_full_match(b, '\+?[0-9]+') OR TRY_CAST(a AS BIGINT) IS NULL OR TRY_CAST(b AS BIGINT) IS NULL, true) AS bad FROM e),
{segments("SELECT line_id AS rid, chrom AS q_chrom, CAST(a AS BIGINT) - 1 AS q_start, CAST(b AS BIGINT) AS q_end, '+' AS q_strand FROM t WHERE NOT bad AND NOT before").strip()},
m AS (SELECT rid, max(n) AS n FROM s GROUP BY 1), o1 AS (SELECT * FROM s WHERE seq = 0),
j AS (SELECT t.*, coalesce(m.n, 0) AS n, t_chrom, t_start, t_end, t_strand FROM t LEFT JOIN m ON line_id = m.rid LEFT JOIN o1 ON line_id = o1.rid)"""
MAF_LINE = "array_to_string(list_transform(f, lambda x, i: CASE " + " ".join(f"WHEN i = {MAF_INDEX.format(n=n)} THEN {v}" for n, v in {"Chromosome": "t_chrom", "Start_Position": "CAST(t_start + 1 AS VARCHAR)", "End_Position": "CAST(t_end AS VARCHAR)", "NCBI_Build": "'new'", "Reference_Allele": "{ref}"}.items()) + " ELSE x END), chr(9))"

SQL: dict[str, str] = {
    "chain_headers": "SELECT CAST(chain_id AS VARCHAR) AS chain_id, score, t_name AS source_name, t_size AS source_size, t_strand AS source_strand, t_start AS source_start, t_end AS source_end, q_name AS target_name, q_size AS target_size, q_strand AS target_strand, q_start AS target_start, q_end AS target_end FROM chain_headers",
    "chain_blocks": f"WITH {BLOCKS} SELECT * FROM blocks",
    "chain_text_blocks": f"WITH {BLOCKS} SELECT * EXCLUDE (block_id) FROM blocks",
    "chain_sizes": "SELECT 'source' AS side, t_name AS chrom, max_by(t_size, chain_id) AS size FROM chain_headers GROUP BY t_name UNION ALL SELECT 'target', q_name, max_by(q_size, chain_id) FROM chain_headers GROUP BY q_name",
    "blocks_per_chrom": f"WITH {BLOCKS} SELECT source_chrom, count(*) AS n_blocks FROM blocks GROUP BY 1",
    "chrom_normalize": f"SELECT chrom, CASE WHEN upper({short('chrom')}) = 'M' THEN 'MT' ELSE upper({short('chrom')}) END AS normal, {chrom_key_sql('chrom')} AS chrom_key, regexp_replace(lower(chrom), '^chr', '') AS alias_key, {short('chrom')} AS short_name, 'chr' || {short('chrom')} AS long_name FROM (SELECT DISTINCT chrom FROM bed_records WHERE chrom IS NOT NULL)",
    "chroms_equivalent": f"SELECT chain_id, ({chrom_key_sql('t_name')}) = ({chrom_key_sql('q_name')}) AS same_name FROM chain_headers",
    "chrom_resolve": f"WITH {BLOCKS},{resolved('SELECT chrom AS q_chrom FROM bed_records WHERE chrom IS NOT NULL')} SELECT q_chrom, source_chrom FROM r",
    "chrom_known": f"WITH {BLOCKS},{resolved('SELECT chrom AS q_chrom FROM bed_records WHERE chrom IS NOT NULL')} SELECT chrom AS q_chrom, count(DISTINCT bed_id) AS n_records FROM bed_records JOIN r ON chrom = q_chrom GROUP BY 1",
    "dna_functions": f"SELECT vcf_id, translate(ref_allele, {COMPLEMENT}) AS complement, reverse(translate(ref_allele, {COMPLEMENT})) AS revcomp, reverse(translate(regexp_replace(upper(ref_allele), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS read_revcomp, regexp_full_match(ref_allele, {DNA}) AS is_dna FROM {once('vcf_records', 'vcf_id, ref_allele')}",
    "strand_combine": "SELECT chain_id, CASE WHEN t_strand = q_strand THEN '+' ELSE '-' END AS combined FROM chain_headers",
    "intersect_intervals": f"SELECT bed_id, CASE WHEN chrom_start < thick_end AND chrom_end > thick_start THEN greatest(chrom_start, thick_start) END AS both_start, CASE WHEN chrom_start < thick_end AND chrom_end > thick_start THEN least(chrom_end, thick_end) END AS both_end FROM {once('bed_records', 'bed_id, chrom_start, chrom_end, thick_start, thick_end')} WHERE thick_start IS NOT NULL",
    "info_lookup": f"""WITH v AS (SELECT vcf_id, info, pos, list_filter(string_split(CASE WHEN info = '.' THEN '' ELSE info END, ';'), lambda x: x <> '') AS t FROM {once("vcf_records", "vcf_id, pos, info")} WHERE info IS NOT NULL),
k AS (SELECT *, list_extract(list_filter(t, lambda x: string_split(x, '=')[1] = 'DP'), -1) AS d, list_extract(list_filter(t, lambda x: string_split(x, '=')[1] = 'DB'), -1) AS f, list_extract(list_filter(t, lambda x: string_split(x, '=')[1] = 'AF'), -1) AS a FROM v)
SELECT vcf_id, CASE WHEN d LIKE '%=%' THEN substr(d, 4) WHEN d IS NOT NULL THEN '' END AS dp, CASE WHEN f LIKE '%=%' THEN substr(f, 4) WHEN f IS NOT NULL THEN '' END AS db, CASE WHEN a LIKE '%=%' THEN substr(a, 4) WHEN a IS NOT NULL THEN '' END AS af,
{END_VALUE.format(i="info")} AS end_position, regexp_replace(info, 'END=[0-9]*', 'END=' || pos, 'g') AS end_replaced, {SET_END.format(i="info", e="pos")} AS end_set FROM k""",
    "vcf_variant_type": f"SELECT vcf_id, CASE WHEN ref_allele IS NULL THEN 'Deletion' WHEN length(ref_allele) = l THEN 'Substitution' WHEN length(ref_allele) < l THEN 'Insertion' ELSE 'Deletion' END AS variant_type, alt IN ('<NON_REF>', '<*>', '.') AS is_non_ref FROM (SELECT vcf_id, ref_allele, coalesce(alt_alleles, '.') AS alt, length(string_split(coalesce(alt_alleles, '.'), ',')[1]) AS l FROM {once('vcf_records', 'vcf_id, ref_allele, alt_alleles')})",
    "cigar_functions": f"""WITH c AS (SELECT bed_id, cigar, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS t FROM {CIGAR}),
u AS (SELECT bed_id, unnest(t) AS o, unnest(range(1, len(t) + 1)) AS i FROM c),
w AS (SELECT bed_id, i, CAST(regexp_extract(o, '[0-9]+') AS BIGINT) AS n, right(o, 1) AS k FROM u),
l AS (SELECT bed_id, sum(CASE WHEN k IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS rl, sum(CASE WHEN k IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) AS ql FROM w GROUP BY 1),
b AS (SELECT *, CASE WHEN lag(k) OVER o = k AND k <> 'P' THEN 0 ELSE 1 END AS new FROM w WINDOW o AS (PARTITION BY bed_id ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY bed_id ORDER BY i) AS g FROM b),
m AS (SELECT bed_id, g, sum(n) AS n, min(k) AS k FROM g GROUP BY 1, 2),
mm AS (SELECT bed_id, string_agg(CAST(n AS VARCHAR) || k, '' ORDER BY g) AS merged FROM m GROUP BY 1)
SELECT c.bed_id, cigar, CAST(rl AS BIGINT) AS ref_length, CAST(ql AS BIGINT) AS read_length, array_to_string(list_reverse(t), '') AS reversed, merged FROM c JOIN l USING (bed_id) JOIN mm USING (bed_id)""",
    "lift_segments": f"WITH {segments(BED)} SELECT rid AS bed_id, n AS n_segments, seq, s_start, s_end, t_chrom, t_start, t_end, t_strand FROM s",
    "lift_chrom_short": f"WITH {segments(BED, 's')} SELECT rid AS bed_id, seq, t_chrom FROM s",
    "lift_chrom_long": f"WITH {segments(BED, 'l')} SELECT rid AS bed_id, seq, t_chrom FROM s",
    "lift_arity": f"WITH {segments(BED)}, c AS (SELECT rid, max(n) AS n FROM s GROUP BY 1) SELECT CAST(CASE WHEN r.q_chrom IS NULL THEN -1 ELSE coalesce(c.n, 0) END AS INTEGER) AS n_segments, count(*) AS n_records FROM q LEFT JOIN c ON q.rid = c.rid LEFT JOIN r ON q.q_chrom = r.q_chrom GROUP BY 1",
    "lift_unmapped": f"WITH {segments(BED)} SELECT q.rid AS bed_id, r.q_chrom IS NOT NULL AS chrom_known FROM q LEFT JOIN r ON q.q_chrom = r.q_chrom WHERE q.rid NOT IN (SELECT rid FROM s)",
    "map_single": f"WITH {segments('SELECT bed_id AS rid, chrom AS q_chrom, chrom_start AS q_start, chrom_start + 1 AS q_end, NULL::VARCHAR AS q_strand FROM ' + once('bed_records', 'bed_id, chrom, chrom_start'))} SELECT rid AS bed_id, t_chrom, t_start, t_strand FROM s WHERE seq = 0",
    "overlap_pairs": f"WITH {BLOCKS}, g AS (SELECT DISTINCT gff_id, {chrom_key_sql('seqname')} AS k, feat_start - 1 AS s, feat_end AS e FROM gff_records WHERE feat_start <= feat_end) SELECT gff_id, block_id FROM g JOIN blocks ON k = ({chrom_key_sql('source_chrom')}) AND s < source_end AND e > source_start",
    "lift_bed": f"{BED_OUT} SELECT * FROM out",
    "bed_stats": f"{BED_OUT} SELECT status, count(DISTINCT bed_id) AS n_records, CAST(sum(CASE WHEN status = 'unmapped' THEN 0 ELSE 1 END) AS BIGINT) AS n_lines FROM out GROUP BY 1",
    "lift_region": f"{REGION_STATUS} SELECT rid AS bed_id, status, round(CASE WHEN status = 'InvalidFormat' THEN NULL ELSE ratio END, 6) AS ratio, CASE WHEN status = 'ok' THEN t_chrom END AS t_chrom, CASE WHEN status = 'ok' THEN t_start END AS t_start, CASE WHEN status = 'ok' THEN t_end END AS t_end, CASE WHEN status = 'ok' THEN t_strand END AS t_strand FROM z",
    "region_failures": f"{REGION_STATUS} SELECT status, count(*) AS n_regions FROM z GROUP BY 1",
    "lift_vcf": f"""{VCF_JOINED}, k AS (SELECT *, CASE WHEN n = 0 THEN 'Unmap' WHEN n > 1 THEN 'Multiple_hits' ELSE 'ok' END AS status FROM j),
z AS (SELECT *, CASE WHEN status = 'ok' THEN old_ref END AS new_ref, CASE WHEN status = 'ok' THEN {_alts("old_ref")} END AS new_alt, CASE WHEN status = 'ok' THEN regexp_replace(old_info, 'END=[0-9]*', 'END=' || t_end, 'g') END AS new_info FROM k)
SELECT vcf_id, status, t_chrom, t_start + 1 AS new_pos, new_ref, new_alt, new_info, CASE WHEN status = 'ok' THEN {VCF_LINE.format(ref="new_ref", alt="new_alt", info="new_info")} END AS out_line FROM z""",
    "lift_vcf_reference": f"""{VCF_JOINED}, sz AS {TARGET_SIZES},
w AS (SELECT j.*, coalesce(a.size, b.size) AS size FROM j LEFT JOIN sz a ON t_chrom = a.name LEFT JOIN sz b ON {OTHER.format(c="t_chrom")} = b.name),
u AS (SELECT *, CASE WHEN t_start >= 0 AND t_start < size THEN substr('{REFERENCE}', CAST(t_start % {len(REFERENCE)} + 1 AS INTEGER), 1) END AS nr FROM w),
k AS (SELECT *, CASE WHEN n = 0 THEN 'Unmap' WHEN n > 1 THEN 'Multiple_hits' WHEN nr IS NULL THEN 'KeyError' ELSE 'ok' END AS status FROM u)
SELECT vcf_id, status, CASE WHEN status = 'ok' THEN t_chrom END AS t_chrom, CASE WHEN status = 'ok' THEN t_start + 1 END AS new_pos, CASE WHEN status = 'ok' THEN nr END AS new_ref, CASE WHEN status = 'ok' THEN {_alts("nr")} END AS new_alt FROM k""",
    "fasta_fetch": f"""WITH sz AS {TARGET_SIZES}, g AS (SELECT gff_id, seqname, feat_start - 1 AS a, feat_end AS b FROM {GFF_ROWS}),
w AS (SELECT g.*, coalesce(x.size, y.size) AS size FROM g LEFT JOIN sz x ON seqname = x.name LEFT JOIN sz y ON {OTHER.format(c="seqname")} = y.name)
SELECT gff_id, CASE WHEN a >= 0 AND b > a AND a < size THEN {_bases("a", "least(b, size)")} END AS bases FROM w""",
    "lift_gvcf": f"""{GVCF_JOINED}
SELECT vcf_id, CASE WHEN n = 0 THEN 'Unmapped' WHEN n > 1 THEN 'Multiple' ELSE 'ok' END AS status, t_chrom, t_start + 1 AS new_pos,
CASE WHEN n = 1 THEN {GVCF_ALT.format(ref="old_ref")} END AS new_alt, CASE WHEN n = 1 THEN {GVCF_INFO} END AS new_info FROM j""",
    "lift_gvcf_reference": f"""{GVCF_JOINED}, sz AS {TARGET_SIZES},
w AS (SELECT j.*, coalesce(a.size, b.size) AS size FROM j LEFT JOIN sz a ON t_chrom = a.name LEFT JOIN sz b ON {OTHER.format(c="t_chrom")} = b.name),
u AS (SELECT *, CASE WHEN stop IS NOT NULL THEN old_ref WHEN t_start >= 0 AND t_start < size THEN {_bases("t_start", "t_start + 1")} END AS nr FROM w),
k AS (SELECT *, CASE WHEN n = 0 THEN 'Unmapped' WHEN n > 1 THEN 'Multiple' WHEN nr IS NULL THEN 'KeyError' ELSE 'ok' END AS status FROM u)
SELECT vcf_id, status, CASE WHEN status = 'ok' THEN {VCF_LINE.format(ref="nr", alt=GVCF_ALT.format(ref="nr"), info=GVCF_INFO)} END AS out_line FROM k""",
    "lift_gff": f"""WITH {segments("SELECT gff_id AS rid, seqname AS q_chrom, feat_start - 1 AS q_start, feat_end AS q_end, strand AS q_strand FROM " + GFF_ROWS)},
m AS (SELECT rid, max(n) AS n FROM s GROUP BY 1), f AS (SELECT * FROM s WHERE seq = 0),
j AS (SELECT g.*, coalesce(m.n, 0) AS n, t_chrom, t_start, t_end, t_strand FROM {GFF_ROWS} g LEFT JOIN m ON gff_id = m.rid LEFT JOIN f ON gff_id = f.rid),
k AS (SELECT *, CASE WHEN coalesce(strand, '.') NOT IN ('+', '-', '.') THEN 'parse_error' WHEN n = 0 THEN 'unmapped' WHEN n > 1 THEN 'multiple' WHEN t_end - t_start <> feat_end - feat_start + 1 THEN 'resized' ELSE 'ok' END AS status FROM j)
SELECT gff_id, status, CASE WHEN status = 'ok' THEN concat_ws(chr(9), t_chrom, coalesce(gff_source, '.'), coalesce(feature, '.'), t_start + 1, t_end, coalesce(regexp_replace(CAST(score AS VARCHAR), '\\.0$', ''), '.'), t_strand, coalesce(frame_code, '.'), coalesce(gff_attributes, '.')) END AS out_line FROM k""",
    "lift_maf": f"""{MAF_JOINED}, k AS (SELECT *, CASE WHEN before THEN 'no_header' WHEN bad THEN 'parse_error' WHEN n = 0 THEN 'unmapped' WHEN n > 1 THEN 'multiple' ELSE 'ok' END AS status FROM j)
SELECT line_id, status, CASE WHEN status = 'ok' THEN {MAF_LINE.format(ref="x")} END AS out_line FROM k""",
    "lift_maf_reference": f"""{MAF_JOINED}, sz AS {TARGET_SIZES},
w AS (SELECT j.*, coalesce(a.size, b.size) AS size FROM j LEFT JOIN sz a ON t_chrom = a.name LEFT JOIN sz b ON {OTHER.format(c="t_chrom")} = b.name),
u AS (SELECT *, CASE WHEN t_start >= 0 AND t_end > t_start AND t_start < size THEN {_bases("t_start", "least(t_end, size)")} END AS got FROM w),
k AS (SELECT *, CASE WHEN t_strand = '-' THEN reverse(translate(got, {COMPLEMENT})) ELSE got END AS nr, CASE WHEN before THEN 'no_header' WHEN bad THEN 'parse_error' WHEN n = 0 THEN 'unmapped' WHEN n > 1 THEN 'multiple' WHEN got IS NULL THEN 'KeyError' ELSE 'ok' END AS status FROM u)
SELECT line_id, status, CASE WHEN status = 'ok' THEN {MAF_LINE.format(ref="nr")} END AS out_line FROM k""",
    "lift_wig": f"""WITH pt AS (SELECT * FROM {POINTS}), {segments("SELECT point_id AS rid, chrom AS q_chrom, point_start AS q_start, point_end AS q_end, '+' AS q_strand FROM pt WHERE point_value IS NOT NULL").strip()},
m AS (SELECT rid, max(n) AS n FROM s GROUP BY 1), f AS (SELECT * FROM s WHERE n = 1)
SELECT point_id, CASE WHEN point_value IS NULL THEN 'no_value' WHEN m.n IS NULL THEN 'unmapped' WHEN m.n > 1 THEN 'multiple' ELSE 'ok' END AS status, t_chrom, t_start, t_end FROM pt LEFT JOIN m ON point_id = m.rid LEFT JOIN f ON point_id = f.rid""",
    "wig_merge": f"""WITH pt AS (SELECT point_id, concat_ws('|', track_id, {chrom_key_sql("chrom")}) AS c, point_start AS s, point_end AS e, CAST(point_value AS VARCHAR) = 'nan' AS odd, CASE WHEN CAST(point_value AS VARCHAR) <> 'nan' THEN floor(point_value * 2) / 2 + 0.0 END AS v FROM {POINTS}),
a AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS nv FROM pt WINDOW w AS (PARTITION BY c ORDER BY s, point_id)),
b AS (SELECT *, sum(nv) OVER (PARTITION BY c ORDER BY s, point_id) AS g FROM a),
d AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY c, g ORDER BY s, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM b),
f AS (SELECT *, sum(gap) OVER (PARTITION BY c, g ORDER BY s, point_id) AS i FROM d)
SELECT c AS chrom, min(s) AS start, max(e) AS "end", v AS value FROM f WHERE v IS NOT NULL GROUP BY c, g, i, v UNION ALL SELECT c, s, e, NULL FROM pt WHERE odd""",
    "wig_text": f"""WITH pt AS (SELECT * REPLACE (coalesce(regexp_replace(chrom, '\\s', '_', 'g'), 'none') AS chrom) FROM {POINTS}),
x AS (SELECT point_id * 4 AS line_no, chrom, point_start AS s, point_end AS e, point_value AS v, NULL AS wrong FROM pt WHERE point_id % 3 = 0 AND point_value IS NOT NULL
UNION ALL SELECT point_id * 4 + 1, chrom, point_start, point_end, point_value, 'invalid number' FROM pt WHERE point_id % 3 = 1
UNION ALL SELECT point_id * 4 + k, chrom, point_start + 7 * (k - 1), point_end + 7 * (k - 1), point_value, 'invalid number' FROM pt, (SELECT unnest([1, 2]) AS k) WHERE point_id % 3 = 2)
SELECT line_no, CASE WHEN v IS NULL THEN wrong END AS error, CASE WHEN v IS NOT NULL THEN chrom END AS chrom, CASE WHEN v IS NOT NULL THEN s END AS start, CASE WHEN v IS NOT NULL THEN e END AS "end", CASE WHEN CAST(v AS VARCHAR) <> 'nan' THEN v + 0.0 END AS value FROM x""",
    "bedgraph_lines": f"""WITH t AS (SELECT *, CAST(point_value + 0.0 AS VARCHAR) AS v FROM {POINTS} WHERE point_value IS NOT NULL AND chrom IS NOT NULL),
d AS (SELECT *, starts_with(v, '-') AS neg, replace(replace(regexp_extract(v, '^-?([0-9.]+)e', 1), '.', ''), '-', '') AS m, CAST(nullif(regexp_extract(v, 'e-([0-9]+)$', 1), '') AS INTEGER) AS small FROM t)
SELECT point_id, concat_ws(chr(9), chrom, point_start, point_end, CASE WHEN v = 'nan' THEN 'NaN' WHEN small IS NOT NULL THEN CASE WHEN neg THEN '-' ELSE '' END || '0.' || repeat('0', small - 1) || m ELSE regexp_replace(v, '\\.0$', '') END) AS line FROM d""",
    "lift_sam": f"""{SAM} SELECT bed_id, status, CAST(CASE WHEN status = 'failed' THEN 4 WHEN status = 'unmapped' THEN flag0 ELSE xor(flag0, CASE WHEN turned THEN 16 ELSE 0 END) + CASE WHEN n > 1 THEN 256 ELSE 0 END END AS INTEGER) AS flag,
CASE WHEN status = 'mapped' THEN t_chrom ELSE '*' END AS rname, CASE WHEN status = 'mapped' THEN t_start ELSE 0 END AS pos, CAST(CASE WHEN status = 'mapped' THEN bed_id % 60 ELSE 255 END AS INTEGER) AS mapq,
CASE WHEN status <> 'mapped' THEN '*' WHEN turned THEN '3I' || (chrom_end - chrom_start) || 'M2S' ELSE '2S' || (chrom_end - chrom_start) || 'M3I' END AS cigar,
CASE WHEN status = 'mapped' AND turned THEN reverse(translate(regexp_replace(upper(seq0), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) ELSE seq0 END AS seq, CASE WHEN status = 'mapped' AND turned THEN 'JIHGF' ELSE 'FGHIJ' END AS qual, CASE WHEN status = 'mapped' THEN 'NM:i:1' ELSE '' END AS tags FROM j""",
    "sam_lines": f"""{SAM}, k AS (SELECT *, CAST(CASE WHEN status = 'failed' THEN 4 WHEN status = 'unmapped' THEN flag0 ELSE xor(flag0, CASE WHEN turned THEN 16 ELSE 0 END) + CASE WHEN n > 1 THEN 256 ELSE 0 END END AS INTEGER) AS fl, status = 'mapped' AS ok FROM j)
SELECT bed_id, concat_ws(chr(9), 'read' || bed_id, fl, CASE WHEN ok THEN t_chrom ELSE '*' END, CASE WHEN ok THEN t_start ELSE 0 END + 1, CASE WHEN ok THEN bed_id % 60 ELSE 255 END,
CASE WHEN NOT ok THEN '*' WHEN turned THEN '3I' || (chrom_end - chrom_start) || 'M2S' ELSE '2S' || (chrom_end - chrom_start) || 'M3I' END, '*', 1, 0,
CASE WHEN ok AND turned THEN reverse(translate(regexp_replace(upper(seq0), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) ELSE seq0 END, CASE WHEN ok AND turned THEN 'JIHGF' ELSE 'FGHIJ' END, CASE WHEN ok THEN 'NM:i:1' END) AS line FROM k""",
    "cigar_valid": f"""WITH u AS (SELECT bed_id, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS o FROM {CIGAR}), l AS (SELECT bed_id, sum(CASE WHEN right(o, 1) IN ('M', 'I', 'S', '=', 'X') THEN CAST(regexp_extract(o, '[0-9]+') AS BIGINT) ELSE 0 END) AS ql FROM u GROUP BY 1)
SELECT bed_id, ql = 60 AS fits_60, ql = 100 AS fits_100 FROM l""",
    "cigar_broken": f"""WITH u AS (SELECT bed_id, unnest(t) AS o, unnest(range(1, len(t) + 1)) AS i FROM (SELECT bed_id, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS t FROM {CIGAR})),
w AS (SELECT bed_id, i, CAST(regexp_extract(o, '[0-9]+') AS BIGINT) AS n, right(o, 1) AS k FROM u),
x AS (SELECT *, CASE WHEN k IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END AS onref, CASE WHEN k IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END AS onread FROM w),
c AS (SELECT *, sum(onref) OVER (PARTITION BY bed_id ORDER BY i) AS upto, sum(onread) OVER (PARTITION BY bed_id ORDER BY i) AS read_upto, CAST(floor(sum(onref) OVER (PARTITION BY bed_id) / 2) AS BIGINT) AS cut FROM x),
h AS (SELECT bed_id, min(CASE WHEN upto > cut THEN i END) AS hit FROM c GROUP BY 1),
y AS (SELECT c.*, h.hit, cut - (upto - onref) AS kept FROM c JOIN h USING (bed_id)),
parts AS (SELECT bed_id, 'left' AS side, i * 2 AS i, n, k FROM y WHERE hit IS NULL OR i < hit UNION ALL SELECT bed_id, 'left', i * 2, kept, k FROM y WHERE i = hit AND kept > 0
UNION ALL SELECT bed_id, 'left', i * 2 + 1, onread - kept, 'S' FROM y WHERE i = hit AND onread > kept UNION ALL SELECT bed_id, 'right', 0, read_upto - onread + kept, 'S' FROM y WHERE i = hit
UNION ALL SELECT bed_id, 'right', i * 2, n - kept, k FROM y WHERE i = hit UNION ALL SELECT bed_id, 'right', i * 2, n, k FROM y WHERE i > hit),
b AS (SELECT *, CASE WHEN lag(k) OVER o = k AND k <> 'P' THEN 0 ELSE 1 END AS new FROM parts WINDOW o AS (PARTITION BY bed_id, side ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY bed_id, side ORDER BY i) AS g FROM b), m AS (SELECT bed_id, side, g, sum(n) AS n, min(k) AS k FROM g GROUP BY 1, 2, 3),
z AS (SELECT bed_id, side, string_agg(CAST(n AS VARCHAR) || k, '' ORDER BY g) AS c FROM m GROUP BY 1, 2)
SELECT bed_id, coalesce(max(CASE WHEN side = 'left' THEN c END), '') AS left_part, coalesce(max(CASE WHEN side = 'right' THEN c END), '') AS right_part FROM z GROUP BY 1""",
    "chain_comments": f"WITH {BLOCKS} SELECT * EXCLUDE (block_id) FROM blocks WHERE NOT (block_id // 10000000 % 3 = 0 AND block_id % 10000000 > 1)",
    "chain_faults": """WITH h AS (SELECT chain_id * 1000000 + 10 AS line_no, CASE WHEN chain_id % 7 = 0 THEN 'InvalidStrand' WHEN chain_id % 5 = 0 THEN 'InvalidNumber' WHEN chain_id % 3 = 0 THEN 'InvalidCoordinates' WHEN chain_id % 2 = 0 THEN 'InvalidHeader' END AS kind FROM chain_headers),
d AS (SELECT chain_id * 1000000 + 20 + block_no * 2 AS line_no, CASE (chain_id * 1000000 + 20 + block_no * 2) % 11 WHEN 1 THEN 'InvalidDataLine' WHEN 2 THEN 'InvalidDataLine' WHEN 3 THEN 'InvalidNumber' END AS kind FROM chain_lines)
SELECT * FROM h WHERE kind IS NOT NULL UNION ALL SELECT * FROM d WHERE kind IS NOT NULL""",
    "chain_size_lookup": f"WITH sz AS {TARGET_SIZES} SELECT chrom, coalesce(a.size, b.size, c.size) AS size FROM (SELECT DISTINCT chrom FROM bed_records WHERE chrom IS NOT NULL) LEFT JOIN sz a ON chrom = a.name LEFT JOIN sz b ON regexp_replace(chrom, '^chr', '') = b.name LEFT JOIN sz c ON 'chr' || chrom = c.name",
    "fasta_text": f"""WITH v AS (SELECT DISTINCT vcf_id, {chrom_key_sql("chrom")} AS name, ref_allele FROM vcf_records WHERE chrom IS NOT NULL AND ref_allele IS NOT NULL),
t AS (SELECT name, string_agg(ref_allele, '' ORDER BY vcf_id) AS seq FROM v GROUP BY 1)
SELECT name, CAST(k AS BIGINT) AS chunk_no, substr(seq, CAST(k * 50 + 1 AS INTEGER), 50) AS seq FROM (SELECT *, unnest(range(0, (length(seq) + 49) // 50)) AS k FROM t)""",
    "sam_stats": f"{SAM} SELECT status, flag0 % 2 = 1 AS paired, count(*) AS n FROM j GROUP BY 1, 2",
    "accuracy_compare": f"{PAIRED} SELECT CASE WHEN bk IS NULL THEN 'missing' WHEN c IS NOT DISTINCT FROM bc AND s IS NOT DISTINCT FROM bs AND e IS NOT DISTINCT FROM be THEN 'identical' WHEN c IS NOT DISTINCT FROM bc AND s < be AND e > bs THEN 'partial' ELSE 'mismatch' END AS kind, count(*) AS n_records FROM j GROUP BY 1",
    "drift_buckets": f"{PAIRED} SELECT CASE WHEN abs(s - bs) = 0 THEN '0' WHEN abs(s - bs) = 1 THEN '1' WHEN abs(s - bs) <= 100 THEN '2-100' WHEN abs(s - bs) > 100 THEN '>100' ELSE 'unknown' END AS drift, count(*) AS n_records FROM j WHERE bk IS NOT NULL AND c = bc GROUP BY 1",
}
SQL["file_bed"] = f"{BED_OUT} SELECT CASE WHEN status = 'unmapped' THEN 'unmapped' ELSE 'mapped' END AS side, line FROM out"
#: Through a file, a read on a sequence that the header lacks fails, and bases have one case.
SQL["file_bam"] = SQL["sam_lines"].replace("WHEN s.rid IS NULL THEN", "WHEN s.rid IS NULL OR t_chrom NOT IN (SELECT q_name FROM chain_headers) THEN").replace("ELSE seq0 END, CASE WHEN ok AND turned", "ELSE upper(seq0) END, CASE WHEN ok AND turned").replace("SELECT bed_id, concat_ws", "SELECT concat_ws")
SQL["lift_segments_join"] = SQL["lift_segments"]
