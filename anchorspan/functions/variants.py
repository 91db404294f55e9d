"""INFO fields, allele kinds and allele rewriting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorspan.functions import dna
from anchorspan.functions.numbers import unsigned

#: Alternate alleles that stand for any or no variant.
NON_REF = ["<NON_REF>", "<*>", "."]


def _items(info: Column) -> Column:
    return F.filter(F.split(info, ";", -1), lambda x: x != "")


def info_value(info: Column, key: str) -> Column:
    """The value of a key: '' for a flag, null if the key is missing; of repeated keys the last."""
    found = F.filter(_items(F.when(info != ".", info).otherwise("")), lambda x: (F.substring_index(x, "=", 1) == key))
    last = F.get(found, F.size(found) - 1)
    return F.when(F.instr(last, "=") > 0, last.substr(F.instr(last, "=") + 1, F.length(last))).when(last.isNotNull(), F.lit(""))


def info_map(info: Column) -> Column:
    """map<string, string> of an INFO field; '' for flags; of repeated keys the last holds; '.' is an empty map."""
    pairs = F.transform(_items(F.when(info != ".", info).otherwise("")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, x.substr(F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == p["k"]))
    return F.when(info.isNotNull(), F.map_from_entries(kept))


def replace_end(info: Column, end: Column) -> Column:
    """Every END= with the digits after it rewritten, inside other keys (CIEND=), too."""
    return F.regexp_replace(info, F.lit("END=[0-9]*"), F.concat(F.lit("END="), end.cast("string")))


def set_end(info: Column, end: Column) -> Column:
    """The END item of an INFO field set to end, or appended if there is none."""
    new = F.concat(F.lit("END="), end.cast("string"))
    items = F.split(info, ";", -1)
    return F.when(F.exists(items, lambda x: x.startswith("END=")), F.array_join(F.transform(items, lambda x: F.when(x.startswith("END="), new).otherwise(x)), ";")).otherwise(F.concat(info, F.lit(";"), new))


def end_position(info: Column) -> Column:
    """END as BIGINT, null if it is missing or no number."""
    return unsigned(info_value(info, "END"))


def is_non_ref(alt: Column) -> Column:
    return alt.isin(*NON_REF)


def variant_type(ref: Column, alt: Column) -> Column:
    """By the lengths of REF and the first ALT: Substitution, Insertion or Deletion (the shorter REF inserts)."""
    first = F.length(F.substring_index(alt, ",", 1))
    return F.when(F.length(ref) == first, "Substitution").when(F.length(ref) < first, "Insertion").otherwise("Deletion")


def rewritten_alts(alt: Column, old_ref: Column, new_ref: Column, minus: Column) -> Column:
    """The ALT field on the target strand. Alleles equal to the new REF go; the field may become empty.

    A DNA allele of the length of REF is turned on the minus strand; one of another length gets the new REF's first base
    and keeps (turned, on the minus strand) the rest; any other allele stays.
    """

    def one(a: Column) -> Column:
        rest = F.substring(a, 2, 1_000_000_000)
        other = F.concat(F.substring(new_ref, 1, 1), F.when(minus, dna.revcomp(rest)).otherwise(rest))
        same = F.when(minus, dna.revcomp(a)).otherwise(a)
        return F.when(~dna.is_dna(a), a).when(F.length(a) != F.length(old_ref), other).otherwise(same)

    return F.array_join(F.filter(F.transform(F.split(alt, ",", -1), one), lambda a: a != new_ref), ",")
