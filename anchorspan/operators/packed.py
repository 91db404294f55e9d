"""Several values packed in one field: one row per value with its place.

Quoted spans are replaced by collision-free indexed placeholders, the remaining separators split the field, and the
spans come back through an array lookup. All of it is JVM-side column expressions; the only row growth is posexplode.

Defined results: a null field, a lone ``.``, an empty or blank field hold no value; a quote that is never closed runs
to the end of the field; empty pieces are no values and take no number; equal values stay apart by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.functions.chrom import trimmed

#: Fixed values. MARK encloses placeholders: MARK index MARK stands for a quoted span, MARK c MARK for MARK itself.
MARK = "\x01"
QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
LIST_SEPARATORS = r"[,;/|\s]+"
PAIR_SEPARATORS = r"[;|]|,(?=\s*[\p{L}\p{N}_]++(?:=|\s+" + MARK + r"[0-9]))"


def unquoted(span: Column) -> Column:
    """A quoted span without its quotes; doubled quotes within become single ones."""
    inner = F.regexp_replace(F.regexp_replace(span, r'\A"', ""), r'"\z', "")
    return F.regexp_replace(inner, '""', '"')


def masked(text: Column) -> tuple[Column, Column]:
    """(text with placeholders for its quoted spans, array of the spans)."""
    spans = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    between = F.split(F.replace(text, F.lit(MARK), F.lit(f"{MARK}c{MARK}")), QUOTED, -1)
    held = F.transform(between, lambda part, i: F.when(i > 0, F.concat(F.lit(MARK), (i - 1).cast("string"), F.lit(MARK), part)).otherwise(part))
    return F.array_join(held, ""), spans


def restored(piece: Column, spans: Column, unquote: bool) -> Column:
    """piece with its placeholders replaced by their spans, which lose their quotes if ``unquote``."""
    parts = F.split(piece, MARK, -1)

    def back(part: Column, i: Column) -> Column:
        span = F.replace(F.get(spans, part.try_cast("int")), F.lit(f"{MARK}c{MARK}"), F.lit(MARK))
        return F.when(i % 2 == 0, part).when(part == "c", F.lit(MARK)).otherwise(unquoted(span) if unquote else span)

    return F.when(F.instr(piece, MARK) > 0, F.array_join(F.transform(parts, back), "")).otherwise(piece)


def read_field(text: Column) -> Column:
    """The field to split: trimmed, and unquoted if one quoted text is all of it."""
    bare = trimmed(text)
    whole = F.when(bare.rlike(r"\A" + QUOTED.replace(r"|\z", "") + r"\z"), unquoted(bare)).otherwise(bare)
    return F.when(trimmed(whole) != ".", whole)


def pieces(text: Column, pairs: bool) -> Column:
    """array<struct<item_key, item_value>> of the values of a field. pairs: key=value or key "value" pieces, else a plain list."""
    bare = read_field(text)
    has_quote = F.instr(bare, '"') > 0
    mask, spans = masked(bare)
    mask = F.when(has_quote, mask).otherwise(F.replace(bare, F.lit(MARK), F.lit(f"{MARK}c{MARK}")))
    split = F.split(mask, PAIR_SEPARATORS if pairs else LIST_SEPARATORS, -1)
    kept = F.filter(F.transform(split, trimmed), lambda p: p != "")

    def keyed(p: Column) -> Column:
        equals = F.instr(p, "=")
        spaced = r"\A(\S+)\s+(" + MARK + r"[0-9]+" + MARK + r")\z"
        is_spaced = p.rlike(spaced)
        key = F.when(equals > 0, F.substring_index(p, "=", 1)).when(is_spaced, F.regexp_extract(p, spaced, 1)).otherwise(p)
        value = F.when(equals > 0, p.substr(equals + 1, F.length(p))).when(is_spaced, F.regexp_extract(p, spaced, 2)).otherwise(F.lit(""))
        return F.struct(restored(trimmed(key), spans, False).alias("item_key"), restored(trimmed(value), spans, True).alias("item_value"))

    if pairs:
        return F.transform(kept, keyed)
    return F.transform(kept, lambda p: F.struct(F.lit("").alias("item_key"), restored(p, spans, True).alias("item_value")))


def unpack(df: DataFrame, record_id: Column, text: Column, pairs: bool, field_name: str, at_least: int = 1) -> DataFrame:
    """(field_name, record_id, item_no, item_key, item_value) of every field with at least so many values.

    Repeated deliveries of a record (same id, same field) count once: they meet in a hash aggregate over (id, field),
    which has a map-side half. Fields without any separator are left out before that shuffle if at_least > 1.
    """
    rows = df.select(record_id.cast("bigint").alias("record_id"), text.alias("packed")).where(F.col("packed").isNotNull())
    if at_least > 1:
        rows = rows.where(F.col("packed").rlike(r"[,;|]" if pairs else r"[,;/|\s]"))
    items = rows.distinct().select("record_id", pieces(F.col("packed"), pairs).alias("items")).where(F.size("items") >= at_least)
    return items.select("record_id", F.posexplode("items").alias("at", "item")).select(
        F.lit(field_name).alias("field_name"), "record_id", (F.col("at") + 1).cast("int").alias("item_no"), F.col("item.item_key").alias("item_key"), F.col("item.item_value").alias("item_value")
    )
