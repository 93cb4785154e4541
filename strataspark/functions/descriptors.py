"""Text descriptors of disk images as columns: keys and values, extent lines, XML elements, segment names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An extent line: access, sectors, kind, quoted name and, where given, an offset.
EXTENT_LINE = r'(?m)^\s*(RW|RDONLY|NOACCESS)\s+(\d+)\s+(\w+)(?:\s+"([^"]*)")?(?:\s+(\d+))?\s*$'
PAIR_LINE = r'(?m)^\s*([A-Za-z][\w.]*)\s*=\s*"?([^"\r\n]*?)"?\s*$'


def pairs(text: Column) -> Column:
    """The key = value lines as a map with keys in lower case; the first of equal keys counts."""
    keys, values = F.regexp_extract_all(text, F.lit(PAIR_LINE), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR_LINE), F.lit(2))
    lowered = F.transform(keys, F.lower)
    entries = F.transform(lowered, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(lowered, e["key"]) == i + 1))


def extent_lines(descriptors: DataFrame, key: str, text: str, sector: int = 512) -> DataFrame:
    """(key, ordinal, access, length, kind, name, file_offset, logical_offset): the guest offset is the sum of the lengths before."""
    part = lambda i: F.regexp_extract_all(text, F.lit(EXTENT_LINE), F.lit(i))
    lines = descriptors.select(key, F.posexplode(F.arrays_zip(*(part(i).alias(n) for i, n in enumerate(("access", "sectors", "kind", "name", "at"), 1)))).alias("ordinal", "e"), part(2).alias("all"))
    before = F.aggregate(F.slice("all", F.lit(1), F.col("ordinal")), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    number = lambda c: F.when(c != "", c.cast("long"))
    return lines.select(
        key, "ordinal", F.col("e.access").alias("access"), (F.col("e.sectors").cast("long") * sector).alias("length"), F.col("e.kind").alias("kind"),
        F.nullif(F.col("e.name"), F.lit("")).alias("name"), (number(F.col("e.at")) * sector).alias("file_offset"), (before * sector).alias("logical_offset"),
    )


def element_text(xml: Column, path: str) -> Column:
    """The text of the first element at an XPath; empty if there is none."""
    return F.xpath_string(xml, F.lit(f"{path}[1]"))


def plist_value(xml: Column, key: str) -> Column:
    """The text of the element that follows a property list's key."""
    return F.xpath_string(xml, F.lit(f"//key[text()='{key}']/following-sibling::*[1]"))


def segment_ordinal(name: Column) -> Column:
    """The number of a segment from its name, or null: ``x.001`` counts from 0 or 1, ``x.aa`` in base 26, ``x2of5`` from 1."""
    digits, letters = F.regexp_extract(name, r"\.(\d{2,})$", 1), F.lower(F.regexp_extract(name, r"\.([A-Za-z]{2,3})$", 1))
    x_of_n = F.regexp_extract(name, r"(?i)(\d+)of\d+(?:\.[^.]*)?$", 1)
    base26 = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda total, c: F.when(c == "", total).otherwise(total * 26 + F.ascii(c) - 97))
    return F.when(x_of_n != "", x_of_n.cast("long")).when(digits != "", digits.cast("long")).when(letters != "", base26)


def following_segment(name: Column) -> Column:
    """The next name of a numbered segment with the same width, null if the number would not fit."""
    digits = F.regexp_extract(name, r"\.(\d{2,})$", 1)
    following = F.lpad((digits.cast("long") + 1).cast("string"), 20, "0")
    fits = F.length((digits.cast("long") + 1).cast("string")) <= F.length(digits)
    stem = F.regexp_replace(name, r"\d+$", "")
    return F.when((digits != "") & fits, F.concat(stem, F.right(following, F.length(digits))))


def segment_name(stem: Column, ordinal: Column, width: int) -> Column:
    """The name of an alphabetic segment: base 26 digits from ``a``, null beyond the width."""
    letters = [F.chr(F.lit(97) + F.floor(ordinal / 26**k).cast("long") % 26) for k in range(width - 1, -1, -1)]
    return F.when((ordinal >= 0) & (ordinal < 26**width), F.concat(stem, *letters))


def first_and_next_segment(name: Column) -> Column:
    """The second segment's name if this is the name of a set's first, else null: ``x1of5``, digits at the end (0 or 1), or
    ``aa`` at the end of a name without a dot. The grammars are tried in that order."""
    of = F.regexp_extract(name, r"^(.*?)(\d+)of\d+", 2)
    total = F.regexp_extract(name, r"^.*?\d+of(\d+)", 1)
    stem = F.regexp_extract(name, r"^(.*?)\d+of\d+", 1)
    digits, before = F.regexp_extract(name, r"(\d+)$", 1), F.regexp_extract(name, r"^(.*\D)\d+$", 1)
    value = digits.cast("decimal(38,0)")
    number = F.lpad((value + 1).cast("string"), 38, "0")
    numeric = F.when(value <= 1, F.concat(before, F.right(number, F.greatest(F.length(digits), F.length((value + 1).cast("string"))))))
    letters = F.when(~name.contains(".") & name.endswith("aa"), F.concat(F.regexp_replace(name, "aa$", ""), F.lit("ab")))
    return F.when(of != "", F.when((of.cast("long") == 1) & (total.cast("long") >= 1), F.concat(stem, F.lit("2of"), total))).when((digits != "") & (before != ""), numeric).otherwise(letters)
