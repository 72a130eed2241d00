"""Text rules for peaks, barcodes, factors and marker genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_PATTERN = r"^(chr[^:\-]+)[:\-](\d+)-(\d+)$"

# The chromosomes kept by the standard filter.
STANDARD_CHROMOSOMES = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY", "chrM"]


def chromosome_of(name: Column) -> Column:
    """Text before the first ``:`` or ``-`` of a name that starts with chr, else empty."""
    return F.regexp_extract(name, r"^(chr[^:\-]+)", 1)


def is_standard_chromosome(name: Column) -> Column:
    return chromosome_of(name).isin(STANDARD_CHROMOSOMES)


def has_chromosome_prefix(name: Column, prefix: str, excluded: Sequence[str] = ()) -> Column:
    keep = name.startswith(prefix)
    for text in excluded:
        keep = keep & ~name.contains(text)
    return keep


def parse_peak(name: Column) -> Column:
    """Struct (chr, start, end, valid) from ``chr:start-end`` or ``chr-start-end``."""
    chrom = F.regexp_extract(name, PEAK_PATTERN, 1)
    start = F.regexp_extract(name, PEAK_PATTERN, 2).try_cast("bigint")
    end = F.regexp_extract(name, PEAK_PATTERN, 3).try_cast("bigint")
    valid = (chrom != "") & F.coalesce((start >= 0) & (start < end), F.lit(False))
    return F.struct(
        F.nullif(chrom, F.lit("")).alias("chr"),
        start.alias("start"),
        end.alias("end"),
        valid.alias("valid"),
    )


def format_peak(chrom: Column, start: Column, end: Column, sep: str = ":") -> Column:
    return F.concat(chrom, F.lit(sep), start.cast("string"), F.lit("-"), end.cast("string"))


def colon_peak(name: Column) -> Column:
    """Rewrite ``chr-start-end`` as ``chr:start-end``; other text is unchanged."""
    return F.regexp_replace(name, r"^([^:\-]+)-(\d+-\d+)$", "$1:$2")


def factor_name(name: Column) -> Column:
    """Drop a trailing ``(var.N)`` and fold to upper case."""
    return F.upper(F.regexp_replace(name, r"\(var\.\d+\)$", ""))


def quoted_name(text: Column) -> Column:
    """First double-quoted part, or the text itself."""
    found = F.regexp_extract(text, r'"([^"]+)"', 1)
    return F.when(found == "", text).otherwise(found)


MARKER_PATTERN = r"^\s*(.*?)\s*\(\s*([^)]*?)\s*\)\s*$"


def marker_main(gene: Column) -> Column:
    """Name before a bracketed alias, upper case."""
    main = F.regexp_extract(gene, MARKER_PATTERN, 1)
    return F.upper(F.trim(F.when(main == "", gene).otherwise(main)))


def marker_alias(gene: Column) -> Column:
    """Bracketed alias, upper case; NULL when there is none."""
    return F.nullif(F.upper(F.trim(F.regexp_extract(gene, MARKER_PATTERN, 2))), F.lit(""))


def gene_tokens(text: Column, pattern: str = ",") -> Column:
    """Trimmed, upper-case, non-empty parts of a gene list."""
    parts = F.transform(F.split(text, pattern), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def tissue_key(text: Column) -> Column:
    """First letter upper, the rest lower (only the first word is capitalised)."""
    t = F.trim(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))


def without_barcode_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"-1$", "")


def with_barcode_suffix(name: Column) -> Column:
    return F.when(name.endswith("-1"), name).otherwise(F.concat(name, F.lit("-1")))


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any of the patterns."""
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def safe_divide(num: Column, den: Column, fill: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(fill))
