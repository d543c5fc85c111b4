"""String rules of the outputs: sequence ids, file names, gap padding, abbreviated labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF_NAME = "REF"


def padded(text: Column, width: Column) -> Column:
    """Right-padded with gaps to the aligned width."""
    return F.concat(text, F.repeat(F.lit("-"), (width - F.length(text)).cast("int")))


def abbreviated(label: Column, limit: int = 20, edge: int = 10) -> Column:
    """Labels over ``limit`` characters as first and last ten around an ellipsis, with the length."""
    n = F.length(label)
    return F.when(n > limit, F.concat(F.substring(label, 1, edge), F.lit("…"), F.expr(f"right(label, {edge})"), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(label)


def sequence_id(name: Column, chromosome: Column | None = None) -> Column:
    """FASTA id of a sequence: [chromosome TAB] name."""
    return name if chromosome is None else F.concat_ws("\t", chromosome, name)


def haplotype_name(sample: Column, copy_in_sample: Column) -> Column:
    """sample-copy, copies counted from 1."""
    return F.concat_ws("-", sample, (copy_in_sample + 1).cast("string"))


def founder_name(number: Column) -> Column:
    return (number + 1).cast("string")


def file_name(parts: list[str], *, chromosome: str | None, a2m: bool, aligned: bool) -> str:
    """[chromosome.]NAME[.extension]: .a2m for aligned A2M, .fa for unaligned, none for plain."""
    stem = ".".join(([chromosome] if chromosome else []) + parts)
    return stem + ((".a2m" if aligned else ".fa") if a2m else "")
