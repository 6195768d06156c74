"""Code words as column expressions: the operation, its count and what else a word holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import bits, div

#: Fixed values of the format: op codes, and the largest counts of a word.
CODES = {"SKIP": 0, "DUP": 1, "COPY": 2, "DONE": 3}
MAX_16, MAX_14, MAX_22 = 0xFFFF, 0x3FFF, 0x3FFFFF


def code(op: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, value in CODES.items():
        out = F.when(op == name, F.lit(value).cast("long")).otherwise(out)
    return out


def generic16(op: Column, num: Column, value: Column) -> Column:
    """The word of the first pass: 2 bits of operation, 14 of value, 16 of count."""
    return (code(op) * (1 << 30) + value * (1 << 16) + num).cast("long")


def parts_of_generic16(word: Column) -> list[Column]:
    return [bits(word, 30, 3).alias("op"), bits(word, 0, MAX_16).alias("num"), bits(word, 16, MAX_14).alias("value")]


def c4_16(op: Column, num: Column, px: Column) -> Column:
    """A word for 16 bits: 14 bits of count and a pixel; a SKIP's count has 30 bits."""
    return F.when(op == "SKIP", num).otherwise(code(op) * (1 << 30) + num * (1 << 16) + px).cast("long")


def c4_32(op: Column, num: Column, skip_after: Column) -> Column:
    """A word for 24 and 32 bits: 22 bits of count, the operation, and 8 of the skip that follows."""
    return (num * 1024 + code(op) * 256 + skip_after).cast("long")


def split_runs(runs: DataFrame, most: int) -> DataFrame:
    """runs (op, start_idx, num and others) cut to counts of at most `most`, with `part` from 0. A DUP never leaves a
    rest of one: the count before it is one less."""
    many = div(F.col("num") + most - 1, most)
    short = (F.col("op") == "DUP") & (F.pmod("num", F.lit(most)) == 1) & (F.col("num") > 1)
    rows = runs.select("*", many.alias("_many"), short.alias("_short"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(many, F.lit(1)) - 1)).alias("part"))
    before = F.col("part") * most - F.when(F.col("_short") & (F.col("part") == F.col("_many") - 1), 1).otherwise(0)
    after = F.least((F.col("part") + 1) * most, F.col("num")) - F.when(F.col("_short") & (F.col("part") == F.col("_many") - 2), 1).otherwise(0)
    others = [c for c in runs.columns if c not in ("start_idx", "num")]
    return rows.select(*others, "part", (F.col("start_idx") + before).alias("start_idx"), (after - before).alias("num"))
