"""Column helpers: rounding, encodings and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the transaction types.
TYPE_CODES = {"PAYMENT": 4.0, "TRANSFER": 5.0, "DEBIT": 3.0, "CASH_IN": 1.0, "CASH_OUT": 2.0}


def round3(x: Column) -> Column:
    """To three decimals, halves up, by floor: equal bits in any engine."""
    return F.floor(x * 1000 + 0.5).cast("double") / 1000


def type_code(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, code in TYPE_CODES.items():
        out = F.when(kind == name, F.lit(code)).otherwise(out)
    return out


def party_number(name: Column) -> Column:
    """The number after the letter of a party's id."""
    return F.substring(name, 2, 1 << 30).cast("double")


def mismatch(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0.0)).otherwise(F.lit(1.0))
