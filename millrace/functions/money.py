"""Amounts as whole minor units with a currency's exponent: sums are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits after the point where there are not two.
EXPONENTS = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "BHD": 3, "KWD": 3, "OMR": 3, "TND": 3}


def minor(amount: Column, currency: str) -> Column:
    """Major units, rounded half away from zero, as minor units."""
    return F.round(amount.cast("decimal(28,6)") * 10 ** EXPONENTS.get(currency, 2)).cast("long")


def major(units: Column, currency: str) -> Column:
    digits = EXPONENTS.get(currency, 2)
    return (units.cast("decimal(28,0)") / F.lit(10**digits)).cast(f"decimal(28,{digits})")


def shown(units: Column, currency: str) -> Column:
    return F.concat(F.lit(f"{currency} "), major(units, currency).cast("string"))
