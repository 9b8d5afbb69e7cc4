"""Exact decimals: amounts are decimal(20,6) and never meet another currency, as every grouping holds the currency."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, DecimalType, IntegerType, ShortType, TimestampType

MONEY = "decimal(20,6)"
DECIMAL_TEXT = re.compile(r"^-?\d{1,14}(\.\d{1,6})?$")
EXACT = Context(prec=40, rounding=ROUND_HALF_EVEN)


def money(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def total(column: Column) -> Column:
    """Sum as an amount; 0 for no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY)


def share(part: Column, base: Column, digits: int = 6) -> Column:
    """part / base in percent, half up; null for a base of 0."""
    return F.round(money(part) / F.when(money(base) != 0, money(base)) * 100, digits).cast(MONEY)


def decimal_text(text: str) -> str:
    """A canonical decimal: at most 14 digits before and 6 behind the point, no trailing zeros."""
    if not DECIMAL_TEXT.match(text):
        raise ValueError(f"not an amount: {text}")
    whole, _, part = text.partition(".")
    sign, digits = ("-", whole[1:]) if whole.startswith("-") else ("", whole)
    digits, part = digits.lstrip("0") or "0", part.rstrip("0")
    plain = digits + ("." + part if part else "")
    return plain if plain == "0" else sign + plain


def currency_code(text: str) -> str:
    if not re.fullmatch(r"[A-Z]{3}", text):
        raise ValueError(f"not a currency: {text}")
    return text


class Money:
    """One amount on the driver; arithmetic across currencies raises."""

    def __init__(self, amount: str | Decimal, currency: str):
        self.amount, self.currency = EXACT.create_decimal(decimal_text(str(amount)) if isinstance(amount, str) else amount), currency_code(currency)

    def _other(self, other: Money) -> Decimal:
        if other.currency != self.currency:
            raise ValueError(f"{self.currency} meets {other.currency}")
        return other.amount

    def __add__(self, other: Money) -> Money:
        return Money(EXACT.add(self.amount, self._other(other)), self.currency)

    def __sub__(self, other: Money) -> Money:
        return Money(EXACT.subtract(self.amount, self._other(other)), self.currency)

    def __neg__(self) -> Money:
        return Money(-self.amount, self.currency)

    def __abs__(self) -> Money:
        return Money(abs(self.amount), self.currency)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Money) and (self.currency, self.amount) == (other.currency, other.amount)

    def __lt__(self, other: Money) -> bool:
        return self.amount < self._other(other)

    def __hash__(self) -> int:
        return hash((self.currency, self.amount))

    def __repr__(self) -> str:
        return f"{self.amount} {self.currency}"


def plain(df: DataFrame) -> DataFrame:
    """A result as it leaves the engine: amounts, dates and instants as text, whole numbers as bigint."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DecimalType, DateType, TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
