"""Quantities recorded in different units, brought to one unit."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units

RESULT = "number double, unit_scale double, canonical double, result bigint, default_unit boolean, unit_from string, status string"


def _unit(unit: str | None, said: tuple, note: str | None, default: units.Unit) -> tuple[units.Unit | None, str]:
    """(unit, where it was found); None if one is written that can't be read."""
    u, unread = units.read_unit(unit)
    if u is not None or unread:
        return u, "column"
    if said[1] is not None or said[2]:
        return said[1], "text"
    u = units.find_unit(note)
    return (default, "default") if u is None else (u, "note")


def _scaled(n: Decimal, scale: Fraction) -> int:
    """n * scale, rounded half up, in whole numbers."""
    sign, digits, exponent = n.as_tuple()
    top, low = int("".join(map(str, digits)) or 0) * scale.numerator, scale.denominator
    top, low = (top * 10**exponent, low) if exponent >= 0 else (top, low * 10**-exponent)
    whole = (2 * top + low) // (2 * low)
    return -whole if sign else whole


def to_common_unit(df: DataFrame, number: F.Column, unit: F.Column, text: F.Column, note: F.Column, default: str, target: str) -> DataFrame:
    """df with a struct column `q`: the quantity in multiples of the target unit.

    The number comes from the number column, else from the text. The unit comes from the unit column,
    else from the text behind the number, else from the note, else it is the default. q.result is
    rounded half up from exact fractions. q.status is ok, or says why there is no result: no number,
    unreadable (a number or unit is written that the grammar does not know), out of range (over 63 bits).
    q.default_unit tells whether the unit is the default one, however it is spelled. Nulls, NaN and
    empty values count as absent.
    """
    base, goal = units.find_unit(default), units.find_unit(target).scale

    def run(number: pd.Series, unit: pd.Series, text: pd.Series, note: pd.Series) -> pd.DataFrame:
        rows = []
        found: dict[tuple, tuple] = {}
        for n, u, t, m in zip(number.tolist(), unit, text, note):
            u, t, m = (v if isinstance(v, str) else None for v in (u, t, m))
            given = n is not None and n - n == 0
            said = units.read_quantity(t)
            key = (u, said[1:], m)
            if key not in found:
                of, source = _unit(u, said, m, base)
                found[key] = (of, source, None if of is None else of.scale / goal, None if of is None else float(of.scale))
            of, source, scale, size = found[key]
            value = Decimal(repr(n)) if given else said[0]
            if of is None or (value is None and said[2]):
                rows.append((n if given else None, size, None, None, None, source, "unreadable"))
            elif value is None:
                rows.append((None, size, None, None, of == base, source, "no number"))
            else:
                result = _scaled(value, scale) if abs(value.adjusted()) < 400 else 0 if value.adjusted() < 0 else 2**63
                fits = abs(result) < 2**63
                rows.append((float(value), size, float(value) * size, result if fits else None, of == base, source, "ok" if fits else "out of range"))
        out = pd.DataFrame(rows, columns=["number", "unit_scale", "canonical", "result", "default_unit", "unit_from", "status"])
        return out.astype({"number": "float64", "unit_scale": "float64", "canonical": "float64", "result": "Int64", "default_unit": "boolean", "unit_from": "object", "status": "object"})

    q = F.pandas_udf(run, RESULT)
    return df.withColumn("q", q(number.cast("double"), unit.cast("string"), text.cast("string"), note.cast("string")))
