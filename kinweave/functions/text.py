"""Text as Column expressions: folding to ASCII, tokens. Names and addresses are normalised in fields.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import tables as t

INDIC, ZERO_WIDTH = t.INDIC, t.ZERO_WIDTH


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens_of(text: Column) -> Column:
    """Distinct tokens, in order of first appearance; none for the empty string."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda x: x != ""))


def romanize(text: Column) -> Column:
    """Brahmic letters by their place in their block, others unchanged. Vowels that consonants carry are not written."""
    slots = F.split(F.lit(",".join(t.INDIC_SLOTS)), ",")
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(INDIC), F.element_at(slots, (F.ascii(c) % 128 + 1).cast("int"))).otherwise(c)), "")


def fold(text: Column) -> Column:
    """ASCII, lower case; null is empty. Characters without a known spelling are dropped."""

    def spelled(x: Column) -> Column:
        plain = F.translate(x, t.ACCENTED, t.PLAIN)
        for c, letters in t.SPELLED_OUT:
            plain = F.replace(plain, F.lit(c), F.lit(letters))
        latin = lambda y: F.when(y.rlike(INDIC), romanize(y)).otherwise(y)
        return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(let(plain, latin), r"[^\x00-\x7F]", "")).otherwise(x)

    return F.lower(let(F.coalesce(text, F.lit("")), spelled))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")
