"""Column helpers the operators of this package share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; null gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def once(value: Column) -> Column:
    """``value`` as the only element of an exploded array.

    Catalyst copies no expression across a generator, so a costly value that several
    later columns use is worked out once.
    """
    return F.explode(F.array(value))
