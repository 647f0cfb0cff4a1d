"""Scalar expressions that path columns use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a slug writes in plain form.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def slug(text: Column, separator: str = "-") -> Column:
    """Lower case, plain letters, everything else one separator, none at the ends."""
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    plain = F.replace(F.replace(plain, F.lit("ß"), F.lit("ss")), F.lit("@"), F.lit(f"{separator}at{separator}"))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", separator), F.lit(separator))


def rewrite_prefix(path: Column, old: Column, new: Column) -> Column:
    """``path`` with the prefix ``old`` replaced; lengths count characters."""
    return F.when(F.startswith(path, old), F.concat(new, F.substr(path, F.char_length(old) + 1))).otherwise(path)
