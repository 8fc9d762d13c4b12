"""Column expressions for untidy strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, and the four information separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: str | Column) -> Column:
    """Without white space around it; null stays null."""
    return F.btrim(_col(c), F.lit(WHITE))


def tidy_id(c: str | Column) -> Column:
    """Tidy and in upper case, blank as null: the form in which ids are compared."""
    t = F.upper(tidy(c))
    return F.when(t != "", t)
