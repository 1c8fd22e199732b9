"""Column functions: text, URLs, dates, money, parties, transactions. They need spark.sql.session.timeZone=UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(col: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(col), with col computed once however often fn uses it.

    The value is bound to a lambda variable, so long expressions neither repeat their inputs nor
    outgrow what the code generator can compile. fn mustn't use Python functions.
    """
    return F.get(F.transform(F.array(col), fn), F.lit(0))
