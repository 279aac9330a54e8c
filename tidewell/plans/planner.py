"""Questions to intents and to SQL, without a language model; any object with these methods may stand in."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a question; substrings, looked for in this order.
LINEAGE_TERMS = ("lineage", "where does", "contribute", "come from")
ANALYSIS_TERMS = ("top", "most", "how many", "average", "total", "revenue")


class Planner(Protocol):
    def intent(self, question: str) -> str: ...

    def sql(self, question: str) -> str: ...

    def answer(self, question: str, columns: list[str], rows: list[tuple]) -> str: ...


def intent_column(question: Column) -> Column:
    q = F.lower(question)
    has = lambda terms: F.greatest(*[F.contains(q, F.lit(t)).cast("int") for t in terms]) == 1
    return F.when(has(LINEAGE_TERMS), "lineage").when(has(ANALYSIS_TERMS), "analysis").otherwise("discovery")


def bounds_columns(question: Column, default_year: int = 2001, default_n: int = 10, most: int = 100) -> tuple[Column, Column]:
    """The year and the number of rows that a question names, as ``TemplatePlanner.bounds`` finds them."""
    year = F.regexp_extract(question, r"\b(19\d\d|20\d\d)\b", 1)
    n = F.regexp_extract(F.lower(question), r"\btop\s+(\d+)\b", 1)
    asked = F.when(n == "", F.lit(default_n)).when(F.length(n) > 9, F.lit(most)).otherwise(n.try_cast("int"))
    return F.coalesce(year.try_cast("int"), F.lit(default_year)), F.least(asked, F.lit(most))


class TemplatePlanner:
    """Keyword rules and one SQL template: the customers of most revenue in a year."""

    def __init__(self, default_year: int = 2001, default_n: int = 10, most: int = 100):
        self.default_year, self.default_n, self.most = default_year, default_n, most

    def intent(self, question: str) -> str:
        q = question.lower()
        for name, terms in (("lineage", LINEAGE_TERMS), ("analysis", ANALYSIS_TERMS)):
            if any(t in q for t in terms):
                return name
        return "discovery"

    def bounds(self, question: str) -> tuple[int, int]:
        year = re.search(r"\b(19\d\d|20\d\d)\b", question)
        n = re.search(r"\btop\s+(\d+)\b", question.lower())
        return int(year[1]) if year else self.default_year, min(int(n[1]) if n else self.default_n, self.most)

    def sql(self, question: str) -> str:
        year, n = self.bounds(question)
        return (
            "SELECT c.c_customer_id, c.c_first_name, c.c_last_name, r.total_net_paid FROM analytics.customer_revenue_yearly AS r "
            f"JOIN raw.customer AS c ON r.customer_sk = c.c_customer_sk WHERE r.calendar_year = {year} ORDER BY r.total_net_paid DESC NULLS LAST, c.c_customer_sk LIMIT {n}"
        )

    def answer(self, question: str, columns: list[str], rows: list[tuple]) -> str:
        if not rows:
            return "The query returned no rows for this question."
        told = "; ".join(f"{first} {last} ({number}): {amount}" for number, first, last, amount in rows)
        return f"The query returned {len(rows)} row(s): {told}."
