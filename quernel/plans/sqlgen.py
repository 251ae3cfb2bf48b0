"""A query as SQL text."""

from __future__ import annotations

from quernel.plans.ir import ColRef, Query

#: Identifier quote by dialect.
QUOTES = {"ansi": '"', "spark": "`"}


def to_sql(query: Query, dialect: str = "ansi", result: bool = False) -> str:
    """`SELECT SUM(..) FROM r<id> "<binding>", .. WHERE ..`, without WHERE if there's no condition.

    result: name the sums s0, s1, .. and turn a zero into NULL, as results print it.
    """
    q = QUOTES[dialect]

    def col(c: ColRef) -> str:
        return f"{q}{c.binding}{q}.c{c.col}"

    sums = [f"SUM({col(c)})" for c in query.sums]
    if result:  # as decimals, which no sum of 64-bit values is too large for
        sums = [f"CAST(NULLIF(SUM(CAST({col(c)} AS DECIMAL(38,0))), 0) AS DECIMAL(38,0)) AS s{i}" for i, c in enumerate(query.sums)]
    tables = [f"r{rel} {q}{i}{q}" for i, rel in enumerate(query.relations)]
    conditions = [f"{col(p.left)} = {col(p.right)}" for p in query.predicates]
    conditions += [f"{col(f.column)} {f.op} {f.value}" for f in query.filters]
    where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
    return f"SELECT {', '.join(sums)} FROM {', '.join(tables)}{where}"
