"""`python -m quernel.to_sql [--rewritten]`: text queries in, SQL out, one a line; batch ends become blank lines."""

import sys
from collections.abc import Iterable, Iterator

from quernel.plans.rewrite import rewrite
from quernel.plans.sqlgen import to_sql
from quernel.plans.textql import parse


def translate(lines: Iterable[str], rewritten: bool = False) -> Iterator[str]:
    for line in lines:
        text = line.strip()
        if text in ("", "F"):
            yield ""
        else:
            query = parse(text)
            yield to_sql(rewrite(query) if rewritten else query) + ";"


if __name__ == "__main__":
    for out in translate(sys.stdin, "--rewritten" in sys.argv[1:]):
        print(out)
