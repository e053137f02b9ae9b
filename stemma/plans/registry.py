"""All registered queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from stemma.plans import general, library

FLAGSHIP = "mine_words"
QUERIES = {**library.QUERIES, **general.QUERIES}
SQL = {**library.SQL, **general.SQL}
