"""Which plain texts a pattern needs: a cheap test before a regular expression is run.

For a pattern, a set of texts of which every match contains at least one. Looking for texts costs a
fraction of running a pattern that begins with an alternative, and most rows fail all of them.
"""

from __future__ import annotations

import functools
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: More texts than this would cost more than they save.
MOST, SHORTEST = 40, 1


def _best(sets: list[frozenset[str] | None]) -> frozenset[str] | None:
    """Of several sets that all must be met the one that is met least: the longest texts, then the fewest."""
    known = [s for s in sets if s]
    return max(known, key=lambda s: (min(map(len, s)), -len(s))) if known else None


def _needed(tree: list) -> frozenset[str] | None:
    sets: list[frozenset[str] | None] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            sets.append(frozenset([run]))
        run = ""

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name == "AT":  # a boundary takes no text
            continue
        flush()
        if name == "SUBPATTERN":
            sets.append(_needed(list(arg[3])))
        elif name == "BRANCH":
            parts = [_needed(list(x)) for x in arg[1]]
            sets.append(None if any(p is None for p in parts) else frozenset().union(*parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            sets.append(_needed(list(arg[2])))
    flush()
    return _best(sets)


@functools.cache
def needed(pattern: str) -> tuple[str, ...] | None:
    """Texts of which every match of the pattern contains one; None if there is no short list of them.

    Patterns with flags, look-arounds or back-references have none.
    """
    if "(?i" in pattern or "(?=" in pattern or "(?!" in pattern or "(?<" in pattern:
        return None
    texts = _needed(list(_parser.parse(pattern)))
    if not texts or len(texts) > MOST or min(map(len, texts)) < SHORTEST:
        return None
    # A text that contains another one adds nothing.
    return tuple(sorted(t for t in texts if not any(o != t and o in t for o in texts)))


def matches(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), run only where the text contains what the pattern needs."""
    texts = needed(pattern)
    if texts is None:
        return text.rlike(pattern)
    some = F.contains(text, F.lit(texts[0]))
    for t in texts[1:]:
        some |= F.contains(text, F.lit(t))
    return some & text.rlike(pattern)
