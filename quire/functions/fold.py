"""Search folding: first character of the canonical decomposition, then ASCII lower case."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_char(ch: str) -> str:
    first = unicodedata.normalize("NFD", ch)[0]
    return first.lower() if "A" <= first <= "Z" else first


def fold_text(text: str) -> str:
    """The same fold on a Python string, for literals."""
    return "".join(map(fold_char, text))


class Folds(dict):
    """For str.translate(): the fold of each character that is met."""

    def __missing__(self, code: int) -> str:
        self[code] = found = fold_char(chr(code))
        return found


@functools.cache
def translation() -> tuple[str, str]:
    """All characters that the fold changes, and what they become."""
    changed = [(c, f) for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (f := fold_char(c)) != c]
    return "".join(c for c, _ in changed), "".join(f for _, f in changed)


def fold(column: Column) -> Column:
    """Fold a string column inside the JVM, one output character per input character."""
    source, target = translation()
    return F.translate(column, source, target)
