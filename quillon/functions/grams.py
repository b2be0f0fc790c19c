"""Trigrams that a pattern requires: a condition that every name with a match meets, for look-ups before the pattern itself is tried.

Names are folded for trigrams so that what a case-insensitive pattern takes for an ASCII letter is that letter. The condition is a tree of
``("and", parts)``, ``("or", parts)`` and trigrams; ``None`` requires nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillon.functions.text import LOWER, UPPER

#: Letters that a Unicode case-insensitive pattern takes for k, s and i.
ALIKE = ("Kſİı", "ksii")
_FOLD = str.maketrans(UPPER + ALIKE[0], LOWER + ALIKE[1])

try:
    from re import _constants as _c, _parser
except ImportError:  # another Python: every pattern requires nothing
    _parser = None

Condition = str | tuple[str, list] | None


def folded(name: Column) -> Column:
    return F.translate(name, UPPER + ALIKE[0], LOWER + ALIKE[1])


def of_column(name: Column) -> Column:
    """array<string>: the distinct trigrams of a folded name."""
    n = F.char_length(name) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def of_literal(text: str) -> Condition:
    """All trigrams of each run of printable ASCII."""
    found = [run[i : i + 3] for run in re.findall(r"[ -~]+", text.translate(_FOLD)) for i in range(len(run) - 2)]
    return _all([*dict.fromkeys(found)])


def _all(parts: list[Condition]) -> Condition:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list[Condition]) -> Condition:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def of_pattern(pattern: str) -> Condition:
    """What a Java regular expression requires. Patterns that Python reads otherwise, or not at all, require nothing."""
    if _parser is None or _unlike(pattern):
        return None
    try:
        return _sequence(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None


def _unlike(pattern: str) -> bool:
    r"""Whether Java may read it otherwise: sets in sets, ``&&``, octal and control escapes, ``\v``, ``\Q``, inline flags but i, s and m."""
    return bool(re.search(r"\[[^\]]*\[|&&|\\[0-9cvQEGNpPXRhHKk]|\(\?[a-zA-Z]*[^imsa-zA-Z:=!<>()|?*+#-]|\(\?[a-zA-Z-]*[xudULa]", pattern)) or "\\]" in pattern or "[]" in pattern or "[^]" in pattern


def _sequence(items) -> Condition:
    parts: list[Condition] = []
    run: list[str] = []

    def flush() -> None:
        parts.append(of_literal("".join(run)))
        run.clear()

    def walk(items) -> None:
        for op, value in items:
            if op is _c.LITERAL:
                run.append(chr(value))
            elif op is _c.SUBPATTERN:
                walk(value[-1])  # a group's letters join those beside it
            elif op is _c.BRANCH:
                flush()
                parts.append(_any([_sequence(b) for b in value[1]]))
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
                flush()
                if value[0] >= 1:
                    parts.append(_sequence(value[2]))
            elif op is _c.ATOMIC_GROUP:
                flush()
                parts.append(_sequence(value))
            else:  # sets, places, looks around: something or nothing stands here
                flush()

    walk(items)
    flush()
    return _all(parts)


def members(condition: Condition) -> list[str]:
    """The distinct trigrams of a condition."""
    if condition is None:
        return []
    if isinstance(condition, str):
        return [condition]
    return [*dict.fromkeys(g for p in condition[1] for g in members(p))]


def met(condition: Condition, have: Column) -> Column:
    """Whether the trigrams ``have`` (array<string>) meet the condition."""
    if isinstance(condition, str):
        return F.array_contains(have, condition)
    parts = [met(p, have) for p in condition[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if condition[0] == "and" else (out | p)
    return out
