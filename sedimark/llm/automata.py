"""Words of a text as the automaton operators see them, and boundary-guarded automata that a worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.llm.common import KEPT

#: Fixed by the contract: a word is a maximal run of digits, letters A-Z and a-z, and characters above 0x7F; only A-Z are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same rule on UTF-8 bytes: letters become lower-case, whatever is in no word becomes a space.
SPACED = bytes(c + 32 if chr(c) in UPPER else c if c > 127 or chr(c).isdigit() or chr(c) in LOWER else 32 for c in range(256))


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def guarded(patterns: Iterable[str]) -> list[str]:
    """Words or runs of words as an automaton finds them in spaced text: one space on either side, UTF-8 bytes as characters."""
    return [f" {p.encode().decode('latin-1')} " for p in patterns]


_held: dict[str, object] = {}
KEPT["automata"] = _held.clear


def automaton(token: str, patterns: list[str]):
    """The automaton of guarded patterns (a match says the pattern's place in the list); built once in a worker, which keeps one."""
    if token not in _held:
        import ahocorasick

        _held.clear()
        built = ahocorasick.Automaton()
        for i, p in enumerate(patterns or ["\0"]):  # no spaced text holds a zero
            built.add_word(p, i)
        built.make_automaton()
        _held[token] = built
    return _held[token]
