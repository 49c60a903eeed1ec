"""Regular expressions whose blank, word-boundary and case rules do not depend on the JVM version."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point the audited pages' own scripting language counts as blank. The far ones stand behind
# one range: a letter is told from them by two tests, not by one for each of them.
_FAR = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BLANKS = rf"\t\n\x0B\f\r \x{{00a0}}[\x{{1680}}-\x{{feff}}&&[{_FAR}]]"
OTHER_BLANKS = BLANKS.replace(" ", "")  # all but the plain one
BLANK = f"[{BLANKS}]"
NON_BLANK_RUN = f"[^{BLANKS}]+"
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"  # an edge whose one side is known to be a word character


def _word_follows(rest: str) -> bool:
    """What comes next in the pattern can only match a word character."""
    if rest.startswith("("):
        body = rest[3:] if rest.startswith("(?:") else rest[1:]
        if body.startswith("?") or "\\|" in body:
            return False
        depth, start, starts = 0, 0, []
        for i, char in enumerate(body):
            if char in "([":
                depth += 1
            elif char in ")]" and depth:
                depth -= 1
            elif depth == 0 and char in "|)":
                starts.append(body[start:])
                start = i + 1
                if char == ")":
                    after = body[i + 1 : i + 2]
                    return after not in ("?", "*", "{") and all(_word_follows(s) for s in starts)
        return False
    if rest.startswith(r"\d"):
        return rest[2:3] not in ("?", "*")
    if rest.startswith(("[A-Z]", "[a-z]", "[0-9]")):
        return rest[5:6] not in ("?", "*")
    return bool(rest) and rest[0].isascii() and rest[0].isalnum() and rest[1:2] not in ("?", "*", "{")


def _word_precedes(done: str) -> bool:
    """The last thing in the pattern so far is a letter, digit, ``[a-z]+``, ``\\d{n}``, or a group of such ends."""
    if done.endswith(")") and not done.endswith("\\)"):
        depth, end, ends = 0, len(done) - 1, []
        for i in range(len(done) - 1, -1, -1):
            if done[i - 1 : i] == "\\":
                continue
            depth += (done[i] in ")]") - (done[i] in "([")
            if done[i] in "|(" and depth == (done[i] == "|"):
                ends.append(done[:end])
                end = i
                if done[i] == "(":
                    return all(_word_precedes(e) for e in ends)
        return False
    if done.endswith(("[a-z]+", r"\d+", r"\d{4}")):
        return True
    return done[-1:].isascii() and done[-1:].isalnum() and done[-2:-1] != "\\"


@lru_cache(maxsize=None)
def rx(pattern: str, flags: str = "") -> str:
    """Java form of ``pattern``: Unicode ``\\s``, ASCII ``\\b``, inline flags."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(BLANKS if in_class else BLANK)
            i += 2
        elif pair == r"\b" and not in_class:
            out.append(_BEFORE if _word_follows(pattern[i + 2 :]) else _AFTER if _word_precedes(pattern[:i]) else _EDGE)
            i += 2
        elif pair.startswith("\\"):
            out.append(pair)
            i += 2
        else:
            char = pattern[i]
            if in_class and char == "[":
                out.append("\\")
            in_class = (char == "[") or (in_class and char != "]")
            out.append(char)
            i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def test(value: Column, pattern: str, flags: str = "i") -> Column:
    """True where the pattern occurs; NULL text counts as empty."""
    return F.coalesce(value, F.lit("")).rlike(rx(pattern, flags))


def count(value: Column, pattern: str, flags: str = "i") -> Column:
    return F.coalesce(F.regexp_count(value, F.lit(rx(pattern, flags))), F.lit(0))


def find(value: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """Text of one group of the first match, ``''`` when there is none."""
    return F.coalesce(F.regexp_extract(value, rx(pattern, flags), group), F.lit(""))


def find_all(value: Column, pattern: str, group: int = 0, flags: str = "i") -> Column:
    return F.coalesce(
        F.regexp_extract_all(value, F.lit(rx(pattern, flags)), F.lit(group)),
        F.array().cast("array<string>"),
    )
