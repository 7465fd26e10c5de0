"""Regular expressions of the rule language (a dialect without look-around and back-references) for Java and Python.

The dialect could be matched in linear time, but both engines backtrack: a pattern of nested repeats, such as (a+)+b,
can take a task very long on a text that almost matches. Patterns come from rules, so that is for their author to avoid.
"""

from __future__ import annotations

import re

#: How a sound pattern is told: escapes, classes, heads of groups and flags become plain letters in this order (and
#: what isn't in the dialect an open bracket), then groups do, from the inside out, DEPTH levels of them. What is left
#: must not be UNSOUND.
SOUND = (
    (r"\\\\", "e"),
    (r"\\[pPxuU]\{[^{}]*\}", "e"),
    (r"\\(?:[1-9k]|\z)", "("),
    (r"(?s)\\.", "e"),
    (r"\[\^?\]?(?:\[[^\[\]]*\]|[^\[\]])*\]", "c"),
    (r"\(\?(?:P?<[A-Za-z_][A-Za-z0-9_]*>|[imsxuU]*(?:-[imsxuU]+)?:)", "("),
    (r"\(\?[imsxuU]+(?:-[imsxuU]+)?\)", ""),
    (r"(?:\A|(?<=[(|]))(?:[*+?]|\{[0-9])", "("),
    (r"[*+?}]\+", "("),
)
GROUP = r"\((?!\?)[^()]*\)"
UNSOUND = r"[()\[]"
DEPTH = 12


def sound(pattern: str) -> bool:
    """Whether a pattern is one of the dialect, as far as its brackets, groups, repeats and escapes tell."""
    for find, put in SOUND:
        pattern = re.sub(find.replace(r"\z", r"\Z"), put, pattern)
    for _ in range(DEPTH):
        pattern = re.sub(GROUP, "g", pattern)
    return not re.search(UNSOUND, pattern)


class RegexError(ValueError):
    pass


def _outside(pattern: str, change) -> str:
    """``pattern`` with ``change`` applied to each character that is neither escaped nor in a class."""
    out, depth, k = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            depth += 1
            if pattern[k + 1 : k + 2] in ("]", "^") and depth == 1:
                extra = 2 if pattern[k + 1 : k + 3] == "^]" or pattern[k + 1] == "]" else 1
                out.append(pattern[k : k + 1 + extra].replace("]", "\\]"))
                k += 1 + extra
                continue
        elif c == "]" and depth:
            depth -= 1
        out.append(change(c) if not depth else c)
        k += 1
    return "".join(out)


def translate(pattern: str) -> str:
    """The Java pattern: Unicode classes, only \\n ends a line, $ only matches at the very end."""
    if not sound(pattern):
        raise RegexError(f"not supported: {pattern!r}")
    try:
        re.compile(to_python(pattern))
    except re.error as e:
        raise RegexError(f"{pattern!r}: {e}") from e
    multi = re.search(r"\(\?[a-z]*m", pattern)
    return "(?dU)" + (pattern if multi else _outside(pattern, lambda c: r"\z" if c == "$" else c))


def to_python(pattern: str) -> str:
    out = re.sub(r"(?<!\\)\\z", r"\\Z", pattern)
    out = re.sub(r"\\p\{[^}]*\}|\\P\{[^}]*\}|\\[pP]\w", r"\\w", out)
    return out if re.search(r"\(\?[a-z]*m", pattern) else _outside(out, lambda c: r"\Z" if c == "$" else c)
