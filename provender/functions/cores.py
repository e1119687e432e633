"""What a pattern's matches must contain: literals that an automaton finds, so that only patterns that can match are tried."""

from __future__ import annotations

_ZERO_WIDTH = {"b", "B", "A", "Z", "z", "G"}
_CLASSES = set("dDsSwWhHvVRX")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text: str) -> str:
    """A-Z in lower case, as patterns that ignore case see it; other letters stay."""
    return text.translate(_LOWER)


class _Unknown(Exception):
    """The pattern has something that isn't read here."""


def cores(pattern: str) -> list[str] | None:
    """Literals, folded, of which every match of the pattern contains at least one; None if none can be told, so that the pattern
    has to be tried everywhere. Wrong guesses are only ever on that side."""
    try:
        found, at = _alternatives(pattern, 0)
    except (_Unknown, IndexError):
        return None
    return sorted(found) if found and at == len(pattern) else None


def _alternatives(p: str, at: int) -> tuple[set[str] | None, int]:
    out: set[str] | None = set()
    while True:
        one, at = _sequence(p, at)
        out = None if out is None or one is None else out | one
        if at < len(p) and p[at] == "|":
            at += 1
            continue
        return out, at


def _group(p: str, at: int) -> tuple[set[str] | None, int]:
    """What a group needs, from behind its bracket; nothing for what only looks around."""
    around = False
    if p.startswith("?", at):
        if p.startswith(("?:", "?>"), at):
            at += 2
        elif p.startswith(("?=", "?!"), at):
            around, at = True, at + 2
        elif p.startswith(("?<=", "?<!"), at):
            around, at = True, at + 3
        elif p.startswith("?<", at):
            at = p.index(">", at) + 1 if ">" in p[at:] else len(p) + 1
        else:  # flags
            end = at + 1
            while p[end].isalpha() or p[end] == "-":
                end += 1
            if "x" in p[at:end]:
                raise _Unknown
            if p[end] == ")":
                return None, end + 1
            if p[end] != ":":
                raise _Unknown
            at = end + 1
    inner, at = _alternatives(p, at)
    if at >= len(p) or p[at] != ")":
        raise _Unknown
    return None if around else inner, at + 1


def _optional(p: str, at: int) -> tuple[bool, bool, int]:
    """(whether the part before may be missing, whether it may repeat, where the quantifier ends)."""
    if at < len(p) and p[at] in "?*+":
        missing, repeats = p[at] in "?*", p[at] in "*+"
        at += 1
    elif at < len(p) and p[at] == "{":
        end = p.index("}", at) if "}" in p[at:] else len(p) + 1
        low = p[at + 1 : end].split(",")[0]
        if not low.isdigit():
            raise _Unknown
        missing, repeats, at = int(low) == 0, True, end + 1
    else:
        return False, False, at
    return missing, repeats, at + (at < len(p) and p[at] in "?+")  # lazy and possessive ones


def _sequence(p: str, at: int) -> tuple[set[str] | None, int]:
    """The most telling of what a sequence needs: of each, any match has one literal."""
    needs: list[set[str]] = []
    run = ""

    def close():
        nonlocal run
        if run:
            needs.append({run})
        run = ""

    while at < len(p) and p[at] not in "|)":
        c = p[at]
        literal, inner = None, None
        if c == "\\":
            e = p[at + 1]
            at += 2
            if e in _ZERO_WIDTH:
                continue
            if e in _CLASSES:
                pass
            elif not e.isalnum():
                literal = e
            else:
                raise _Unknown
        elif c in "^$":
            at += 1
            continue
        elif c == "[":
            at += 1
            at += p[at] == "^"
            first = True
            while p[at] != "]" or first:
                if p[at] == "[" or p.startswith("&&", at):
                    raise _Unknown
                at += 2 if p[at] == "\\" else 1
                first = False
            at += 1
        elif c == "(":
            inner, at = _group(p, at + 1)
        elif c == ".":
            at += 1
        elif c in "?*+{":
            raise _Unknown
        else:
            literal, at = c, at + 1
        missing, repeats, at = _optional(p, at)
        if literal is not None and not missing:
            run += folded(literal)
            if repeats:
                close()
        else:
            close()
            if inner and not missing:
                needs.append(inner)
    close()
    return max(needs, key=lambda n: (min(map(len, n)), -len(n)), default=None), at
