"""The selection language: /chain/segment/residue/atom globs compiled to a column predicate.

Fields are right-aligned and empty ones match anything. Each is an extended glob: * ? [abc] [!abc]
and ?(..) *(..) +(..) @(..) !(..) with alternatives. Residue numbers take ranges, @(1-5|10), where
a comma or semicolon also separates. Selections combine from left to right with `; add` and
`; del`. A trailing [r] takes all atoms within r of any selected atom, the selection included; [-r]
takes atoms at least r away from one or more selected atoms. Matching is case-sensitive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("chain_id", "seg_id", "res_seq", "atom_name")
_META = set(".^$+{}()|\\[]*?")


class SelectionError(ValueError):
    """A selection that cannot be read."""


def glob_regex(pattern: str) -> str:
    """Java regular expression, anchored, of an extended glob."""
    out, at = [], 0
    text, stack = pattern, []
    while at < len(text):
        c = text[at]
        if c in "?*+@!" and text[at + 1 : at + 2] == "(":
            stack.append(c)
            out.append("(?!(?:" if c == "!" else "(?:")
            at += 2
            continue
        if c == ")" and stack:
            kind = stack.pop()
            # a negated group stands for any run that none of its alternatives matches to the end
            out.append(")$).*" if kind == "!" else ")" + {"?": "?", "*": "*", "+": "+", "@": ""}[kind])
        elif c == "|" and stack:
            out.append("|")
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in text[at + 2 :]:
            end = text.index("]", at + 2)
            body = text[at + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + body.replace("\\", "\\\\") + "]")
            at = end
        else:
            out.append("\\" + c if c in _META else c)
        at += 1
    if stack:
        raise SelectionError(f"unclosed group in {pattern!r}")
    return "^(?:" + "".join(out) + ")$"


def ranges(text: str) -> list[tuple[int, int]] | None:
    """Number ranges of @(1-5|10) or 1-5|10, None if the text is another glob."""
    body = re.fullmatch(r"@?\(?([\d\s|,;-]+)\)?", text)
    if not body:
        return None
    out = []
    for part in re.split(r"[|,;]", body[1]):
        numbers = re.fullmatch(r"\s*(-?\d+)(?:\s*-\s*(-?\d+))?\s*", part)
        if not numbers:
            return None
        low, high = int(numbers[1]), int(numbers[2] or numbers[1])
        if low > high:
            raise SelectionError(f"reversed range {part!r}")
        out.append((low, high))
    return out


def range_list(text: str) -> list[int]:
    """All numbers of a range string, in order."""
    found = ranges(text)
    if found is None:
        raise SelectionError(f"not a range: {text!r}")
    return [k for low, high in found for k in range(low, high + 1)]


@dataclass(frozen=True)
class Term:
    """One selection of a chain, with how it combines and its distance, if any."""

    verb: str
    fields: tuple[str, str, str, str]
    radius: float | None = None


def parse(selection: str) -> list[Term]:
    terms = []
    # a semicolon inside brackets separates alternatives, not selections
    for k, part in enumerate(re.split(r";(?![^(]*\))", selection)):
        words = part.split()
        verb = "add"
        if words and words[0] in ("add", "del"):
            verb = words.pop(0)
        elif k:
            raise SelectionError(f"add or del wanted in {part!r}")
        if len(words) != 1:
            raise SelectionError(f"one selection wanted in {part!r}")
        text, radius = words[0], None
        if m := re.fullmatch(r"(.*)\[(-?\d+(?:\.\d*)?)\]", text):
            text, radius = m[1], float(m[2])
        pieces = text.removeprefix("/").split("/") if text.startswith("/") else [text]
        if len(pieces) > 4:
            raise SelectionError(f"more than four fields in {text!r}")
        pieces = ["*"] * (4 - len(pieces)) + [p or "*" for p in pieces]
        terms.append(Term(verb, tuple(pieces), radius))
    return terms


def _field(name: str, glob: str) -> Column | None:
    if glob == "*":
        return None
    if name == "res_seq" and (found := ranges(glob)) is not None:
        return reduce(lambda a, b: a | b, [F.col(name).between(low, high) if low != high else F.col(name) == low for low, high in found])
    column = F.col(name).cast("string") if name == "res_seq" else F.col(name)
    if not set(glob) & set("*?[]()|"):
        return column == glob
    return column.rlike(glob_regex(glob))


def predicate(selection: str) -> Column:
    """The selection as one condition over an atom table; distances are left to `select`."""
    out: Column = F.lit(False)
    for term in parse(selection):
        if term.radius is not None or term.fields[3] == "#":
            raise SelectionError("distances and # need a structure: use select")
        here = [c for name, glob in zip(FIELDS, term.fields) if (c := _field(name, glob)) is not None]
        mine = reduce(lambda a, b: a & b, here) if here else F.lit(True)
        out = (out | mine) if term.verb == "add" else (out & ~mine)
    return F.coalesce(out, F.lit(False))


def select(atoms: DataFrame, selection: str) -> DataFrame:
    """The selected rows of an atom table (with x, y, z where a distance is used), without repeats."""
    terms = parse(selection)
    if all(t.radius is None and t.fields[3] != "#" for t in terms):
        return atoms.where(predicate(selection))
    chosen: DataFrame | None = None
    for term in terms:
        mine = _term(atoms, term).select("atom_id").distinct()
        if chosen is None:
            chosen = mine if term.verb == "add" else mine.limit(0)
        elif term.verb == "add":
            chosen = chosen.union(mine).distinct()
        else:
            chosen = chosen.join(mine, "atom_id", "left_anti")
    return atoms.join(chosen, "atom_id", "left_semi")


def _term(atoms: DataFrame, term: Term) -> DataFrame:
    from ..operators.neighbours import within

    fields = term.fields if term.fields[3] != "#" else (*term.fields[:3], "*")
    here = [c for name, glob in zip(FIELDS, fields) if (c := _field(name, glob)) is not None]
    rows = atoms.where(reduce(lambda a, b: a & b, here)) if here else atoms
    if term.fields[3] == "#":
        # one atom per residue: CA if there is one, else the middle atom
        key = ["chain_id", "seg_id", "res_seq"]
        ids = rows.groupBy(*key).agg(F.min(F.when(F.col("atom_name") == "CA", F.col("atom_id"))).alias("ca"), F.sort_array(F.collect_list("atom_id")).alias("ids"))
        rows = rows.join(ids.select(F.coalesce("ca", F.element_at("ids", (F.size("ids") / 2).cast("int") + 1)).alias("atom_id")), "atom_id", "left_semi")
    if term.radius is None:
        return rows
    if term.radius >= 0:
        return within(atoms, rows, term.radius)
    # at least r from one selected atom: all but those whose every selected atom is nearer
    far = -term.radius
    near = within(atoms, rows, far, strict=True, count="n")
    many = rows.count()
    return atoms.join(near.where(F.col("n") >= many), "atom_id", "left_anti") if many else atoms.limit(0)
