"""CSS selectors on the node table: conditions for single elements, structural joins for what stands around them.

A selector is a list of chains (``h2, .card > a``); a chain is a sequence of compounds (``a.wide[href^="/"]``) with
combinators between them: descendant, child (``>``), next sibling (``+``), later sibling (``~``). A chain is followed
from left to right: the elements that match so far are joined, by equality on the page and the element's number, to the
candidates for the next compound through the numbers that those hold of their enclosing elements (``up``), their parent,
or their place among its children. No pairs of elements of a page are compared.

A chain that begins with ``:scope`` is told from an element at hand, as in ``:scope > a``; the matches then carry that
element's number as ``anchor``.

Supported in a compound: tag or ``*``, ``.class``, ``#id``, ``[name]`` with ``=``, ``~=``, ``|=``, ``^=``, ``$=``, ``*=``
and quoted or plain values, ``:first-child``, ``:nth-child(n)``, ``:not(…)`` with a list of compounds. Anything else is
refused. Places among children do not count elements that the node table leaves out, such as scripts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIMPLE = re.compile(r"""\*|[a-zA-Z][\w-]*|[.#][\w-]+|\[\s*[\w-]+\s*(?:[*^$~|]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\]"""
                     r"""|:scope|:first-child|:nth-child\(\s*\d+\s*\)|:not\((?:[^()"']|"[^"]*"|'[^']*')*\)""")
_BETWEEN = re.compile(r"\s*([>+~,])\s*|\s+")
_ATTRIBUTE = re.compile(r"""\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*("[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\]""")


@dataclass(frozen=True)
class Step:
    """A compound and how it stands to the one before: " ", ">", "+", "~", or "" for the first."""

    relation: str
    compound: tuple[str, ...]


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def parse(css: str) -> list[list[Step]]:
    """The chains of a selector list."""
    text, at = css.strip(), 0
    chains: list[list[Step]] = [[]]
    relation, compound = "", []

    def end() -> None:
        if not compound:
            raise ValueError(f"unsupported selector: {css}")
        if ":scope" in compound and (chains[-1] or len(compound) > 1):
            raise ValueError(f"unsupported selector: {css}")
        chains[-1].append(Step(relation, tuple(compound)))
        compound.clear()

    while at < len(text):
        if m := _SIMPLE.match(text, at):
            if compound and (m[0][0].isalpha() or m[0] == "*"):
                raise ValueError(f"unsupported selector: {css}")
            compound.append(m[0])
        elif m := _BETWEEN.match(text, at):
            end()
            relation = m[1] or " "
            if relation == ",":
                chains.append([])
                relation = ""
        else:
            raise ValueError(f"unsupported selector: {css}")
        at = m.end()
    end()
    if any(chain[-1].compound == (":scope",) for chain in chains):
        raise ValueError(f"unsupported selector: {css}")
    return chains


def _test(part: str) -> Column:
    if part[0] == ".":
        return F.array_contains(F.split(F.col("cls"), r"\s+"), part[1:])
    if part[0] == "#":
        return attr("id") == part[1:]
    if part[0] == "[":
        name, op, value = _ATTRIBUTE.fullmatch(part).groups()
        c, v = attr(name.lower()), (value or "").strip("\"'") if (value or "")[:1] in "\"'" else value or ""
        if op is None:
            return c.isNotNull()
        if op == "=":
            return c == v
        if op == "|=":
            return (c == v) | c.startswith(v + "-")
        if not v or (op == "~=" and re.search(r"\s", v)):
            return F.lit(False)
        return {"~=": F.array_contains(F.split(F.trim(c), r"\s+"), v), "^=": c.startswith(v), "$=": c.endswith(v), "*=": c.contains(v)}[op]
    if part == ":first-child":
        return F.col("child") == 1
    if part.startswith(":nth-child"):
        return F.col("child") == int(part[11:-1])
    if part.startswith(":not"):
        return ~condition(part[5:-1])
    return F.lit(True) if part == "*" else F.col("tag") == part.lower()


def _compound(parts: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, map(_test, parts)), F.lit(False))


def is_simple(css: str) -> bool:
    """Whether an element alone tells if it matches: no chain has more than one compound."""
    return all(len(chain) == 1 for chain in parse(css))


def is_scoped(css: str) -> bool:
    return any(chain[0].compound == (":scope",) for chain in parse(css))


def condition(css: str) -> Column:
    """A list of compounds as a condition on nodes."""
    chains = parse(css)
    if any(len(chain) > 1 for chain in chains):
        raise ValueError(f"more than one element is needed for: {css}")
    return reduce(lambda a, b: a | b, [_compound(chain[0].compound) for chain in chains])


_PLACE = ["page_id", "seq", "parent", "child", "up"]


def _follow(nodes: DataFrame, chain: list[Step]) -> DataFrame:
    """``page_id, seq, anchor`` of the matches of one chain."""
    def candidates(step: Step) -> DataFrame:
        return nodes.where(_compound(step.compound)).select(*_PLACE)

    if chain[0].compound == (":scope",):
        first, chain = candidates(chain[1]), chain[1:]
        if chain[0].relation not in (" ", ">"):
            raise ValueError("what stands beside :scope is not inside it")
        found = first.withColumn("anchor", F.explode("up") if chain[0].relation == " " else F.col("parent")).where("anchor >= 0")
    else:
        found = candidates(chain[0]).withColumn("anchor", F.lit(None).cast("int"))
    for step in chain[1:]:
        after = candidates(step)
        if step.relation in (" ", ">"):
            around = F.explode("up") if step.relation == " " else F.col("parent")
            joined = after.withColumn("_at", around).join(found.select("page_id", F.col("seq").alias("_at"), "anchor"), ["page_id", "_at"])
        elif step.relation == "+":
            joined = after.join(found.select("page_id", "parent", (F.col("child") + 1).alias("child"), "anchor"), ["page_id", "parent", "child"])
        else:
            since = found.groupBy("page_id", "parent", "anchor").agg(F.min("child").alias("_since"))
            joined = after.join(since, ["page_id", "parent"]).where(F.col("child") > F.col("_since"))
        # an element that several enclosing ones lead to counts once
        found = joined.select(*_PLACE, "anchor").dropDuplicates(["page_id", "seq", "anchor"])
    return found.select("page_id", "seq", "anchor")


def match(nodes: DataFrame, css: str) -> DataFrame:
    """``page_id, seq, anchor`` of every element that the selector matches; ``anchor`` is the element that ``:scope`` stands
    for, NULL without it. ``nodes`` is read once for every compound: settle it before."""
    chains = parse(css)
    out = reduce(lambda a, b: a.unionAll(b), [_follow(nodes, chain) for chain in chains])
    return out.distinct() if len(chains) > 1 else out
