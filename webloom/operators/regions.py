"""Regions of pages by path expressions, as windows and joins over the node table.

A path like ``//main//div[@id='x'][2]/p`` is compiled into one column or join a step. Elements
are numbered in document order and ``last_desc`` is the last one inside, so an element stands
below one of a set exactly if the largest ``last_desc`` of those before it reaches it: a
running maximum, whatever the depth. A child step joins on the parent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.runtime import grown

_STEP = re.compile(r"(//?)(\*|[A-Za-z][\w-]*)")
_TOKEN = re.compile(r"\s*(?:(?P<string>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<attr>@[A-Za-z_][\w:.-]*)|(?P<name>[A-Za-z][\w-]*)|(?P<sign>!=|[()=,\[\]]))")


class _Predicate:
    """The parts of one predicate, read from left to right by precedence: or, and, comparison."""

    def __init__(self, path: str, at: int) -> None:
        self.path, self.at = path, at

    def peek(self) -> tuple[str, str, int]:
        if not (m := _TOKEN.match(self.path, self.at)):
            raise ValueError(f"not understood at {self.at}: {self.path!r}")
        return m.lastgroup, m[m.lastgroup], m.end()

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        kind, value, self.at = self.peek()
        if wanted and value != wanted:
            raise ValueError(f"{wanted!r} expected before {self.at}: {self.path!r}")
        return kind, value

    def any_of(self) -> Column:
        out = self.all_of()
        while self.peek()[:2] == ("name", "or"):
            self.take()
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.test()
        while self.peek()[:2] == ("name", "and"):
            self.take()
            out = out & self.test()
        return out

    def test(self) -> Column:
        kind, value = self.take()
        if kind == "attr":
            own = F.try_element_at("attrs", F.lit(value[1:].lower()))
            sign = self.peek()[1]
            if sign in ("=", "!="):
                self.take()
                other = self.string()
                return F.coalesce((own == other) if sign == "=" else (own != other), F.lit(False))
            return own.isNotNull()
        if kind == "name" and value in ("contains", "starts-with"):
            self.take("(")
            kind, name = self.take()
            if kind != "attr":
                raise ValueError(f"an attribute expected before {self.at}: {self.path!r}")
            self.take(",")
            part = self.string()
            self.take(")")
            own = F.coalesce(F.try_element_at("attrs", F.lit(name[1:].lower())), F.lit(""))
            return own.contains(part) if value == "contains" else own.startswith(part)
        if kind == "name" and value == "not":
            self.take("(")
            out = self.any_of()
            self.take(")")
            return ~out
        if value == "(":
            out = self.any_of()
            self.take(")")
            return out
        raise ValueError(f"{value!r} isn't understood in {self.path!r}")

    def string(self) -> str:
        kind, value = self.take()
        if kind != "string":
            raise ValueError(f"a string expected before {self.at}: {self.path!r}")
        return value[1:-1]


def steps(path: str) -> list[tuple[bool, str, list]]:
    """(below, tag, predicates) of a path's steps: a predicate is a Column over attrs, or a position (0: the last).

    Names, ``*``, ``/``, ``//``, positions, ``last()``, attributes with ``=`` and ``!=``, ``contains``, ``starts-with``, ``not``, ``and`` and ``or``
    are understood. Anything else is an error before any job.
    """
    path, at, out = path.strip(), 0, []
    while at < len(path):
        if not (m := _STEP.match(path, at)):
            raise ValueError(f"a step expected at {at}: {path!r}")
        at, predicates = m.end(), []
        while path[at : at + 1] == "[":
            if place := re.compile(r"\[\s*(\d+|last\(\s*\)|position\(\s*\)\s*=\s*\d+)\s*\]").match(path, at):
                digits = re.search(r"\d+", place[1])
                if digits and int(digits[0]) == 0:
                    raise ValueError(f"positions begin with 1: {path!r}")
                predicates.append(int(digits[0]) if digits else 0)
                at = place.end()
                continue
            inner = _Predicate(path, at + 1)
            predicates.append(inner.any_of())
            inner.take("]")
            at = inner.at
        out.append((m[1] == "//", m[2].lower(), predicates))
    if not out:
        raise ValueError("an empty path")
    return out


def _tested(nodes: DataFrame, tag: str, predicates: list) -> DataFrame:
    """nodes with ``hit``: the tag and all predicates hold; positions count the children of a parent that hold so far."""
    hit = F.lit(True) if tag == "*" else F.col("tag") == tag
    nodes = nodes.withColumn("hit", hit)
    for one in predicates:
        if isinstance(one, int):
            family = Window.partitionBy("page_id", "parent")
            nth = F.sum(F.col("hit").cast("int")).over(family.orderBy("nid"))
            last = F.sum(F.col("hit").cast("int")).over(family)
            nodes = nodes.withColumn("hit", F.col("hit") & (nth == (F.lit(one) if one else last)))
        else:
            nodes = nodes.withColumn("hit", F.col("hit") & one)
    return nodes


def below(marked: Column, within: Column) -> Column:
    """Whether a row of the node table stands below a marked one, or is one if ``within`` says that this counts."""
    before = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(marked, F.col("last_desc"))).over(before) >= F.col("nid"), F.lit(False)) | (within & marked)


def select_nodes(nodes: DataFrame, path: str) -> DataFrame:
    """(page_id, nid) of the elements of a node table that a path leads to, from the root of each page; each once.

    ``//`` takes elements at any depth; a position counts among the children of one parent. A page_id stands for one
    page. Attribute names are lower-case; an empty table gives no rows.
    """
    table = nodes.select("page_id", "nid", "parent", "last_desc", "tag", "attrs")
    context = None  # the document
    for deep, tag, predicates in steps(path):
        rows = _tested(table, tag, predicates)
        if context is None:
            found = rows.filter("hit" if deep else "hit AND parent IS NULL")
        elif deep:
            chosen = context.withColumn("chosen", F.lit(True))
            rows = rows.join(grown(chosen), ["page_id", "nid"], "left")
            found = rows.withColumn("under", below(F.coalesce("chosen", F.lit(False)), F.lit(False))).filter("hit AND under")
        else:
            found = rows.filter("hit").join(grown(context.withColumnRenamed("nid", "parent")), ["page_id", "parent"], "left_semi")
        context = found.select("page_id", "nid")
    return context


def label_nodes(nodes: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """nodes with ``label``: 1 inside a positive root (page_id, root), 0 inside a negative one, which wins; others are left out.

    Roots are ids of elements; an element is inside of one if the largest last element of the roots up to it isn't before it.
    """
    marks = positive.withColumn("good", F.lit(1)).unionByName(negative.withColumn("bad", F.lit(1)), allowMissingColumns=True)
    marks = marks.groupBy("page_id", F.col("root").alias("nid")).agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    rows = nodes.join(grown(marks), ["page_id", "nid"], "left")
    inside = lambda c: below(F.col(c).isNotNull(), F.lit(True))
    return rows.withColumn("label", F.when(inside("bad"), 0).when(inside("good"), 1)).filter("label IS NOT NULL").drop("good", "bad")


def labelled_by_paths(nodes: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """nodes with ``label``: 1 inside what a positive path leads to, 0 inside what a negative one does, which wins; others are left out."""
    def roots(paths: list[str]) -> DataFrame:
        out = None
        for path in dict.fromkeys(paths):
            found = select_nodes(nodes, path)
            out = found if out is None else out.unionByName(found)
        return out.distinct() if out is not None else nodes.select("page_id", "nid").filter("false")

    return label_nodes(nodes, roots(positive).withColumnRenamed("nid", "root"), roots(negative).withColumnRenamed("nid", "root"))


def node_paths(nodes: DataFrame) -> DataFrame:
    """(page_id, nid, path): the path of each element from the root, with positions where siblings share its tag.

    An element asks at each level for the last element opened there, which is the one above it.
    """
    family = Window.partitionBy("page_id", "parent", "tag")
    nth, many = F.row_number().over(family.orderBy("nid")), F.count("*").over(family)
    step = F.concat("tag", F.when(many > 1, F.concat(F.lit("["), nth.cast("string"), F.lit("]"))).otherwise(""))
    own = nodes.select("page_id", "nid", "parent", "depth", "tag").withColumn("step", step)
    each = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    opened = Window.partitionBy("page_id", "level").orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    told = each.withColumn("above", F.last(F.when(F.col("level") == F.col("depth"), F.col("step")), True).over(opened))
    joined = told.groupBy("page_id", "nid").agg(F.sort_array(F.collect_list(F.struct("level", "above"))).alias("steps"))
    return joined.select("page_id", "nid", F.concat(F.lit("/"), F.array_join(F.transform("steps", lambda s: s["above"]), "/")).alias("path"))
