"""Row expressions written once and rendered for Spark or for the SQL that checks them.

A rule is a function of a ``Dialect`` and of SQL texts of its inputs; it returns SQL text.
``column`` turns a rule into a Spark Column: built-in expressions only, so that
Catalyst sees and generates code for all of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())  # Unicode's, as neither engine's own classes hold them all


def beginning(pattern: str) -> str:
    """The lower-case ASCII letters that every match of a pattern begins with (none known: empty)."""
    depth = 0
    for c in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ""
    found = re.match(r"(?:\\b)?([a-z]+)([?*{]?)", pattern)
    return "" if not found else found[1][:-1] if found[2] else found[1]


class Dialect:
    """Spark SQL."""

    def text(self, s: str) -> str:
        """A literal in which backslashes stand for themselves."""
        parts = s.split("'")
        quoted = [f"r'{p}'" for p in parts]
        return quoted[0] if len(parts) == 1 else "concat(" + ", \"'\", ".join(quoted) + ")"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def hits(self, x: str, pattern: str) -> str:
        """The pattern is searched only where the letters that it begins with stand in the text."""
        count, first = f"CAST(regexp_count({x}, {self.text(pattern)}) AS BIGINT)", beginning(pattern)
        return f"(CASE WHEN NOT contains({x}, {self.text(first)}) THEN CAST(0 AS BIGINT) ELSE {count} END)" if first else count

    def matches_any_case(self, x: str, lower: str, pattern: str) -> str:
        """Alternatives in either case, searched only where the letters that one of them begins with stand in ``lower``, the lower-case text."""
        firsts = {beginning(p) for p in re.sub(r"^[(][?]i[)][(](.*)[)]$", r"\1", pattern).removeprefix("(?i)").lower().split("|")}
        if "" in firsts:
            return self.matches(x, pattern)
        some = [f"contains({lower}, {self.text(p)})" for p in sorted(firsts) if not any(q != p and q in p for q in firsts)]
        return f"(({' OR '.join(some)}) AND {self.matches(x, pattern)})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def keep(self, x: str, name: str, test: str) -> str:
        return f"filter({x}, {name} -> {test})"

    def each(self, x: str, name: str, value: str) -> str:
        return f"transform({x}, {name} -> {value})"

    def split(self, x: str, mark: str) -> str:
        """By one character."""
        return f"split({x}, {self.text('[' + mark + ']')})"

    def join(self, x: str, mark: str) -> str:
        return f"array_join({x}, {self.text(mark)})"

    def item(self, x: str, k: str) -> str:
        """From 1; null outside."""
        return f"get({x}, ({k}) - 1)"

    def sorted_set(self, x: str) -> str:
        return f"array_sort(array_distinct(array_compact({x})))"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"endswith({x}, {y})"

    def sequence(self, a: str, b: str) -> str:
        """a to b, empty if b < a."""
        return f"(CASE WHEN ({b}) < ({a}) THEN array() ELSE sequence({a}, {b}) END)"

    def exists(self, x: str, name: str, test: str) -> str:
        return f"exists({x}, {name} -> {test})"

    def concat_lists(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def strip(self, x: str) -> str:
        """Without spaces of any kind at both ends."""
        return f"btrim({x}, {self.text(SPACES)})"


class DuckDialect(Dialect):
    """DuckDB's SQL."""

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def _bounded(self, x: str, pattern: str) -> str:
        """Its word boundaries know ASCII only: other Latin letters become an ASCII one where a pattern has boundaries."""
        return f"regexp_replace({x}, '[À-ÖØ-öø-ɏ]', 'Z', 'g')" if r"\b" in pattern else x

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({self._bounded(x, pattern)}, {self.text(pattern)})"

    def matches_any_case(self, x: str, lower: str, pattern: str) -> str:
        return self.matches(x, pattern)

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        for k in range(1, 6):
            by = by.replace(f"${k}", f"\\{k}")
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def hits(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({self._bounded(x, pattern)}, {self.text(pattern)})) AS BIGINT)"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def keep(self, x: str, name: str, test: str) -> str:
        return f"list_filter({x}, lambda {name}: {test})"

    def each(self, x: str, name: str, value: str) -> str:
        return f"list_transform({x}, lambda {name}: {value})"

    def split(self, x: str, mark: str) -> str:
        return f"string_split({x}, {self.text(mark)})"

    def join(self, x: str, mark: str) -> str:
        return f"array_to_string({x}, {self.text(mark)})"

    def item(self, x: str, k: str) -> str:
        return f"({x})[{k}]"

    def sorted_set(self, x: str) -> str:
        return f"list_sort(list_distinct(list_filter({x}, lambda n_: n_ IS NOT NULL)))"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"ends_with({x}, {y})"

    def sequence(self, a: str, b: str) -> str:
        return f"range({a}, ({b}) + 1)"

    def exists(self, x: str, name: str, test: str) -> str:
        return f"(len(list_filter({x}, lambda {name}: {test})) > 0)"

    def concat_lists(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def strip(self, x: str) -> str:
        return f"trim({x}, {self.text(SPACES)})"


SPARK, DUCK = Dialect(), DuckDialect()
Rule = Callable[..., str]


def column(rule: Rule, *inputs: str, **options) -> Column:
    """The Spark Column of a rule over the named columns (or SQL texts)."""
    return F.expr(rule(SPARK, *inputs, **options))


def sql(rule: Rule, *inputs: str, **options) -> str:
    return rule(DUCK, *inputs, **options)
