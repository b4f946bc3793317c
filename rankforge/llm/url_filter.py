"""URL filter: a broadcast trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules of one broadcast trie. A longer list is cut into several tries that are
# looked up one after the other, and the longest match of all of them wins.
RULES_PER_TRIE = 200_000

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """``"block example.com/en/"``; the host ends at the first slash."""
    verdict, _, place = text.strip().partition(" ")
    host, slash, path = place.strip().partition("/")
    if verdict not in (ALLOW, BLOCK) or not host:
        raise ValueError(f"not a rule: {text!r}")
    return Rule(host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, verdict)


class Trie:
    """Longest rule for a host and a path.

    A node is a dict of child labels. Below the host labels, key ``None`` leads
    to the root of the path segments of that host. A rule ends at the node of
    its full segments with the start of the segment after them, which may be
    empty: ``/en/`` needs segments ``""``, ``"en"`` and any third one.
    """

    def __init__(self, rules: Iterable[tuple[int, Rule]]):
        self.root: dict = {}
        for number, rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *full, start = rule.path.split("/")
            for segment in full:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            ends[start] = _stronger(ends.get(start), (number, rule))

    def longest(self, host: str, path: str) -> tuple[int, int, int] | None:
        """``(host labels, path length, rule number)`` of the rule that wins."""
        node, depth = self.root, 0
        best = None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            depth += 1
            paths = node.get(None)
            found = paths is not None and _longest_path(paths, segments)
            if found:
                best = (depth, *found)
        return best


def _stronger(old: tuple[int, Rule] | None, new: tuple[int, Rule]) -> tuple[int, Rule]:
    # The same place listed twice: block wins.
    return new if old is None or new[1].verdict == BLOCK else old


def _longest_path(node: dict, segments: list[str]) -> tuple[int, int] | None:
    best = None
    for segment in segments:
        ends = node.get(None)
        if ends:
            fits = [s for s in ends if segment.startswith(s)]
            if fits:
                number, rule = ends[max(fits, key=len)]
                best = (len(rule.path), number)
        node = node.get(segment)
        if node is None:
            break
    return best


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    url: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """Add a column ``url_match``: struct of ``host, path, rule, verdict``.

    The rule with the most host labels wins, then the one with the longest
    path; of equal places a block. Without a rule ``rule`` is null and
    ``verdict`` is ``default``. A null url, or one without ``://``, has an empty
    host and path, which no rule fits. A column of the input that is named
    ``url_match`` is replaced; all other columns stay. Every row stays.

    The rules are small next to the pages and are broadcast, in tries of at
    most ``RULES_PER_TRIE``.
    """
    rules = list(rules)
    numbered = list(enumerate(rules))
    context = pages.sparkSession.sparkContext
    tries = [
        context.broadcast(Trie(numbered[i : i + RULES_PER_TRIE]))
        for i in range(0, len(numbered), RULES_PER_TRIE)
    ]
    named = context.broadcast([(r.name, r.verdict) for r in rules])

    @F.pandas_udf("rule string, verdict string")
    def decide(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            rows = []
            for host, path in zip(hosts, paths):
                found = [f for f in (t.value.longest(host, path) for t in tries) if f]
                top = max((f[:2] for f in found), default=None)
                ties = [named.value[f[2]] for f in found if f[:2] == top]
                # The same place in two tries: block wins here too.
                rows.append(min(ties, key=lambda r: r[1] != BLOCK, default=(None, default)))
            yield pd.DataFrame(rows, columns=["rule", "verdict"])

    host, path = host_of(F.col(url)), path_of(F.col(url))
    return pages.withColumn(
        "url_match",
        F.struct(host.alias("host"), path.alias("path"), decide(host, path).alias("of")),
    ).withColumn(
        "url_match",
        F.struct("url_match.host", "url_match.path", "url_match.of.rule", "url_match.of.verdict"),
    )
