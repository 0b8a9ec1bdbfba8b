"""URL filtering: host-and-path rules, then pattern rules indexed by their rarest literal token.

A pattern can match only URLs that hold its literal tokens: runs of letters and digits in the
pattern that must stand between other characters.  A pattern with alternatives is spelt out into the
ways it can match.  Each way is filed under the one of its tokens that is rarest in the table's URLs; a
URL's own tokens fetch the patterns filed under them and only those run their regular expression.
Patterns with a way that has no such token run on every URL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_TOKEN = re.compile("[0-9a-z]+")


@dataclass(frozen=True)
class HostRule:
    """Fits the host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """A regular expression searched in the whole URL."""

    verdict: str
    regex: str


#: a pattern is spelt out into so many ways at most; alternatives beyond stand for any text
WAYS = 256


def literal_tokens(regex: str) -> list[list[str]]:
    """For each way the pattern can match, the tokens that such a match holds whole, lower-cased; empty where none is certain."""
    from re import _constants as c
    from re import _parser

    def separates(op, value) -> bool:
        if op is c.IN:
            return all(o is c.LITERAL and not chr(v).isalnum() for o, v in value)
        if op is c.SUBPATTERN:
            return len(value[3]) == 1 and separates(*value[3][0])
        if op is c.BRANCH:
            return all(len(b) == 1 and (b[0][0] is c.AT or b[0][0] is c.LITERAL and not chr(b[0][1]).isalnum() or separates(*b[0])) for b in value[1])
        return op is c.AT and value in (c.AT_BEGINNING, c.AT_BEGINNING_STRING, c.AT_END, c.AT_END_STRING)

    def spelt(items) -> list[str]:
        """The ways as texts: \x00 stands for a separator or an end, \x01 for anything."""
        ways = [""]
        for op, value in items:
            if op is c.LITERAL:
                more = [chr(value).lower()]
            elif separates(op, value):
                more = ["\x00"]
            elif op is c.SUBPATTERN:
                more = spelt(value[3])
            elif op is c.BRANCH:
                more = [way for branch in value[1] for way in spelt(branch)]
            else:
                more = ["\x01"]
            if len(ways) * len(more) > WAYS:
                more = ["\x01"]
            ways = [a + b for a in ways for b in more]
        return ways

    def certain(text: str) -> list[str]:
        return [m[0] for m in _TOKEN.finditer(text) if text[m.start() - 1] != "\x01" and text[m.end()] != "\x01" and text[m.start() - 1].isascii()]

    return [certain(f"\x01{way}\x01") for way in dict.fromkeys(spelt(_parser.parse(regex)))]


class Judge:
    """Compiled rules with their token index."""

    def __init__(self, hosts: list[HostRule], patterns: list[Pattern], frequency: dict[str, int], default: str = "allow"):
        self.hosts: dict[str, list[HostRule]] = {}
        for rule in sorted(hosts, key=lambda r: (-len(r.name), r.name)):
            self.hosts.setdefault(rule.host, []).append(rule)
        self.patterns = [(re.compile(p.regex), p.verdict) for p in patterns]
        self.default = default
        self.always: list[int] = []
        self.index: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            ways = literal_tokens(p.regex)
            if all(ways):
                for token in {min(tokens, key=lambda t: (frequency.get(t, 0), t)) for tokens in ways}:
                    self.index.setdefault(token, []).append(k)
            else:
                self.always.append(k)

    def host_rule(self, host: str, path: str) -> HostRule | None:
        """The longest host-and-path rule that fits."""
        best, at = None, 0
        while True:
            for rule in self.hosts.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
            at = host.find(".", at) + 1
            if not at:
                return best

    def pattern(self, url: str) -> tuple[str, int]:
        """Verdict of the first fitting pattern (else the default), and how many patterns ran."""
        found = set(self.always)
        for token in set(_TOKEN.findall(url.lower())):
            found.update(self.index.get(token, ()))
        for n, k in enumerate(sorted(found), 1):
            if self.patterns[k][0].search(url):
                return self.patterns[k][1], n
        return self.default, len(found)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty for null or without ``://``."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = re.match("([^/?#]*)([^?#]*)", url[at + 3 :])
    return re.sub("[A-Z]", lambda m: m[0].lower(), rest[1]), rest[2]


def token_frequencies(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many of the URLs hold each of the given tokens, over the whole table."""
    wanted = frozenset(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                if url:
                    counts.update(wanted.intersection(_TOKEN.findall(url.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = urls.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r[0]: r[1] for r in rows}


def judge_urls(pages: DataFrame, hosts: list[HostRule], patterns: list[Pattern], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits), verdict, patterns_run.

    The longest fitting host-and-path rule decides; without one the first fitting pattern does,
    else the default.  Null URLs and URLs without ``://`` have empty host and path, fit no host
    rule and get the patterns' verdict (null: the default).  Repeated rows are judged each; other
    columns are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    tokens = sorted({t for p in patterns for way in literal_tokens(p.regex) for t in way})
    frequency = token_frequencies(pages.select("url"), tokens) if tokens else {}
    shared = pages.sparkSession.sparkContext.broadcast(Judge(hosts, patterns, frequency, default))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        judge, rows = shared.value, []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule = judge.host_rule(host, path) if host or path else None
            verdict, ran = (rule.verdict, 0) if rule else judge.pattern(url or "")
            rows.append((host, path, rule.name if rule else None, verdict, ran))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.string()] * 4 + [pa.int64()])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict", "patterns_run"])

    return map_batches(pages, run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string, patterns_run long")
