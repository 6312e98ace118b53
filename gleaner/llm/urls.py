"""URL filters by a sort-merge range join over reversed-host keys.

A host's key is its labels from last to first, each closed by U+0001 (which is
escaped where a host has it), so a host and all its subdomains are one interval
of keys; a path prefix is one interval of paths. Pages are range-partitioned by
host key, path and id (a host with a third of all rows spreads over many
partitions) and sorted. Each partition is swept once beside the sorted rules: a
stack holds the rule hosts whose interval is open. When a rule host is opened,
its path prefixes are nested once by the same kind of sweep, so that a url's
longest prefix is a binary search and a few steps outwards. The strongest open
rule wins.

Rules are a table with a checked bound (MOST_RULES), sent to every task. Beyond
it both sides are cut into the same ranges of keys: a rule goes to every range
that its interval meets, and each range is swept by itself.

Defined results: host is what stands after the first :// up to /, ?, # or the
end, A-Z lowered; path goes on up to ? or #. A null url, or one without ://, has
both empty and fits no rule; nor does any url fit a rule without a host. Of rules
that fit, the one with most characters in host and path wins, then the one with
the longer host, then block before allow. Repeated rows each get their verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 100_000
#: Urls that a range is meant to have, and how many of them are drawn to place its border.
RANGE_URLS, DRAWN = 200_000, 20
END, ESCAPE, LAST = "\x01", "\x02", "\U0010ffff"
RESULT = ("host", "path", "rule", "own_rule", "verdict")


class Rule(NamedTuple):
    action: str
    host: str
    path: str
    base: bool = True

    @property
    def strength(self) -> tuple:
        return (self.base, len(self.host) + len(self.path), len(self.host), self.action == "block", self.host, self.path)


def host_key(host: str) -> str:
    host = host.replace(ESCAPE, ESCAPE + "3").replace(END, ESCAPE + "4")
    return "".join(label + END for label in reversed(host.split("."))) if host else ""


def parts_of(pages: DataFrame, id_column: str, url_column: str) -> DataFrame:
    """(id, host, path, key)."""
    url = F.col(url_column)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    plain = F.replace(F.replace("host", F.lit(ESCAPE), F.lit(ESCAPE + "3")), F.lit(END), F.lit(ESCAPE + "4"))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.", -1)), END), F.lit(END)))
    return pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path")).withColumn("key", key)


class Paths:
    """The path prefixes of one rule host, nested."""

    def __init__(self, rules: list[Rule]):
        strongest: dict[str, Rule] = {}
        for rule in rules:
            other = strongest.get(rule.path)
            if other is None or rule.strength > other.strength:
                strongest[rule.path] = rule
        self.prefixes = sorted(strongest)
        self.outer: list[int] = []
        self.best: list[Rule] = []
        open_: list[int] = []
        for i, prefix in enumerate(self.prefixes):
            while open_ and not prefix.startswith(self.prefixes[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            own = strongest[prefix]
            self.best.append(max(own, self.best[open_[-1]], key=lambda r: r.strength) if open_ else own)
            open_.append(i)

    def at(self, path: str) -> Rule | None:
        i = bisect_right(self.prefixes, path) - 1
        while i >= 0 and not path.startswith(self.prefixes[i]):
            i = self.outer[i]
        return self.best[i] if i >= 0 else None


class Sweep:
    """Rules met in key order. at() must be called with rising keys."""

    def __init__(self, rules: list[Rule]):
        by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            if rule.host:
                by_host.setdefault(host_key(rule.host), []).append(rule)
        self.todo = sorted(by_host.items())
        self.next = 0
        self.hosts: list[tuple[str, Paths]] = []
        self.key: str | None = None

    def at(self, key: str, path: str) -> Rule | None:
        if key != self.key:
            self._host(key)
        found = [r for _, paths in self.hosts if (r := paths.at(path))]
        return max(found, key=lambda r: r.strength, default=None)

    def _host(self, key: str) -> None:
        self.key = key
        while self.hosts and not key.startswith(self.hosts[-1][0]):
            self.hosts.pop()
        while self.next < len(self.todo) and self.todo[self.next][0] <= key:
            start, rules = self.todo[self.next]
            self.next += 1
            if key.startswith(start):
                self.hosts.append((start, Paths(rules)))


def verdicts(sweep: Sweep, batch: pa.RecordBatch | pa.Table) -> list[pa.Array]:
    """rule, own_rule and verdict of urls sorted by key."""
    found = [sweep.at(k, p) if k else None for k, p in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True)]
    named = [f"{r.host}{r.path}" if r and r.base else None for r in found]
    extra = [f"{r.host}{r.path}" if r and not r.base else None for r in found]
    return [pa.array(x, pa.string()) for x in (named, extra, [r.action if r else "allow" for r in found])]


def swept(urls: DataFrame, rules: list[Rule], kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(rules)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), *verdicts(sweep, batch)], ["id", *RESULT])

    dealt = urls.repartitionByRange("key", "path", "id").sortWithinPartitions("key", "path")
    return dealt.mapInArrow(run, f"id {kind}, host string, path string, rule string, own_rule string, verdict string")


def ranged(urls: DataFrame, rules: DataFrame, kind: str, size: int = RANGE_URLS) -> DataFrame:
    """The same for a rule table (action, host, path, base) of any size. Borders
    come from a few drawn urls; which are drawn doesn't change any verdict. Urls
    with one key and path may span several ranges; they are dealt by their id."""
    count = urls.count()
    ranges = max(1, count // size)
    drawn = urls.select("key", "path").sample(min(1.0, 2 * DRAWN * ranges / max(1, count)), seed=7).orderBy("key", "path").limit(4 * DRAWN * ranges).collect()
    borders = [tuple(drawn[len(drawn) * i // ranges]) for i in range(1, ranges)] if drawn else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for name, *place in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "path")), strict=True):
                low, high = bisect_left(borders, tuple(place)), bisect_right(borders, tuple(place))
                at.append(low + crc32(str(name).encode()) % (high - low + 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "key")), pa.array(at, pa.int32())], ["id", "host", "path", "key", "range"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at = [], []
            for i, host in enumerate(batch.column("host").to_pylist()):
                if key := host_key(host or ""):
                    some = range(bisect_left(borders, (key, "")), bisect_right(borders, (key + LAST, LAST)) + 1)
                    at += some
                    of += [i] * len(some)
            rows = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at, pa.int32())], ["action", "host", "path", "base", "range"])

    def sweep(own: pa.Table, some: pa.Table) -> pa.Table:
        own = own.sort_by([("key", "ascending"), ("path", "ascending")])
        rows = [Rule(*r) for r in zip(*(some.column(c).to_pylist() for c in Rule._fields), strict=True)]
        return pa.Table.from_arrays([own.column("id"), own.column("host"), own.column("path"), *verdicts(Sweep(rows), own)], ["id", *RESULT])

    left = urls.select("id", "host", "path", "key").mapInArrow(place, f"id {kind}, host string, path string, key string, range int")
    right = rules.select(*Rule._fields).mapInArrow(meet, "action string, host string, path string, base boolean, range int")
    return left.groupBy("range").cogroup(right.groupBy("range")).applyInArrow(sweep, f"id {kind}, host string, path string, rule string, own_rule string, verdict string")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule: a base rule or null, own_rule: one of the method's
    own, used where no base rule fits, verdict) for every row."""
    urls = parts_of(pages, id_column, url_column)
    kind = pages.schema[id_column].dataType.simpleString()
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "action string, host string, path string, base boolean")
    if isinstance(rules, DataFrame):
        found = rules.select(*Rule._fields).take(MOST_RULES + 1)
        out = swept(urls, [Rule(*r) for r in found], kind) if len(found) <= MOST_RULES else ranged(urls, rules, kind)
    else:
        out = swept(urls, rules, kind)
    return out.withColumnRenamed("id", id_column)
