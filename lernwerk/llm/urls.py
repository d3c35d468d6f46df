"""URL filters over a sorted, memory-mapped array of digests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: A list may have so many entries. Its files go to every executor: 8 bytes an entry, and the entries' text.
MOST_ENTRIES = 50_000_000
VERDICTS = ("allow", "block")
#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """A read-only list of strings: sorted 64-bit digests, the strings in the same order, their offsets and verdicts."""

    PARTS = ("digests", "offsets", "text", "verdicts", "lengths")

    def __init__(self, files: list[str]) -> None:
        self.digests, self.offsets, self.text, self.verdicts, lengths = (np.load(f, mmap_mode="r") for f in files)
        self.path_lengths: list[int] = lengths.tolist()

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], prefix: str) -> list[str]:
        """Write (verdict, host, path) rules, and give the files. Of rules for one host and path the last counts.

        Paths' lengths are kept, so that probes know which prefixes to try.
        """
        verdict_of = {(h, p): VERDICTS.index(v) for v, h, p in rules}
        entries = sorted(verdict_of)
        if len(entries) > MOST_ENTRIES:
            raise ValueError(f"a list holds at most {MOST_ENTRIES} entries")
        raw = [(h + p).encode() for h, p in entries]
        digests = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        order = np.argsort(digests, kind="stable")
        raw = [raw[i] for i in order]
        arrays = (
            digests[order],
            np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64),
            np.frombuffer(b"".join(raw), np.uint8),
            np.array([verdict_of[e] for e in entries], np.uint8)[order],
            np.array(sorted({len(p) for _, p in entries}), np.int64),
        )
        files = [f"{prefix}-{part}.npy" for part in DigestArray.PARTS]
        for file, array in zip(files, arrays, strict=True):
            np.save(file, array)
        return files

    def find(self, probes: list[str]) -> np.ndarray:
        """Place of each probe in the list, -1 for none: one binary search over all, then the stored strings of the few that hit are compared."""
        raw = [p.encode() for p in probes]
        want = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        found = np.full(len(raw), -1, np.int64)
        if not len(self.digests):
            return found
        at = np.searchsorted(self.digests, want)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == want):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == want[i] and found[i] < 0:  # entries that share a digest lie together
                if self.text[self.offsets[j] : self.offsets[j + 1]].tobytes() == raw[i]:
                    found[i] = j
                j += 1
        return found

    def longest(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """For each url, the longest entry whose host it has or lies under and whose path its path starts with, and its verdict."""
        owner, probes = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            dots = [0, *[k + 1 for k, c in enumerate(host) if c == "."]]
            for n in self.path_lengths:
                if n <= len(path):
                    owner += [i] * len(dots)
                    probes += [host[d:] + path[:n] for d in dots]
        places = self.find(probes)
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        for k in np.flatnonzero(places >= 0):
            i, p = owner[k], probes[k]
            if len(p) > len(rules[i] or ""):
                rules[i], verdicts[i] = p, VERDICTS[self.verdicts[places[k]]]
        return rules, verdicts


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write a list and let Spark copy its files to every executor; gives the name to open it by."""
    name = f"digests-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="lists-")  # executors that come later fetch the files from the driver, so they stay while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for file in DigestArray.write(rules, os.path.join(folder, name)):
        spark.sparkContext.addFile(file)
    return name


_open: dict[str, DigestArray] = {}


def longest_rule(spark: SparkSession, host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Struct of the longest rule that fits (host and path in one string) and its verdict, both null where none does."""
    name = ship(spark, rules)

    @F.pandas_udf("rule string, verdict string")
    def fits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if name not in _open:
            _open[name] = DigestArray([SparkFiles.get(f"{name}-{part}.npy") for part in DigestArray.PARTS])
        for hosts, paths in batches:
            rule, verdict = _open[name].longest(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    return fits(host, path)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; input columns of these names are replaced.

    A rule fits its host and all hosts under it, when the url's path starts with the
    rule's; the longest fitting rule decides. A url that no entry of the list fits
    gets ``default``. A null url, or one without ``://``, has an empty host and path, which no
    rule with a host fits. Nothing is shuffled; the html is not read. Repeated rows
    have one verdict. An empty table gives an empty result.
    """
    d = pages.drop("host", "path", "rule", "verdict")
    d = d.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    d = d.withColumn("__found", longest_rule(pages.sparkSession, F.col("host"), F.col("path"), rules))
    return d.withColumns({"rule": F.col("__found.rule"), "verdict": F.coalesce("__found.verdict", F.lit(default))}).drop("__found")
