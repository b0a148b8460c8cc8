"""URL allow and block rules as a memory-mapped, sorted array of 64-bit digests.

Every url is turned into the rule texts that could fit it (host suffixes times the path lengths
that occur in the rules); their digests are searched in the sorted array in one vectorised binary
search, and a hit counts only if the stored text is the same.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A file of this many rules (about 100 bytes each) is sent to every executor; longer lists join.
MAX_RULES = 5_000_000


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestFile:
    """Layout: rule count, sorted digests, text offsets, verdict bytes, texts."""

    @staticmethod
    def write(path: str, rules: Iterable[tuple[str, str, str]]) -> None:
        """Rules are (allow or block, host, path from its slash). Of equal rules block wins."""
        by_text: dict[str, str] = {}
        for verdict, host, tail in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            text = host.lower() + tail
            by_text[text] = "block" if "block" in (verdict, by_text.get(text)) else "allow"
        items = sorted((_digest(t), t.encode("utf-8", "surrogatepass"), v) for t, v in by_text.items())
        ends = np.cumsum([0] + [len(t) for _, t, _ in items], dtype=np.int64)
        with open(path, "wb") as out:
            out.write(np.array([len(items)], np.int64).tobytes())
            out.write(np.array([d for d, _, _ in items], np.uint64).tobytes())
            out.write(ends.tobytes())
            out.write(bytes(v == "block" for _, _, v in items))
            for _, text, _ in items:
                out.write(text)

    def __init__(self, path: str):
        n = int(np.memmap(path, np.int64, "r", 0, (1,))[0])
        self.digests = np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        at = 8 + 8 * n + 8 * (n + 1)
        self.block = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.zeros(0, np.uint8)
        size = int(self.ends[-1])
        self.texts = np.memmap(path, np.uint8, "r", at + n, (size,)) if size else np.zeros(0, np.uint8)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Rule number of each key, -1 if no rule has exactly that text."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        found = np.full(len(keys), -1, np.int64)
        inside = at < len(self.digests)
        inside[inside] = self.digests[at[inside]] == digests[inside]
        for i in np.flatnonzero(inside):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:
                if self.texts[self.ends[j]: self.ends[j + 1]].tobytes() == keys[i]:
                    found[i] = j
                    break
                j += 1  # equal digest, other text
        return found


def path_lengths(rules: Iterable[tuple[str, str, str]]) -> list[int]:
    return sorted({len(p) for _, _, p in rules})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a url or a `://` in it."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_ASCII_LOWER), path


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Rule texts that would fit, the longest first; of equal lengths the longer host first."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(h, path[:n]) for h in hosts if h for n in lengths if n <= len(path)]
    found.sort(key=lambda c: (-len(c[0]) - len(c[1]), -len(c[0])))
    return [h + p for h, p in found]


def _publish(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Name under which executors fetch the digest file, each once, onto its own disk."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="digests-"))
    name = f"digests-{uuid.uuid4().hex}.bin"
    DigestFile.write(os.path.join(folder, name), rules)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row. A rule fits its host and all subdomains when
    the path starts with the rule's; the longest fitting rule decides, else `default`. A null url
    or one without `://` has empty host and path and the default verdict. Nothing is shuffled;
    the rules are bounded by MAX_RULES (`judge_by_join` has no bound)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: use judge_by_join")
    name = _publish(pages.sparkSession, rules)
    lengths = path_lengths(rules)
    id_type = pages.schema[id_col].dataType.simpleString()

    def judged(batches):
        index = DigestFile(SparkFiles.get(name))
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            keys, first = [], [0]
            for host, path in split:
                keys += [c.encode("utf-8", "surrogatepass") for c in candidates(host, path, lengths)]
                first.append(len(keys))
            found = index.find(keys)
            rule, verdict = [], []
            for a, b in zip(first, first[1:]):
                hits = np.flatnonzero(found[a:b] >= 0)
                at = a + int(hits[0]) if len(hits) else -1
                rule.append(keys[at].decode("utf-8", "surrogatepass") if at >= 0 else None)
                verdict.append(default if at < 0 else
                               "block" if index.block[found[at]] else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in split], pa.string()),
                 pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    schema = f"`{id_col}` {id_type}, host string, path string, rule string, verdict string"
    return pages.select(id_col, url_col).mapInArrow(judged, schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id",
                  url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same result for rule lists (verdict, host, path) of any length, by a shuffle join.

    Distinct (host, path) pairs are judged once; only their candidate texts meet the rules."""
    spark = pages.sparkSession
    texts = (rules.select(F.concat(F.lower("host"), "path").alias("rule"), "verdict")
             .groupBy("rule").agg(F.max("verdict").alias("verdict")))
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]

    @F.udf("struct<host:string,path:string>")
    def split(url):
        return split_url(url)

    @F.udf("array<string>")
    def fits(host, path):
        return candidates(host, path, lengths)

    rows = pages.select(F.col(id_col), split(url_col).alias("at")).select(id_col, "at.host", "at.path")
    tried = (rows.select("host", "path").distinct()
             .select("host", "path", F.posexplode(fits("host", "path")).alias("place", "rule")))
    best = (tried.join(texts, "rule").groupBy("host", "path")
            .agg(F.min_by(F.struct("rule", "verdict"), "place").alias("best")))
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
