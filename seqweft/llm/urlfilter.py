"""URL filters: a sorted digest array of 64-bit xxhash keys, memory-mapped, probed by binary search, confirmed by full strings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), *_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(s: bytes) -> int:
    return xxhash.xxh64_intdigest(s)


class DigestIndex:
    """Sorted uint64 digests of rule strings beside their strings, all in memory-mapped files of one folder-less prefix.

    A probe hashes each candidate, finds it by np.searchsorted, and compares the stored full string; equal digests of
    different strings stand side by side, and each is compared. Size: 17 bytes a rule and its string on each machine's
    disk; pages come into memory as they are probed.
    """

    PARTS = ("keys", "ends", "flags", "text")

    def __init__(self, paths: dict[str, str], lengths: list[int], digest=_digest):
        load = lambda k, t: np.memmap(paths[k], t, "r") if os.path.getsize(paths[k]) else np.zeros(0, t)
        self.keys, self.ends, self.flags, self.text = load("keys", "<u8"), load("ends", "<i8"), load("flags", "u1"), load("text", "u1")
        self.lengths, self.digest = lengths, digest

    @staticmethod
    def build(rules: list[tuple[str, str]], folder: str, digest=_digest) -> tuple[dict[str, str], list[int]]:
        """rules: (host + path, verdict). Returns the files by part and the distinct byte lengths of the paths."""
        made = sorted((digest(r.encode()), r.encode(), v) for r, v in dict(rules).items())
        arrays = {
            "keys": np.array([d for d, _, _ in made], "<u8"),
            "ends": np.cumsum([0, *(len(r) for _, r, _ in made)]).astype("<i8"),
            "flags": np.array([v == "block" for _, _, v in made], "u1"),
            "text": np.frombuffer(b"".join(r for _, r, _ in made), "u1"),
        }
        mark = uuid.uuid4().hex  # files sent to executors need names of their own
        paths = {k: os.path.join(folder, f"urls-{mark}-{k}.bin") for k in DigestIndex.PARTS}
        for k, a in arrays.items():
            a.tofile(paths[k])
        return paths, sorted({len(r[r.find(b"/") :]) if b"/" in r else 0 for _, r, _ in made})

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The rule's place for each candidate, or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        want = np.fromiter(map(self.digest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, want)
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want))
        for i in hits:
            k = at[i]
            while k < len(self.keys) and self.keys[k] == want[i]:
                if self.text[self.ends[k] : self.ends[k + 1]].tobytes() == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def rule(self, k: int) -> str:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes().decode()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", digest=_digest) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    rules: (host + path, "allow" or "block"), a list that the caller holds in the driver's memory, as rule files are.
    A rule fits its host and all subdomains if the url's path starts with the rule's path; of those that fit, the
    longest string wins, and of equally long ones the one with the longer host. Rules without a slash have an empty
    path. The index reaches executors as files (each keeps its own copy, as a new one does that replaces a lost one).
    Null, empty and odd urls have an empty host and path, no rule, and the default verdict. Rows are judged alone:
    repeated rows repeat.
    """
    spark: SparkSession = pages.sparkSession
    folder = os.path.realpath(tempfile.mkdtemp(prefix="urls-"))  # the driver serves the files from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    paths, lengths = DigestIndex.build(rules, folder, digest)
    for p in paths.values():
        spark.sparkContext.addFile(p)
    names = {k: os.path.basename(p) for k, p in paths.items()}
    parsed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))

    def probe(batches):
        index = DigestIndex({k: SparkFiles.get(n) for k, n in names.items()}, lengths, digest)
        for b in batches:
            hosts, urls = b.column("host").to_pylist(), b.column("path").to_pylist()
            candidates, owner, rank = [], [], []
            for i, (h, p) in enumerate(zip(hosts, urls, strict=True)):
                hb, pb = h.encode(), p.encode()
                start = 0
                while hb and start >= 0:
                    suffix = hb[start:]
                    for n in index.lengths:
                        if n <= len(pb):
                            candidates.append(suffix + pb[:n])
                            owner.append(i)
                            rank.append((len(suffix) + n, len(suffix)))
                    start = hb.find(b".", start) + 1 or -1
            best: dict[int, tuple] = {}
            found = index.find(candidates)
            for c in np.flatnonzero(found >= 0):
                best[owner[c]] = max(best.get(owner[c], ((-1, -1), -1)), (rank[c], int(found[c])))
            hit = [best[i][1] if i in best else -1 for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"), b.column("host"), b.column("path"),
                    pa.array([index.rule(k) if k >= 0 else None for k in hit], pa.string()),
                    pa.array([default if k < 0 else "block" if index.flags[k] else "allow" for k in hit], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(parsed.dtypes)["page_id"]
    return parsed.mapInArrow(probe, f"page_id {kind}, host string, path string, rule string, verdict string")
