"""URL rules in a sorted digest array.

Every rule (host + path prefix) is hashed with 64-bit xxhash; the sorted keys
and the rule strings are written once to the shared folder and shipped to the
executors as files, which tasks map into memory. A URL asks for every
(parent domain, path prefix) pair that a rule of a stored length could have;
the questions of a whole batch are answered by one vectorised binary search,
and every hit is confirmed against the stored string, so a hash collision can
never decide.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value, shared_folder

by_value(__name__)

SCHEMA = "key {key}, url string, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, up to / ? # or the end, A-Z lower-cased) and
    path (from there up to ? # or the end); both empty without ://."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if end is None else (rest[:end.start()], rest[end.start():])
    host = re.sub(r"[A-Z]+", lambda m: m[0].lower(), host)
    return host, re.split(r"[?#]", tail, maxsplit=1)[0]


def _digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), dtype=np.uint64, count=len(strings))


def build_index(rules: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Sorted digests with, in the same order, the rule bytes (one buffer and
    offsets) and verdict codes; and the distinct path lengths, by which a
    URL's path is cut into questions. ``rules``: (verdict, host/path)."""
    texts = [r.encode() for _, r in rules]
    if any(b"/" not in t for t in texts):
        raise ValueError("a rule is host/path, such as example.com/en/")
    if len(set(texts)) < len(texts):
        raise ValueError("a rule is listed twice")
    keys = _digests(texts)
    order = np.argsort(keys, kind="stable")
    ordered = [texts[i] for i in order]
    lengths = sorted({len(r.partition("/")[2]) + 1 for _, r in rules})
    return {"keys": keys[order], "ends": np.cumsum([len(t) for t in ordered], dtype=np.int64),
            "bytes": np.frombuffer(b"".join(ordered), dtype=np.uint8),
            "block": np.array([rules[i][0] == "block" for i in order], dtype=bool),
            "lengths": np.array(lengths, dtype=np.int64)}


def ship_index(spark: SparkSession, index: dict[str, np.ndarray]) -> str:
    """Write the arrays to the shared folder and let every executor fetch
    them. The rules come from the caller's own memory, which bounds them."""
    folder = shared_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    tag = folder.rpartition("-")[2]
    for name, array in index.items():
        buffer = io.BytesIO()
        np.save(buffer, array)
        file = f"{folder}/urls-{tag}-{name}.npy"
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(file))
        out.write(bytearray(buffer.getvalue()))
        out.close()
        spark.sparkContext.addFile(file)
    return tag


def _open(tag: str) -> dict[str, np.ndarray]:
    load = lambda n: np.load(SparkFiles.get(f"urls-{tag}-{n}.npy"), mmap_mode="r")
    return {n: load(n) for n in ("keys", "ends", "bytes", "block", "lengths")}


def questions(host: str, path: str, lengths: list[int]) -> list[str]:
    """Rules that would fit, longest first (the longer host first in a tie):
    the host and each of its parent domains with each path prefix whose
    length some rule has."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    found = [(len(h) + n, len(h), h + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [q for *_, q in sorted(found, key=lambda f: (-f[0], -f[1]))]


def probe(index: dict[str, np.ndarray], asked: list[str]) -> np.ndarray:
    """Position of each asked string in the index, -1 where it is not stored."""
    keys, ends, stored = index["keys"], index["ends"], index["bytes"]
    raw = [a.encode() for a in asked]
    wanted = _digests(raw)
    at = np.searchsorted(keys, wanted, side="left")
    found = np.full(len(asked), -1, dtype=np.int64)
    for i in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else []):
        j = int(at[i])
        while j < len(keys) and keys[j] == wanted[i]:  # equal digests: the string decides
            if stored[ends[j - 1] if j else 0:ends[j]].tobytes() == raw[i]:
                found[i] = j
                break
            j += 1
    return found


def judge(docs: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """(key, url, host, path, rule, verdict) of every row: the longest fitting
    rule decides; a URL that no stored rule fits gets ``default`` (the array
    is a list of exceptions). A rule fits its host and all subdomains if the
    path starts with the rule's.

    Null URLs and URLs without :// have empty host and path and fit no rule.
    Repeated rows are judged each; empty tables give no rows; other columns
    are not read. A very long URL asks at most labels x rule lengths times."""
    spark = docs.sparkSession
    tag = ship_index(spark, build_index(rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _open(tag)
        lengths = [int(n) for n in index["lengths"]]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            asked = [questions(h, p, lengths) for h, p in parts]
            flat = [q for qs in asked for q in qs]
            hits = probe(index, flat)
            fits, verdicts, at = [], [], 0
            for qs in asked:
                hit = next((i for i in range(at, at + len(qs)) if hits[i] >= 0), None)
                at += len(qs)
                fits.append(None if hit is None else flat[hit])
                verdicts.append(default if hit is None else "block" if index["block"][hits[hit]] else "allow")
            host, path = ([p[i] for p in parts] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.string()) for x in (host, path, fits, verdicts))],
                names=["key", "url", "host", "path", "rule", "verdict"])

    rows = docs.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    schema = SCHEMA.format(key=rows.schema["key"].dataType.simpleString())
    return rows.mapInArrow(judged, schema).withColumnRenamed("key", key)
