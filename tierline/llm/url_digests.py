"""URL filter over a sorted digest array.

The rules' keys (host and path written together) are hashed with 64-bit xxhash and kept as one sorted array, which
each worker memory-maps. A URL is looked up under all keys that could fit it: each suffix of its host at a dot, with
each prefix of its path as long as some rule's path. One vectorised binary search probes all keys of a batch; a found
digest counts only if the stored full key is equal, so collisions cannot decide. The longest key wins.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the default verdict. Repeated
rows are judged alike. Rules with a null host or path are ignored; of equal keys, ``block`` wins.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rules beyond this many bytes of keys are not sent to the workers but joined (``judge_by_join``).
ARRAY_BYTES = 64 << 20


def split_url(url):
    """(host, path) columns of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


class DigestArray:
    """Sorted digests in a memory-mapped file, with the full keys and verdicts beside them."""

    def __init__(self, keys: list[str], verdicts: list[str], hasher=xxhash.xxh64_intdigest):
        self.hasher = hasher
        digests = np.fromiter((hasher(k) for k in keys), np.uint64, len(keys))
        order = np.argsort(digests, kind="stable")
        self.digests = digests[order]
        self.keys = [keys[i] for i in order]
        self.verdicts = [verdicts[i] for i in order]
        self.path_lengths = sorted({len(k) - len(k.partition("/")[0]) for k in keys})
        self._mapped = None

    def __getstate__(self):
        return self.__dict__ | {"_mapped": None}

    def mapped(self) -> np.ndarray:
        """The digests, mapped from a nameless file of this worker; it is made anew from the broadcast if lost."""
        if self._mapped is None and len(self.digests):
            with tempfile.TemporaryFile() as file:
                file.write(self.digests.tobytes())
                file.flush()
                self._mapped = np.memmap(file, np.uint64, "r", shape=self.digests.shape)
        return self.digests if self._mapped is None else self._mapped

    def find(self, probes: list[str]) -> np.ndarray:
        """For each probe the place of its key, or -1."""
        digests, known = np.fromiter(map(self.hasher, probes), np.uint64, len(probes)), self.mapped()
        at = np.searchsorted(known, digests)
        found = np.full(len(probes), -1)
        for i in np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == digests) if len(known) else []):
            j = at[i]
            while j < len(known) and known[j] == digests[i]:
                if self.keys[j] == probes[i]:
                    found[i] = j
                    break
                j += 1
        return found


def url_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """All keys that fit, longest first for a given host."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return [h + path[:n] for h in hosts for n in lengths if n <= len(path)]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``rules``: (host, path, verdict). They are sent to the workers as one array while their keys hold at most
    ``ARRAY_BYTES``; a larger set goes through ``judge_by_join``.
    """
    host, path = split_url(F.col("__url"))
    urls = pages.select("page_id", F.col("url").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    clean = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(F.concat("host", "path").alias("key"), "verdict")
        .groupBy("key")
        .agg(F.max("verdict").alias("verdict"))
    )
    if (clean.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0) > ARRAY_BYTES:
        return judge_by_join(urls, clean, default)
    rows = clean.collect()
    array = pages.sparkSession.sparkContext.broadcast(DigestArray([r.key for r in rows], [r.verdict for r in rows]))

    @F.pandas_udf("rule string, verdict string")
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known, probes, owner = array.value, [], []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            keys = url_keys(h, p, known.path_lengths) if h else []
            probes += keys
            owner += [i] * len(keys)
        best = [(None, default)] * len(hosts)
        for k in np.flatnonzero((found := known.find(probes)) >= 0):
            i, key = owner[k], probes[k]
            if best[i][0] is None or len(key) > len(best[i][0]):
                best[i] = (key, known.verdicts[found[k]])
        return pd.DataFrame(best, columns=["rule", "verdict"])

    return urls.withColumn("found", look_up("host", "path")).select(
        "page_id", "host", "path", "found.rule", "found.verdict"
    )


def judge_by_join(urls: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    """The same over a rule set of any size: probes meet keys by (digest, key) in a join, spread over all tasks.

    Few distinct (host, path) pairs may own most rows, so each pair is looked up once.
    """
    lengths = keys.select((F.length("key") - F.length(F.substring_index("key", "/", 1))).alias("n")).distinct()
    sizes = [r.n for r in lengths.collect()]  # as many as there are lengths of paths
    host_parts = F.split("host", r"\.", -1)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(host_parts)),
        lambda i: F.array_join(F.slice(host_parts, i, F.size(host_parts)), "."),
    )
    distinct = urls.where("host != ''").select("host", "path").distinct()
    probes = (
        distinct.withColumn("h", F.explode(hosts))
        .withColumn("n", F.explode(F.array(*map(F.lit, sizes))))
        .where("n <= length(path)")
        .withColumn("key", F.expr("concat(h, substring(path, 1, n))"))
        .withColumn("digest", F.xxhash64("key"))
    )
    best = (
        probes.join(keys.withColumn("digest", F.xxhash64("key")), ["digest", "key"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.length("key")).alias("found"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )
