"""URL filters by a memory-mapped array of sorted digests.

A rule is a host and a path: it fits its host and all subdomains, where the url's
path starts with the rule's; of several the longest wins (host and path together,
then the longer host; a rule that is listed with both verdicts blocks). Rules are kept as a sorted array of 64-bit xxhash keys of
``host/path`` with their full strings beside them. A url is tried with each of its
host's suffixes and each prefix of its path that is as long as some rule's path;
these keys are looked up by vectorised binary search, and a hit counts only if the
stored string is equal, so that collisions do no harm. A url that no rule fits gets
the method's verdict: allow.

Scale: no shuffle. An array goes to the executors as bytes, up to ``MAX_BYTES``; each
worker writes it to an unlinked file and maps that, so nothing stays behind. A larger
rule list makes several arrays; a url is judged by one after another, and the longest
rule of all wins. Only as many of a host's suffixes are tried as some rule has labels,
so time and memory are linear in a url's length.

Edge cases: a null url, or one without ``://``, has an empty host and path and no
rule. Ports and user parts belong to the host. Repeated rows are each judged. An
empty rule list allows everything.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the arrays that are sent to every executor.
MAX_BYTES = 256 << 20
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([len(rest), *(i for i in (rest.find("?"), rest.find("#")) if i >= 0)])
    slash = rest.find("/", 0, end)
    host = rest[: end if slash < 0 else slash].translate(_UPPER)
    return host, "" if slash < 0 else rest[slash:end]


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """Header, path lengths, sorted keys, string offsets and strings (each rule with its verdict's first letter before it)."""
    rules = list(rules)
    known = sorted({(xxhash.xxh64_intdigest((h + p).encode()), (v[0] + h + p).encode()) for h, p, v in rules})
    lengths = np.array(sorted({len(p) for _, p, _ in rules}), np.int64)
    keys = np.array([k for k, _ in known], np.uint64)
    offsets = np.cumsum([0] + [len(s) for _, s in known]).astype(np.int64)
    labels = max((h.count(".") + 1 for h, _, _ in rules), default=0)
    out = np.array([len(lengths), len(keys), labels], np.int64).tobytes() + lengths.tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(s for _, s in known)
    return out


def arrays(rules: Iterable[tuple[str, str, str]], max_bytes: int = MAX_BYTES) -> list[bytes]:
    """The arrays of a rule list, none of more than ``max_bytes`` (but for a single longer rule)."""
    out, part, size = [], [], 0
    for rule in rules:
        # key, offset, verdict and string; the lengths of paths count as if each were another
        n = 25 + len((rule[0] + rule[1]).encode())
        if part and size + n > max_bytes - 24:
            out.append(build(part))
            part, size = [], 0
        part.append(rule)
        size += n
    return [*out, build(part)]


class Filter:
    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        m, n, self.labels = np.frombuffer(self.map, np.int64, 3).tolist()
        self.lengths = np.frombuffer(self.map, np.int64, m, 24).tolist()
        self.keys = np.frombuffer(self.map, np.uint64, n, 24 + 8 * m)
        self.offsets = np.frombuffer(self.map, np.int64, n + 1, 24 + 8 * (m + n))
        self.base = 24 + 8 * (m + 2 * n + 1)

    def _stored(self, k: int) -> bytes:
        return self.map[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        split = [parts(u) for u in urls]
        owner, tries = [], []
        for i, (host, path) in enumerate(split):
            # the suffixes that some rule can equal, longest first
            cut = host.rsplit(".", self.labels)
            suffix = ".".join(cut[-self.labels :]) if self.labels else ""
            while suffix:
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(i)
                        tries.append((suffix + path[:n], len(suffix)))
                _, dot, suffix = suffix.partition(".")
        best: dict[int, tuple[int, int, str, str]] = {}
        if tries and len(self.keys):
            probe = np.array([xxhash.xxh64_intdigest(s.encode()) for s, _ in tries], np.uint64)
            at = np.searchsorted(self.keys, probe)
            for t in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe).tolist():
                k, (s, h), raw = int(at[t]), tries[t], tries[t][0].encode()
                while k < len(self.keys) and self.keys[k] == probe[t]:
                    stored = self._stored(k)
                    if stored[1:] == raw:
                        found = (len(s), h, s, "allow" if stored[:1] == b"a" else "block")
                        best[owner[t]] = max(best.get(owner[t], found), found)
                    k += 1
        return [(h, p, best[i][2] if i in best else None, best[i][3] if i in best else "allow") for i, (h, p) in enumerate(split)]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def with_array(df: DataFrame, data) -> DataFrame:
        def run(batches):
            judged = Filter(data.value)
            for batch in batches:
                if batch.num_rows:
                    host, path, rule, verdict = map(list, zip(*judged.judge(batch.column(1).to_pylist())))
                    for k, (had, said) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                        # "block" is the greater verdict
                        if had is not None and (rule[k] is None or (len(had), _host(had), said) > (len(rule[k]), _host(rule[k]), verdict[k])):
                            rule[k], verdict[k] = had, said
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in (rule, verdict, host, path))], names=["page_id", "url", "rule", "verdict", "host", "path"])

        return df.select("page_id", "url", "rule", "verdict").mapInArrow(run, f"page_id {kind}, url string, rule string, verdict string, host string, path string")

    for array in arrays(rules, max_bytes):
        pages = with_array(pages, pages.sparkSession.sparkContext.broadcast(array))
    return pages.select("page_id", "host", "path", "rule", "verdict")


def _host(rule: str) -> int:
    return len(rule.partition("/")[0])


#: The same in DuckDB, for tests: rules as rows, no digests.
ORACLE_SQL = """
with rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
bare as (select page_id, regexp_extract(rest, '^[^?#]*') as rest from cut),
split as (select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path from bare),
hit as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select s.page_id, s.host, s.path, hit.rule, coalesce(hit.v, 'allow') as verdict from split s left join hit on s.page_id = hit.page_id
"""
