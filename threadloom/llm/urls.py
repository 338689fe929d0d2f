"""Operator 4, URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: every pattern position is a bit,
a byte selects the mask of positions that it may fill, and wildcards are positions that a bit may
stay on. One pass over a canonical URL advances all patterns at once; a batch of URLs advances in
lockstep as rows of a word matrix. Only the url column is read and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts host from path in a canonical URL; it occurs in neither.
SEPARATOR = "\x00"
RESULT = "page_id long, host string, path string, rule string, verdict string"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


class WildcardAutomaton:
    """Patterns of literal bytes, ``?`` (one byte) and ``*`` (any bytes but the separator, also none);
    a backslash takes the next character literally. A pattern matches a prefix of the input."""

    def __init__(self, patterns: Sequence[str]) -> None:
        positions: list[set[int] | None] = []  # None: any byte but the separator
        starts, ends, loops, optional = [], [], [], []
        for pattern in patterns:
            starts.append(len(positions))
            positions.append(set())  # the state before the first byte
            if pattern[:1] == "*":
                loops.append(len(positions) - 1)
            k, raw = 0, pattern
            while k < len(raw):
                c = raw[k]
                if c == "*":
                    loops.append(len(positions) - 1)
                elif c == "?":
                    positions.append(None)
                else:
                    k += c == "\\"
                    positions += [{x} for x in raw[k].encode()]
                k += 1
            ends.append(len(positions) - 1)
        self.words = -(-len(positions) // 64) or 1

        def mask(bits: Sequence[int]) -> np.ndarray:
            out = np.zeros(self.words, np.uint64)
            for x in bits:
                out[x >> 6] |= np.uint64(1) << np.uint64(x & 63)
            return out

        self.start, self.ends, loop = mask(starts), ends, mask(loops)
        self.table = np.stack([mask([i for i, p in enumerate(positions) if (p is None and c) or (p is not None and c in p)]) for c in range(256)])
        self.loop = np.stack([loop if c else np.zeros_like(loop) for c in range(256)])
        self.accept = mask(ends)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by pattern."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(length) - length)[order]
        state = np.tile(self.start, (len(texts), 1))
        seen = state & self.accept
        live = length[order]
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-live, -k, side="left"))  # texts longer than k
            c = data[at[:n] + k]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.table[c]) | (now & self.loop[c])
            seen[:n] |= state[:n] & self.accept
            if not state[:n].any():
                break
        out = np.zeros((len(texts), len(self.ends)), bool)
        for j, e in enumerate(self.ends):
            out[order, j] = (seen[:, e >> 6] >> np.uint64(e & 63)) & np.uint64(1) != 0
        return out


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "\\*?" else c for c in text)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host between ``://`` and the next ``/``, ``?`` or ``#`` with A-Z lower-cased; the path after it
    up to ``?`` or ``#``. Both are empty without ``://``."""
    rest = (url or "").partition("://")[2]
    end = min((x for x in (rest.find("?"), rest.find("#")) if x >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.encode("utf-8", "replace").lower().decode(), slash + path


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A rule fits its host and all subdomains where the path starts with the rule's; of several that
    fit, the longest name wins, then the first. Where none fits, rule is null and the verdict is
    ``default``. Null urls have an empty host and path. Very long urls, repeated rows and empty tables
    need no special case; other columns are ignored.
    """
    rules = sorted(rules, key=lambda r: -len(r.name))
    # a leading dot makes "host or subdomain" one suffix test; the loop can't leave the host
    automaton = WildcardAutomaton([f"*.{escaped(r.host)}{SEPARATOR}{escaped(r.path)}" for r in rules])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = [host_and_path(u) for u in b.column(1).to_pylist()]
            fits = automaton.matches([f".{h.replace(SEPARATOR, ' ')}{SEPARATOR}{p.replace(SEPARATOR, ' ')}".encode("utf-8", "replace") for h, p in parts])
            first = np.where(fits.any(1), fits.argmax(1), -1).tolist() if rules else [-1] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[k] for x in parts], pa.string()) for k in (0, 1)), pa.array([rules[k].name if k >= 0 else None for k in first], pa.string()), pa.array([rules[k].verdict if k >= 0 else default for k in first], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, RESULT)


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN regexp_matches(rest, '^[^/?#]*/') THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, h.host, h.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""
