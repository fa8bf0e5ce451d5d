"""URL filters: one trie over reversed host labels, then path segments.

The rules are a bounded configuration (``MAX_RULES``, checked). The trie is broadcast
once; each worker walks it per url, deepest fitting rule first, so a longer host
beats a shorter one and, at equal hosts, a longer path beats a shorter one, whether
the rules allow or block. A rule fits its host and all subdomains when the url's
path starts with the rule's path (its last segment may be a prefix).

Edge cases: a null url, or one without ``://``, has empty host and path; no rule fits
an empty host; urls that no rule fits get the method's verdict (``allow``); repeated
rows are judged alike and all returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values, the rules of the registered query.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
MAX_RULES = 1_000_000
DEFAULT = "allow"

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HOST = re.compile("[^/?#]*")
_PATH = re.compile("[^?#]*")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = _HOST.match(rest)[0]
    return host.translate(_LOWER), _PATH.match(rest, len(host))[0]


class Trie:
    """Nodes are ``[children by host label, children by path segment, rules that end here]``."""

    def __init__(self, rules):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} may be broadcast")
        self.root = [{}, {}, []]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node[0].setdefault(label, [{}, {}, []])
            *whole, last = path.split("/")
            for segment in whole:
                node = node[1].setdefault(segment, [{}, {}, []])
            node[2].append((last, host.lower() + path, verdict))
            node[2].sort(key=lambda r: -len(r[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """``(rule, verdict)`` of the longest fitting rule."""
        if not host:
            return None
        hosts, node = [], self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for i, segment in enumerate(segments):
                # Rules ending here: all earlier segments fit; the last may be a prefix.
                tail = segment if i == len(segments) - 1 else segment + "/"
                best = next(((rule, v) for last, rule, v in node[2] if tail.startswith(last)), best)
                node = node[1].get(segment)
                if node is None or i == len(segments) - 1:
                    break
            if best:
                return best
        return None


def judge_urls(pages: DataFrame, rules=None, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with one more column ``_judged`` (host, path, rule, verdict)."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(RULES if rules is None else rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for urls in batches:
            rows = []
            for url in urls:
                host, path = parts(url if isinstance(url, str) else None)
                rule, verdict = find(host, path) or (None, default)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.withColumn("_judged", judged(F.col(url_col)))
