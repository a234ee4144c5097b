"""Secret scans: known forms, and strings of high entropy per character class.

Known forms are three patterns. Beyond them, every run of token characters is
a candidate; a window slides over it and its Shannon entropy is kept up to date
from the counts of the character that enters and the one that leaves. Windows
above their class's limit are joined into a span, unless an allow-list entry
covers the candidate (identifiers, links, words, plain numbers).

Spans are code points, end exclusive, as ``kind:start:end``.

Cases: null and empty texts have no spans; a form that fails its length test is
dropped after it has consumed its text; spans of different kinds may overlap,
spans of one kind never do; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship

#: The known forms, and the least length of what they match.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Its order is that of equal starts.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Every match of ASSIGN ends in one of these letters before its sign, whatever the case.
_KEYS = re.compile(r"""(?:[Dd]|[Tt]|[Nn]|[Yy])["']?\x20*[:=]""")

WINDOW = 20
#: Bits per character above which a window is taken for random, by class.
LIMITS = {"hex": 3.2, "base64": 3.9}
#: Candidates that are no secrets: UUIDs, links and paths, dates and numbers, dashes and dots.
ALLOW = tuple(re.compile(p) for p in (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"/?/[a-z0-9.-]+\.[a-z]{2,}(/.*)?", r"[0-9.+/_=-]+", r"[A-Za-z]+([-_./][A-Za-z]+)*[.]?"))
_TOKEN = np.zeros(128, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_HEX_RUN = re.compile(r"[0-9a-fA-F]+")
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_SHARE = [0.0] + [k / WINDOW * log2(k / WINDOW) for k in range(1, WINDOW + 1)]

Span = tuple[int, int, str]


def candidates(text: str, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` token characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    mask = np.zeros(len(codes) + 2, bool)
    low = codes < 128
    mask[1:-1][low] = _TOKEN[codes[low]]
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def windows_above(run: str, limit: float) -> Iterator[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is above ``limit`` bits a character."""
    counts: dict[str, int] = {}
    entropy, start, end = 0.0, -1, -1
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        counts[c] = k + 1
        entropy += _SHARE[k] - _SHARE[k + 1]
        if i >= WINDOW - 1:
            if entropy > limit:
                if start < 0 or i - WINDOW + 1 > end:
                    if start >= 0:
                        yield start, end
                    start = i - WINDOW + 1
                end = i + 1
            out = run[i - WINDOW + 1]
            k = counts[out]
            counts[out] = k - 1
            entropy += _SHARE[k] - _SHARE[k - 1]
    if start >= 0:
        yield start, end


def known(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    found = []
    if ("=" in text or ":" in text) and _KEYS.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, b in runs:  # what these two match never reaches beyond a run of token characters
        part = text[a:b]
        if "AKIA" in part:
            found += [(a + m.start(), a + m.end(), "access") for m in ACCESS.finditer(part) if len(m[0]) >= LEAST["access"]]
        if b - a >= LEAST["hex"]:
            found += [(a + m.start(), a + m.end(), "hex") for m in HEX.finditer(part) if len(m[0]) >= LEAST["hex"]]
    return found


def random_strings(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    found = []
    for a, b in runs:
        part = text[a:b]
        if b - a < WINDOW or any(p.fullmatch(part) for p in ALLOW):
            continue
        for kind, limit, pattern in (("entropy_hex", LIMITS["hex"], _HEX_RUN), ("entropy_base64", LIMITS["base64"], _BASE64_RUN)):
            for m in pattern.finditer(part):
                if len(m[0]) >= WINDOW and not m[0].isalpha():
                    found += [(a + m.start() + s, a + m.start() + e, kind) for s, e in windows_above(m[0], limit)]
    return found


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Known forms, and all spans; both by start, then kind as listed."""
    if not text:
        return [], []
    runs = candidates(text, LEAST["access"])
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(known(text, runs), key=order)
    return base, sorted(base + random_strings(text, runs), key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SECRETS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(text: Column) -> Column:
    @F.pandas_udf(SECRETS)
    def udf(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            base, spans = scan(text)
            kinds = [kind for *_, kind in base]
            out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return udf.asNondeterministic()(text)


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or chain of overlapping spans, replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            _, spans = scan(text)
            if not spans:
                out.append(text)
                continue
            parts, at = [], 0
            for start, end, _ in spans:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return udf.asNondeterministic()(text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per row of ``docs``."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), secrets(F.col(text_col)).alias("s")).select("doc_id", "s.*")
