"""Secret scans: patterns, and a battery of randomness tests under false-discovery control.

Base kinds, per whole text and leftmost without overlap: assign, access, hex (patterns below, offsets in code points).
Kind `random`: runs of 20 or more encoding characters whose encoding (digits, hex, base32, letters and digits, base64)
is inferred from the characters in use. A run with separators that isn't base64 is tested without them if it is hex (as
ids in groups are), and else by its parts of 20 or more letters and digits; shorter parts aren't tested and count for
nothing. Three tests must each be consistent with random text: chi-squared uniformity
over the encoding's alphabet, runs of symbols above and below the middle, and serial correlation. The p-value held
against false discoveries asks the contrary question, how likely words of ordinary language would look as uniform:
the lower tail of a non-central chi-squared whose non-centrality grows with length. Benjamini-Hochberg then works
within strata of similar length over all candidates of the corpus; only a table of counts by stratum and p-value
(bounded: strata x bins) reaches the driver.

Of short tokens a part is missed, since 20 random characters often look no more even than words do: among 2000 planted
tokens beside ordinary text the battery finds the shares given in tests/llm (20 characters: about 0.7; 32 and more: 0.95).

Null and empty texts have no spans. Repeated rows each get theirs; ids may be null. An empty table gives no rows.
Columns other than doc_id and text are ignored, or, by `redact`, kept as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Encoding: alphabet size, and the share of equal pairs of symbols in ordinary text written in it.
ENCODINGS = {"digits": (10, 0.18), "hex": (16, 0.13), "base32": (32, 0.075), "lower": (26, 0.065), "upper": (26, 0.065), "letters": (52, 0.06), "alnum": (62, 0.055), "base64": (64, 0.055)}
FALSE_DISCOVERIES, CONSISTENT = 0.01, 0.001
#: Strata are powers of two of the length; p-values are counted in bins of a quarter of a power of two.
_BINS, _STRATA = 256, 24


def encoding(s: str) -> str | None:
    """The narrowest encoding that explains the characters in use. Nothing is inferred without a digit in it, but for
    letters of both cases in disorder: a run of plain letters is a word."""
    digit, lower, upper = re.search("[0-9]", s), re.search("[a-z]", s), re.search("[A-Z]", s)
    if not re.search("[^0-9]", s):
        return "digits"
    if digit and not (re.search("[^0-9a-f]", s) and re.search("[^0-9A-F]", s)):
        return "hex"
    if digit and not re.search("[^A-Z2-7]", s):
        return "base32"
    if re.search("[+/_=-]", s.rstrip("=")):
        return "base64" if digit and lower and upper else None
    if digit:
        return "alnum"
    return "letters" if lower and upper and not s[1:].islower() else "upper" if upper and not lower else "lower"


def _normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(s: str) -> tuple[float, float]:
    """Probability that random text of the encoding looks less random than s in one of three tests (times three), and
    that ordinary text looks as uniform."""
    kind = encoding(s)
    if kind is None:
        return 0.0, 1.0
    k, equal = ENCODINGS[kind]
    s = s.rstrip("=")
    n = len(s)
    if n < 8:
        return 0.0, 1.0
    x2 = k / n * sum(c * c for c in Counter(s).values()) - n
    wilson = lambda x, df: ((max(x, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = _normal(wilson(x2, k - 1))
    order = sorted(map(ord, s))
    mid = order[n // 2]
    high = [ord(c) >= mid for c in s]
    up, turns = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * _normal(abs(turns - mean) / math.sqrt(var)) if var > 0 else 0.0
    v = list(map(ord, s))
    avg = sum(v) / n
    ss = sum((x - avg) ** 2 for x in v)
    r = sum((a - avg) * (b - avg) for a, b in zip(v, v[1:], strict=False)) / ss if ss else 1.0
    p_serial = 2 * _normal(abs(r + 1 / n) * math.sqrt(n))
    # Lower tail of the non-central chi-squared (Patnaik's two-moment form).
    away = n * (k * equal - 1)
    df = (k - 1 + away) ** 2 / (k - 1 + 2 * away)
    p_plain = 1 - _normal(wilson(x2 * df / (k - 1 + away), df))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial)), p_plain


def _bin(p: float) -> int:
    return min(_BINS - 1, int(-4 * math.log2(max(p, 1e-300))))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """start, end, stratum, bin of the p-value and whether the battery passes, for tokens that no base span covers."""
    out = []
    for m in TOKEN.finditer(text):
        for a, b, tested in pieces(m[0]):
            a, b = a + m.start(), b + m.start()
            if any(x < b and a < y for _, x, y in taken):
                continue
            fits, plain = battery(tested)
            out.append((a, b, min(_STRATA - 1, len(tested).bit_length()), _bin(plain), fits >= CONSISTENT))
    return out


def pieces(s: str) -> list[tuple[int, int, str]]:
    """Start, end and what is tested of a token: all of it, or its parts between separators."""
    if encoding(s) is not None:
        return [(0, len(s), s)]
    plain = re.sub("[+/_=-]", "", s)
    if len(plain) >= 20 and encoding(plain) in ("hex", "digits"):
        return [(0, len(s), plain)]
    return [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9]{20,}", s)]


_FOUND = "base array<struct<kind:string, start:int, end:int>>, tried array<struct<start:int, end:int, stratum:int, bin:int, fits:boolean>>"
_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TRIED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32()), ("fits", pa.bool_())]))
_ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, tried = [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            own = sorted(base_spans(text), key=lambda s: (s[1], _ORDER[s[0]]))
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            tried.append([dict(zip(("start", "end", "stratum", "bin", "fits"), c, strict=True)) for c in candidates(text, own)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(base, _BASE), pa.array(tried, _TRIED)], [*(c for c in batch.schema.names if c != "text"), "base", "tried"])


def thresholds(counts: list[tuple[int, int, int]], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per stratum the least bin of the p-value that Benjamini-Hochberg rejects (a bin counts as its largest p)."""
    out = {}
    for stratum in {s for s, _, _ in counts}:
        own = sorted(((b, n) for s, b, n in counts if s == stratum), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 2 ** (-b / 4) <= rate * seen / total:
                out[stratum] = b
    return out


def secret_spans(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), spans (kind, start, end; by start, then kind as listed)."""
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    h1, h2 = C.text_key(F.col("text"))
    found = C.materialize(rows.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(_scan, f"doc_id bigint, h1 bigint, h2 bigint, {_FOUND}"))
    counts = found.select(F.explode("tried").alias("t")).groupBy("t.stratum", "t.bin").count().collect()  # _STRATA x _BINS at most
    least = thresholds([tuple(r) for r in counts], rate)
    more = F.transform(F.filter("tried", lambda t: t["fits"] & _passing(t, least)), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    ranked = F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "h1", "h2", spans.alias("spans"))


def _passing(t, least: dict[int, int]):
    out = F.lit(False)
    for stratum, b in sorted(least.items()):
        out = out | ((t["stratum"] == stratum) & (t["bin"] >= b))
    return out


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _mask(batches: Iterator[pa.RecordBatch], marker: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, out = batch.column("row"), []
        names = [f.name for f in row.type]
        for t, spans in zip(row.field("text").cast(pa.string()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if t is None or not spans:
                out.append(t)
                continue
            at, parts = 0, []
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if b <= at:
                    continue
                parts += [t[at : max(a, at)], marker] if a >= at else []
                at = b
            out.append("".join([*parts, t[at:]]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else row.field(i) for i, c in enumerate(names)], names)


def redact(docs: DataFrame, marker: str = "<secret>") -> DataFrame:
    """docs with every span of its texts replaced by a marker (overlapping spans: one); other columns as they are."""
    found = secret_spans(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h1", "h2"])
    met = C.packed(docs).join(C.named(found), C.met(), "left").select("row", "spans")
    return C.materialize(met.mapInArrow(lambda batches: _mask(batches, marker), docs.schema))  # written here, in small Arrow batches


def query(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(C.table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
