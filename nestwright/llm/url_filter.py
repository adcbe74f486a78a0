"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Host and path are cut out of the URL in DataFrame functions; a rule fits its host and all subdomains if the path starts
with the rule's, and the longest rule wins. URLs without a rule are judged by the model. It is trained on the driver from
a small labelled table, which is an argument; `sample_table` makes one by a rule from lists of words. N-grams don't cross
the ends of the words of host and path. A quarter of the table (by the URL's hash) is held out: the bar from which a URL
is blocked is the least risk, LEAST_BAR or more, that lets through every held-out URL labelled as good, and what it
catches of the others is measured. The weights (2 to the BITS) travel in the closure.

Null URLs and URLs without `://` have an empty host and path and no rule; the model allows what it knows nothing about.
Without a labelled URL of both kinds everything without a rule is allowed. Repeated rows fare alike, an empty table gives
no rows, and columns other than page_id and url are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

#: (verdict, rule); a rule is host/path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
BITS, NGRAMS, ROUNDS, RATE, PENALTY = 14, (3, 4, 5), 400, 4.0, 1e-4
#: No URL is blocked below this risk, however well the held-out URLs are told apart.
LEAST_BAR = 0.5
#: Words of the sample table: what unwanted sites are about, what ordinary ones are, and what stands beside either.
UNWANTED = "casino poker bets betting jackpot slots roulette lottery pills viagra cialis pharmacy adult xxx porn sex escort cams nude dating spam linkfarm warez crack keygen torrent malware phishing loans payday replica diet prize clickbait bitcoin".split()
ORDINARY = "library museum river garden history science weather recipes music travel school news health football city council forum wiki docs physics poetry railway harbour bakery bicycle theatre journal university kitchen forest village astronomy".split()
BESIDE = "online best free cheap win fast hot farm hub zone x now club top world shop plus daily my the net site 24 deals live".split()
_SYLLABLES = "ra ti on the er sha lin mo ve dor an is ke tu pel or en ga fi ns th st ing ed".split()


def sample_table(rows: int = 1200, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled URLs made by a rule: hosts of one topic's word with a word that stands beside any topic (for ordinary
    sites also names without meaning), on any subdomain and top domain, with paths that say nothing or the topic."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        bad = i % 2
        word = r.choice(UNWANTED if bad else ORDINARY)
        if not bad and i % 4 == 0:
            word = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4)))
        beside = r.choice(BESIDE)
        name = r.choice([f"{word}-{beside}", f"{beside}-{word}", f"{word}{beside}", word, f"{beside}-{word}-{r.choice(BESIDE)}"])
        host = r.choice(["", "", "www.", "m.", "blog.", "en."]) + name + r.choice([".example.com", ".example.org", ".example.net", ".com", ".org", ".net", ".info"])
        path = r.choice(["", "/", f"/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(1, 9999)}", f"/{word}/{r.randint(1, 99)}.html", f"/{r.choice(BESIDE)}/{word}", f"/{r.choice(['page', 'article', 'index', 'post'])}{r.randint(1, 99)}.html?page=2"])
        out.append((f"{r.choice(['http', 'https'])}://{host}{path}", bad))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Buckets of the distinct n-grams of the words of host and path, and of the words themselves."""
    found = set()
    for kind, text in (("h", host), ("p", path)):
        for word in re.findall(r"[^\W_]+", text.lower()):
            marked = f"^{word}$"
            found.add(f"{kind}{marked}")
            found.update(f"{kind}{marked[i : i + n]}" for n in NGRAMS for i in range(len(marked) - n + 1))
    buckets = sorted({zlib.crc32(g.encode()) >> (32 - bits) for g in found})
    return np.array(buckets, np.int64)


def cut(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.lower(), slash + path


@dataclass
class Model:
    """Weights by bucket, the bias last; the bar; and what the bar does to held-out URLs."""

    weights: np.ndarray
    bits: int = BITS
    bar: float = 1.0
    held_out: int = 0
    caught: float = 0.0
    blocked_by_mistake: float = 0.0

    def risk(self, host: str, path: str) -> float:
        r = grams(host, path, self.bits)
        return float(1 / (1 + np.exp(-(self.weights[r].sum() / np.sqrt(max(len(r), 1)) + self.weights[-1]))))


def train(labelled: list[tuple[str, int]], bits: int = BITS) -> Model:
    """Label 1 is unwanted. Every fourth URL by hash isn't learnt from: the bar is chosen and measured on these."""
    held = [(u, y) for u, y in labelled if zlib.crc32(u.encode()) % 4 == 0]
    known = [(u, y) for u, y in labelled if zlib.crc32(u.encode()) % 4]
    model = Model(np.zeros((1 << bits) + 1), bits)
    if len({y for _, y in known}) < 2:
        return model
    rows = [grams(*cut(u), bits) for u, _ in known]
    y, w = np.array([v for _, v in known], float), model.weights
    sizes = np.array([max(len(r), 1) for r in rows])
    flat, owner, scale = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), 1 / np.sqrt(sizes)
    for _ in range(ROUNDS):
        raw = np.bincount(owner, weights=w[flat], minlength=len(rows)) * scale + w[-1]
        off = (1 / (1 + np.exp(-raw)) - y) / len(rows)
        w[:-1] -= RATE * (np.bincount(flat, weights=(off * scale)[owner], minlength=1 << bits) + PENALTY * w[:-1])
        w[-1] -= RATE * off.sum()
    risks = [(model.risk(*cut(u)), v) for u, v in held]
    good, bad = [p for p, v in risks if not v], [p for p, v in risks if v]
    model.bar = max([LEAST_BAR, *(np.nextafter(p, 1) for p in good)])
    model.held_out = len(held)
    model.caught = sum(p >= model.bar for p in bad) / max(len(bad), 1)
    model.blocked_by_mistake = sum(p >= model.bar for p in good) / max(len(good), 1)
    return model


def _judged(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, risks = [], []
            for verdict, host, path in zip(*(batch.column(c).to_pylist() for c in ("verdict", "host", "path")), strict=True):
                risk = None
                if verdict is None:
                    risk = model.risk(host, path)
                    verdict = "block" if (host or path) and risk >= model.bar else "allow"
                verdicts.append(verdict), risks.append(risk)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(risks, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "risk"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, risk (the model's, where no rule fits)."""
    rows = C.void_safe(pages, {"page_id": "bigint", "url": "string"})
    host, path = parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    return ruled.mapInArrow(_judged(train(sample_table() if labelled is None else labelled)), "page_id bigint, host string, path string, rule string, verdict string, risk double")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"))
