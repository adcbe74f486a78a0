"""Substring dedup over sliding sentence spans.

A sentence ends at a word that ends in . ! or ?, before a line break, or with the text; and, so that text without stops
has sentences too and that a passage quoted from mid-sentence meets its source, at words chosen by content: those whose
hash is the least among the REACH words on either side (of equal words each is). Equal passages are so cut at the same
places but for REACH words at their ends.

From every sentence the shortest run of two sentences or more that reaches `least_words` words is hashed (128 bits, A-Z
lower-cased); the last one of a document goes on to its end, and a document that doesn't reach them is one run. No run
is dropped. A run that occurs more than once stays at its first place (least doc_id, then
place) and takes all its sentences out elsewhere. What stays of a repeat: the words at its ends that belong to sentences
it holds in part, at most one sentence more at its end, and all of it where its whole sentences have fewer than `least_words` words.

Null and empty texts have no sentences. Of repeated rows (equal id and text) the rows can't be told apart, so they are
one document. Null ids come first. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm import common as C

#: Sentences and words that a run has at least, and the words on either side that a content-defined end looks at.
SENTENCES, LEAST_WORDS, REACH = 2, 24, 5
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_KEY = ("doc_id", "h1", "h2")


def least_around(value: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Whether each value is the least of its document within `reach` places on either side; ties are."""
    out = np.ones(len(value), bool)
    for s in range(1, min(reach, len(value) - 1) + 1):
        near = doc[s:] == doc[:-s]
        out[s:] &= ~near | (value[s:] <= value[:-s])
        out[:-s] &= ~near | (value[:-s] <= value[s:])
    return out


def sentences(data: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """Start, end, document and number of words of each sentence, and a hash of every word. data: A-Z lower-cased."""
    starts, ends, doc = C.words(data, offsets)
    if not len(starts):
        return starts, ends, doc, starts, np.zeros(0, np.uint64)
    hashes = C.span_hashes(data, starts, ends)
    lines = np.cumsum(data == 10)
    last = least_around(hashes, doc, reach) | _END[data[ends - 1]]
    last[:-1] |= (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[ends[:-1] - 1])
    last[-1] = True
    stop = np.flatnonzero(last)
    first = np.append(0, stop[:-1] + 1)
    return starts[first], ends[stop], doc[first], stop - first + 1, hashes


def runs_of(words: np.ndarray, doc: np.ndarray, k: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and size of every run."""
    at, sums = np.arange(len(words)), np.append(0, np.cumsum(words))
    first, end = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    to = np.maximum(np.searchsorted(sums, sums[:-1] + least_words), at + k)
    fits = to <= end
    use = fits | (at == first)
    last = np.flatnonzero(fits & ~np.append(fits[1:] & (doc[1:] == doc[:-1]), False)) if len(doc) else at  # goes on to the end as well
    last = last[to[last] < end[last]]
    return np.append(at[use], last), np.append(np.minimum(to, end)[use] - at[use], end[last] - last)


def word_run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words from start to end of each run."""
    out = []
    for base, salt in ((C.BASE, 0xA5A5A5A5A5A5A5A5), (0xD1342543DE82EF95, 0x5851F42D4C957F2D)):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(C.mix(hashes ^ np.uint64(salt)) * C.powers(base, len(hashes)), out=sums[1:])
        back = C.powers(pow(base, -1, 2**64), len(hashes) + 1)
        out.append(C.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out[0], out[1]


def _hashed(k: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.sliced(batches):
            _, _, doc, words, hashes = sentences(C.LOWER[data], offsets)
            at, size = runs_of(words, doc, k, least_words)
            sums = np.append(0, np.cumsum(words))
            f0, f1 = word_run_hashes(hashes, sums[at], sums[at + size])
            d = doc[at]
            take = pa.array(d)
            place = at - np.searchsorted(doc, np.arange(len(batch)))[d]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in _KEY), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(f0.view(np.int64)), pa.array(f1.view(np.int64))], [*_KEY, "at", "size", "f0", "f1"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch, data, offsets in C.sliced(batches):
        a, b, doc, words, _ = sentences(C.LOWER[data], offsets)
        first = np.searchsorted(doc, np.arange(len(batch) + 1))
        n, gone, n_words, removed, kept = [], [], [], [], []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            own = data[offsets[i] : offsets[i + 1]].tobytes()
            s, e = a[first[i] : first[i + 1]] - offsets[i], b[first[i] : first[i + 1]] - offsets[i]
            out = np.zeros(len(s), bool)
            for r in runs or ():
                out[r["at"] : r["at"] + r["size"]] = True
            cut = np.flatnonzero(out & ~np.append(False, out[:-1])), np.flatnonzero(out & ~np.append(out[1:], False))
            spans = [(int(s[x]), int(s[y + 1]) if y + 1 < len(s) else len(own)) for x, y in zip(*cut, strict=True)]
            edges = [0, *(x for p in spans for x in p), len(own)]
            n.append(len(s)), gone.append(int(out.sum())), n_words.append(int(words[first[i] : first[i + 1]][out].sum()))
            removed.append([{"start": x, "end": y} for x, y in spans])
            kept.append(b"".join(own[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, n_words)), pa.array(removed, spans_type), pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "n_removed_words", "removed", "text"])


def dedup_sentences(docs: DataFrame, k: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences), n_removed_words, removed (byte spans), text (what is left)."""
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    h1, h2 = C.text_key(F.col("text"))
    keyed = rows.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    runs = C.materialize(keyed.mapInArrow(_hashed(k, least_words), "doc_id bigint, h1 bigint, h2 bigint, at int, size int, f0 bigint, f1 bigint"))
    # Of equal ids the place of the first text is the first place; -1 stands for a null id.
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    least = C.materialize(runs.groupBy("f0", "f1").agg(F.count("*").alias("n"), F.min(order).alias("d0")).where("n > 1").select("f0", "f1", "d0"))
    met = C.materialize(runs.join(least, ["f0", "f1"]))
    # The first document may hold a run twice, or share its id with another text: settled among those rows alone.
    inside = met.where(order == F.col("d0"))
    first = C.by(inside, "f0", "f1").agg(F.min(F.struct("h1", "at")).alias("x")).select("key.f0", "key.f1", F.col("x.h1").alias("x1"), F.col("x.at").alias("x0"))
    later = inside.join(first, ["f0", "f1"]).where("h1 <> x1 or at <> x0")
    gone = met.where(order != F.col("d0")).select(*_KEY, "at", "size").unionByName(later.select(*_KEY, "at", "size"))
    of_doc = C.materialize(gone.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "size")).alias("runs")))  # at most a document's length
    C.release(runs, least, met)
    d, o = keyed.alias("d"), of_doc.alias("o")
    on = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h1") == F.col("o.h1")) & (F.col("d.h2") == F.col("o.h2"))
    return d.join(o, on, "left").select("d.doc_id", "d.text", "o.runs").mapInArrow(_cut, "doc_id bigint, n_sentences bigint, n_removed bigint, n_removed_words bigint, removed array<struct<start:bigint, end:bigint>>, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_sentences(C.table(spark, sf_dir, "documents"))
