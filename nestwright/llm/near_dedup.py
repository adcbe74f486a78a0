"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct word shingles (words between ASCII spaces, A-Z lower-cased). Documents with
equal sets are one class, so copies never meet in a join. Classes get MinHash samples; rows of samples form bands,
and folding one-permutation samples into a parity bitmap gives an odd sketch. Candidates come from the bands: every class is
held against the least class of its bucket (a star, linear in the bucket), then, where a bucket still holds several
components, against members of the largest of them, drawn anew in a few more rounds; classes that are in different components after that though they share a bucket are held
against each other, those outside of a bucket's largest component against all of it. Where that is many pairs it is done
in rounds, each with a part of these classes and with the components joined anew. The number of ones in the XOR of two sketches estimates their similarity and rejects the hopeless; the rest is confirmed on full sets.

Nulls and empty texts have an empty set, are linked with nothing and are their own component. Repeated rows share a
class and a component. A text of fewer words than a shingle is one shingle. Extra columns are ignored by the
membership and kept by `keep_first`. An empty table gives no rows. Ids may repeat or be null: a component is told by its root class, not by its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestwright.llm import common as C

SHINGLE, SIMILARITY = 5, 75
#: 48 bands of 5 samples lose a pair of similarity 0.75 with odds of 2 in a million.
BANDS, ROWS = 48, 5
#: Samples folded into a sketch (2 to the power), its bits, and the deviations of the estimate that are allowed for.
BIN_BITS, SKETCH_BITS, DEVIATIONS = 11, 2048, 4.4
#: Rounds of stars, the centres drawn for each bucket in a round, and the rows up to which the classes to confirm are broadcast.
STAR_ROUNDS, CENTRES, BROADCAST_ROWS = 1, 3, 200_000
#: Pairs that one task may have to look at in a round of what the stars have left.
PAIRS_A_TASK = 1_000_000
_SAMPLES = BANDS * ROWS
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**31, _SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, _SAMPLES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one document after another, and their offsets."""
    low = C.LOWER[data]
    starts, ends, doc = C.words(low, offsets)
    hashes = C.span_hashes(low, starts, ends)
    at, value = C.run_hashes(hashes, doc, k)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(offsets) - 1)
    for d in np.flatnonzero((count > 0) & (count < k)):  # one shingle of all its words
        own = hashes[np.searchsorted(doc, d, "left") : np.searchsorted(doc, d, "right")]
        _, whole = C.run_hashes(own, np.zeros(len(own), np.int64), len(own))
        owner, value = np.append(owner, d), np.append(value, C.mix(whole + np.uint64(len(own))))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def samples(value: np.ndarray) -> np.ndarray:
    """The MinHash samples of one set."""
    low = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    out = np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096]
        for i in range(0, _SAMPLES, 16):
            out[i : i + 16] = np.minimum(out[i : i + 16], (part[None, :] * _A[i : i + 16, None] + _B[i : i + 16, None]).min(axis=1))
    return out


def sketch(value: np.ndarray) -> tuple[np.ndarray, int]:
    """Parity bitmap, as 64-bit words, of one-permutation MinHash samples (the least hash of each bin), and their number."""
    bins = value >> np.uint64(64 - BIN_BITS)
    least = value[np.append(True, bins[1:] != bins[:-1])]  # value is sorted
    odd = np.bincount((C.mix(least) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), len(least)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = C.powers(0xD1342543DE82EF95, ROWS)
        for batch, data, offsets in C.sliced(batches):
            value, at = shingle_sets(data, offsets, k)
            nodes, bands, marks = [], [], []
            for i in range(len(batch)):
                own = value[at[i] : at[i + 1]]
                if not len(own):
                    nodes.append(None), bands.append(None), marks.append((None, 0))
                    continue
                pair = [C.mix(own ^ np.uint64(s)).sum(dtype=np.uint64) + np.uint64(len(own)) for s in (0x1234567, 0xABCDEF01)]
                nodes.append(np.array(pair, np.uint64).tobytes())
                sampled = samples(own)
                rows = (sampled.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * scale
                bands.append(C.mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                marks.append(sketch(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([m for m, _ in marks], pa.list_(pa.int64())), pa.array([n for _, n in marks], pa.int32())], ["doc_id", "n_shingles", "node", "bands", "sketch", "bins"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in C.sliced(batches):
            value, at = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([value[at[i] : at[i + 1]].view(np.int64) for i in range(len(batch))], pa.list_(pa.int64()))], ["node", "items"])

    return run


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, node (the class: a 128-bit digest of the set; null if empty), bands, sketch."""
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    return rows.mapInArrow(_signatures(k), "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>, bins int")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node that links reach) for every node in links (a, b). Alternates large and small stars
    on written tables until nothing changes (an error after so many rounds); each star is a grouped minimum and a join,
    with no group collected."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = C.by(both, "a").agg(F.min("b").alias("m")).select("key.a", F.least("m", "key.a").alias("m"))
        met = both.join(least, "a")
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    edges = C.materialize(links.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        old, edges = edges, C.materialize(star(star(edges, True), False))
        C.release(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _plausible(x: str, y: str, similarity: int) -> Column:
    """Sizes allow the similarity, and the XOR of the sketches doesn't speak against it: of the bins that sets of these
    sizes and this similarity fill together, that share holds the same sample in both; the sets differ in all other
    samples, and the number of ones in the XOR estimates in how many they do."""
    of = lambda c: (F.col(f"{c}_{x}"), F.col(f"{c}_{y}"))
    (n1, n2), (a, b), (s1, s2), j, total = of("n"), of("bins"), of("sketch"), similarity / 100, float(1 << BIN_BITS)
    ones = sum((F.bit_count(F.get(s1, F.lit(i)).bitwiseXOR(F.get(s2, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    both = j * (n1 + n2) / (1 + j)
    filled = (a + b + (n2 - both) * (1 - a / total) + (n1 - both) * (1 - b / total)) / 2
    most = F.greatest(a + b - 2 * j * filled, F.lit(0.0))
    thinned = F.greatest(1 - filled * (1 + j) / (n1 + n2), F.lit(0.02))  # near 0 if nearly all of both sets are samples
    varies = 4 * filled * j * (1 - j) * thinned + 4 * j * j * F.greatest(n1 - both, n2 - both, F.lit(0.0)) * filled / total + SKETCH_BITS / 4 * (F.exp(4 * most / SKETCH_BITS) - 1 - 4 * most / SKETCH_BITS)
    differ = -SKETCH_BITS / 2 * F.log(F.greatest(1 - 2 * ones / SKETCH_BITS, F.lit(1e-3)))
    return (F.lit(100) * F.least(n1, n2) >= F.lit(similarity) * F.greatest(n1, n2)) & (differ <= most + DEVIATIONS * F.sqrt(varies) + 1)


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similarity: int, k: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = C.materialize(reps.join(wanted, "node").select("node", "doc_id", "h1", "h2"))
    if chosen.count() <= BROADCAST_ROWS:  # 48 bytes each; beyond that the texts are shuffled
        chosen = F.broadcast(chosen)
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    h1, h2 = C.text_key(F.col("text"))
    held = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2")).alias("d").join(chosen.alias("c"), (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("d.h1") == F.col("c.h1")) & (F.col("d.h2") == F.col("c.h2")))
    sets = C.materialize(held.select("node", "text").mapInArrow(_sets(k), "node binary, items array<bigint>").dropDuplicates(["node"]))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return C.materialize(met.where(F.lit(100) * shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), n_shingles, component_id: one row per row of docs. Ids of a component are
    joined by links of at least `similarity` per cent; component_id is the least doc_id among them."""
    return _placed(docs, similarity, k).drop("root")


def _placed(docs: DataFrame, similarity: int, k: int) -> DataFrame:
    """near_duplicates with the root of each row's component (null for an empty set)."""
    with C.scratch() as keep:
        return _joined(docs, similarity, k, keep)


def _joined(docs: DataFrame, similarity: int, k: int, keep: list[DataFrame]) -> DataFrame:
    rows = C.void_safe(docs, {"doc_id": "bigint", "text": "string"})
    h1, h2 = C.text_key(F.col("text"))
    keyed = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    made = keyed.mapInArrow(_keyed(k), "doc_id bigint, h1 bigint, h2 bigint, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>, bins int")
    signed = C.materialize(made)
    first = F.min(F.struct("doc_id", "h1", "h2"))
    classes = C.materialize(signed.where("node is not null").groupBy("node").agg(first.alias("f"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("bins").alias("bins"), F.first("n_shingles").alias("n")).select("node", "least", "f.*", "bands", "sketch", "bins", "n"))
    reps = classes.select("node", "doc_id", "h1", "h2")
    banded = classes.select("node", F.explode("bands").alias("band"))
    crowds = C.by(banded, "band").agg(F.count("*").alias("n"), F.min("node").alias("lo")).where("n > 1").select("key.band", "lo")
    members = C.materialize(banded.join(crowds, "band"))
    marks = classes.select("node", "n", "bins", "sketch")

    def judged(pairs: DataFrame) -> DataFrame:
        of = lambda c: marks.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "bins", "sketch")))
        return C.materialize(pairs.join(of("a"), "a").join(of("b"), "b").where(_plausible("a", "b", similarity)).select("a", "b"))

    def held(roots: DataFrame, buckets: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components, with their roots."""
        placed = buckets.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(1)).alias("size"))
        mixed = C.by(placed, "band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key.band")
        return C.materialize(placed.join(mixed, "band"))

    def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
        """roots (node, root, n: classes of the component) after more links, by joining components instead of classes."""
        if roots is None:
            found = components(links)
        else:
            ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}r")) for c in "ab"]
            met = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
            moved = C.materialize(components(met))
            kept = roots.select("node", "root").join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            found = kept.unionByName(moved.select("node", "root").join(roots.select("node"), "node", "left_anti"))
        found = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
        return C.materialize(found.join(C.by(found, "root").agg(F.count("*").alias("n")).select("key.root", "n"), "root").select("node", "root", "n"))

    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = members.where("node <> lo").select(F.col("node").alias("b"), F.col("lo").alias("a")).distinct()
    roots = merged(None, _confirmed(judged(stars), docs, reps, similarity, k))
    open_ = held(roots, members)
    for turn in range(STAR_ROUNDS):
        if open_.isEmpty():
            break
        # In each bucket members of its largest component, drawn anew, against the members of all others.
        by = lambda i: F.struct(F.col("size"), F.col("root"), F.xxhash64("band", "node", F.lit(turn), F.lit(i)))
        centre = C.by(open_, "band").agg(*(F.max_by(F.struct("node", "root"), by(i)).alias(f"c{i}") for i in range(CENTRES))).select("key.band", *(f"c{i}" for i in range(CENTRES)))
        met = open_.join(centre, "band").where("c0.root <> root").select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array(*(F.col(f"c{i}.node") for i in range(CENTRES))))).alias("b")).select(*ordered).distinct()
        roots = merged(roots, _confirmed(judged(met), docs, reps, similarity, k))
        open_ = held(roots, open_)
    # What is left: in each bucket the classes outside of its largest component against all others, in rounds by class.
    sizes = C.by(open_, "band", "root").agg(F.count("*").alias("n")).select("key.band", "key.root", "n")
    most = C.by(sizes, "band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("held")).select("key.band", F.col("m.root").alias("major"), "held")
    rest = C.materialize(open_.join(most, "band").select("band", "node", (F.col("root") == F.col("major")).alias("major"), "held"))
    pairs = rest.where("not major").agg(F.sum("held")).first()[0] or 0
    rounds = -(-pairs // (PAIRS_A_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for turn in range(rounds):
        todo = held(roots, rest).join(rest.select("band", "node", "major"), ["band", "node"])
        mine = ~F.col("major") & (F.pmod(F.xxhash64("node"), F.lit(rounds)) == turn)
        x, y = (todo.where(mine if s == "x" else F.lit(True)).join(classes.select("node", "n", "bins", "sketch", "bands"), "node").select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "major", "n", "bins", "sketch", "bands"))) for s in "xy")
        shared = F.element_at(F.filter(F.zip_with("bands_x", "bands_y", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), 1)  # a pair meets in its first bucket only
        once = F.col("major_y") | (F.col("node_x") < F.col("node_y"))
        across = x.join(y, "band").where(once & (F.col("root_x") != F.col("root_y")) & _plausible("x", "y", similarity) & (F.col("band") == shared))
        found = C.materialize(across.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")))
        roots = merged(roots, _confirmed(found, docs, reps, similarity, k))
    keep += [signed, classes, roots]
    whole = roots.select("node", "root")
    joined = classes.select("node", "least").join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = C.by(joined, "root").agg(F.min("least").alias("component_id")).select("key.root", "component_id")
    ids = joined.join(least, "root").select("node", "root", "component_id")
    out = signed.select("doc_id", "h1", "h2", "n_shingles", "node").join(ids, "node", "left")
    return out.select("doc_id", "h1", "h2", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def _keyed(k: int):
    inner = _signatures(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in C.sliced(batches):
            for got in inner(iter([batch])):
                yield pa.RecordBatch.from_arrays([got.column(0), batch.column("h1"), batch.column("h2"), *got.columns[1:]], ["doc_id", "h1", "h2", *got.schema.names[1:]])

    return run


def keep_first(docs: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row stays, that with the least doc_id (null ids
    last), then the least hashes of the text. Rows with an empty set all stay but for repeats of an id with its text.
    All columns are kept."""
    found = _placed(docs, similarity, k)
    least = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("f")).select("f.*")
    empty = found.where("root is null").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2").distinct()
    names = least.select("doc_id", "h1", "h2", F.lit(False).alias("lone")).unionByName(empty.select("doc_id", "h1", "h2", F.col("no_id").alias("lone")))
    kept = C.packed(docs).join(C.named(names), C.met())
    copies = kept.where("not lone").groupBy("k_id", "k_h1", "k_h2").count().where("count > 1")
    if not copies.isEmpty():
        # Empty texts without an id are nobody's copies: each gets a number, so that none shares its window with another.
        number = F.when(F.col("lone"), F.monotonically_increasing_id())
        row = Window.partitionBy("k_id", "h1", "h2", "number").orderBy("h1")
        kept = kept.withColumn("number", number).withColumn("at", F.row_number().over(row)).where("at = 1")
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
