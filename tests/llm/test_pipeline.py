"""The corpus pipeline as a whole and stage by stage, on a small corpus with nulls, ties, copies and repeated ids."""

import random
import re

import pytest

import corpus_pipeline as pipeline
from nestwright.llm import packing, quality_classifier, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(500)]
    good = lambda n=80: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    bad = lambda: " ".join(r.choice(["BUY###", "$$$", "NOW!!", "***", "%%%"]) for _ in range(60)) + str(r.random())
    rows = [(i, good() if i % 3 else bad()) for i in range(150)]
    items = [(i, good(30)) for i in range(4)]
    rows += [(200, rows[1][1]), (201, rows[2][1] + " more"), (202, good() + " " + items[0][1] + " " + good()), (203, "password=abcd12345678 " + good()), (204, None), (205, ""), (206, items[1][1].upper()), (207, good(1500)), (1, good()), (1, rows[1][1]), (None, good()), (None, good())]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def words(t, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def one_of_each(rows):
    """The rows that stay, by brute force: of each component the least id, nulls last; a repeat of a row goes."""
    sets, keep = [], []
    for _, t in rows:
        w = words(t, r"[^\x20\x09-\x0d]+")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset({tuple(w)} if w else ()))
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    for c in {find(i) for i in range(len(rows))}:
        keep.append(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if find(i) == c))
    return sorted(keep)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"] and pipeline.ORACLE_SQL is None
    scored = {(x.doc_id, x.score) for x in quality_classifier.scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    docs = pipeline.materialize(stage["quality"](spark, docs, folder))
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(i) for i, s in scored if s >= 0.5) == sorted({str(i) for i, _ in rows}) and {i for i, _ in rows if i is not None and i < 150} == {i for i in range(150) if i % 3}
    docs = pipeline.materialize(stage["near_duplicates"](spark, docs, folder))
    want = one_of_each(rows)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted((i is None, i or 0) for i, _ in rows) == want and len(want) > 90
    docs = pipeline.materialize(stage["decontamination"](spark, docs, folder))
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    pattern = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = {" ".join(w[i : i + 10]) for x in items for w in [words(x.text, pattern)] for i in range(len(w) - 9)}
    clean = [(i, t) for i, t in rows if not any(f" {w} " in f" {' '.join(words(t, pattern))} " for w in windows)]
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(rows, key=str) == sorted(clean, key=str) and not {202, 206} & {i for i, _ in rows}
    docs = pipeline.materialize(stage["secret_scan"](spark, docs, folder))
    masked = {x.doc_id: x.text for x in docs.collect()}
    assert len(rows) == docs.count() and masked[203] == "<secret>" + dict(rows)[203][21:]
    assert all(masked[i] == t for i, t in rows if i not in (203, None, 1) and not secrets.candidates(t or "", []))
    packed = stage["best_fit_packing"](spark, docs, folder).collect()
    ids = packing.Ids()
    assert sum(x.length for x in packed) == sum(len(ids(x.text or "")) + 1 for x in docs.collect())


def test_run_is_its_stages(spark, folder):
    got = pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = got.collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, folder))
    want = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    key = lambda x: (str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
