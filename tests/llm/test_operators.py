"""Operators against brute force on small texts with nulls, empties, copies, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from nestwright.llm import chat_format, decontaminate, exact_substrings, near_dedup, packing, quality_classifier, quality_rules, secrets, sentence_dedup, url_filter

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
SCHEMA = "doc_id bigint, text string, lang string, h1 string, node int, n int, words string"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 8))) for _ in range(300)]
    sentence = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 12))).capitalize() + "."
    shared = " ".join(sentence() for _ in range(8))
    texts = [" ".join(sentence() for _ in range(r.randint(1, 20))) for _ in range(n)]
    texts += [texts[0], texts[1] + " extra words here", shared + " " + texts[2], texts[3] + "\n" + shared, None, "", " ", "one", "a b", "Ab " * 400, texts[4] * 30]
    return [(i, t, "en", "x", 1, 2, "w") for i, t in enumerate(texts)] + [(0, texts[0], "en", "x", 1, 2, "w"), (None, texts[5], None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(put, rows):
    return put(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(put):
    return put([], SCHEMA)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())


def test_near_duplicates(docs, rows, none):
    sets = []
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset({tuple(w)} if w else ()))
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(r[0] for i, r in enumerate(rows) if r[0] == least.get(find(i))))
    assert near_dedup.near_duplicates(none).count() == 0


def test_keep_first_of_null_and_repeated_ids(put):
    r = random.Random(9)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    # Different texts without an id or under one id are components of their own; near copies and repeats aren't.
    docs = [(None, a, 0), (None, b, 1), (None, b, 2), (None, c, 3), (7, c + " more", 4), (1, d, 5), (1, e, 6), (1, e, 7), (2, e + " more", 8), (None, None, 9), (None, "", 10), (None, " ", 11), (3, "", 12), (3, "", 13), (4, "", 14), (5, f, 15), (5, g, 16), (6, g, 17)]
    kept = Counter((x.doc_id, x.text) for x in near_dedup.keep_first(put(docs, "doc_id bigint, text string, n int")).collect())
    assert kept == Counter([(None, a), (None, b), (7, c + " more"), (1, d), (1, e), (None, None), (None, ""), (None, " "), (3, ""), (4, ""), (5, f), (5, g)])


def test_components_settle_or_raise(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError):
        near_dedup.components(links, 2)
    assert {tuple(x) for x in near_dedup.components(links).collect()} == {(i, 0) for i in range(1, 41)}


def covered(texts, size):
    count = Counter(t[s : s + size] for t in texts for s in range(len(t) - size + 1))
    for t in texts:
        mark = bytearray(len(t))
        for s in range(len(t) - size + 1):
            if count[t[s : s + size]] > 1:
                mark[s : s + size] = b"\1" * size
        yield mark


def test_exact_substrings(docs, rows, none):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, mark, near in zip(rows, texts, covered(texts, 400), covered(texts, 256), strict=True):
        runs = len(re.findall(b"\1+", bytes(mark)))
        want[r[0], len(t), sum(mark), runs, sha(bytes(b for b, m in zip(t, mark, strict=True) if not m)), sum(near)] += 1
    total = lambda spans: sum(s.end - s.start for s in spans)
    got = exact_substrings.dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, total(r.removed), len(r.removed), sha(bytes(r.kept)), total(r.repeated)) for r in got) == want
    assert exact_substrings.dedup_substrings(none).count() == 0


def test_exact_substrings_refined(put):
    """Near copies with many edits, and a long period, so that buckets are refined down to single windows."""
    r, text = random.Random(6), fresh(6)
    base = text(300)
    texts = [base]
    for _ in range(12):
        t = list(base)
        for _ in range(r.randint(1, 12)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t[r.randint(0, 300) :]))
    texts += ["abc" * 500, "x" * 399, "y" * 400, "y" * 401, base[:400], base[:399], text(70) + base[700:1101]]
    raw = [t.encode() for t in texts]
    want = {i: (sum(a), sum(b)) for i, (a, b) in enumerate(zip(covered(raw, 400), covered(raw, 256), strict=True))}
    total = lambda spans: sum(s.end - s.start for s in spans)
    got = exact_substrings.dedup_substrings(put(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {x.doc_id: (total(x.removed), total(x.repeated)) for x in got} == want
    with pytest.raises(ValueError):
        exact_substrings.dedup_substrings(put([], "doc_id bigint, text string"), 100, 200)


def test_sentence_dedup(docs, none):
    got = {r.doc_id: r for r in sentence_dedup.dedup_sentences(docs).collect()}
    assert got[60].text.strip() == ""  # a copy of document 0
    assert got[0].n_removed == 0
    assert got[62].removed[0].start > 0  # the shared passage stays where it is first
    assert got[63].n_removed >= 7
    assert got[64].n_sentences == got[65].n_sentences == 0
    assert sentence_dedup.dedup_sentences(none).count() == 0


def fresh(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    return lambda n, stop=0.0: " ".join(word() + ("." if r.random() < stop else "") for _ in range(n))


def test_passages_from_mid_sentence(put):
    """51 words or more, cut anywhere out of texts with many stops, few or none, are caught; what is met once is not."""
    text, rows, want = fresh(4), [], set()
    for i in range(60):
        stop = (0.0, 0.03, 0.1, 0.4)[i % 4]
        passage = text(51 + i % 10, stop)
        rows += [(2 * i, f"{text(30, stop)} {passage} {text(30, stop)}"), (2 * i + 1, f"{text(17, stop)} {passage} {text(45, stop)}")]
        want.add(2 * i + 1)
    rows += [(200 + i, text(80, 0.1)) for i in range(20)]
    got = {x.doc_id: x for x in sentence_dedup.dedup_sentences(put(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, x in got.items() if x.n_removed} == want
    assert all(24 <= got[i].n_removed_words <= 60 for i in want)
    spam = [(0, "buy now " * 90), (1, "now " * 200), (2, "now " * 90), (3, "short"), (4, "short"), (5, "word!! " * 70), (6, "x word!! " + "word!! " * 99)]
    got = {x.doc_id: x for x in sentence_dedup.dedup_sentences(put(spam, "doc_id bigint, text string")).collect()}
    assert got[2].text == "" and got[4].text == "" and got[6].n_removed_words > 90
    assert got[0].n_removed_words >= 120 and got[1].n_removed_words > 150  # inside themselves


def test_sentences_are_cut_alike():
    text = fresh(9)
    passage = text(60, 0.05)
    cut = []
    for around in (text(9), text(20), ""):
        data = np.frombuffer(f"{around} {passage} {around}".encode(), np.uint8)
        a, b, _, _, _ = sentence_dedup.sentences(data, np.array([0, len(data)]))
        at = len(around) + 1
        cut.append({x - at for x in b.tolist() if 60 < x - at < len(passage) - 60})
    assert cut[0] == cut[1] == cut[2] and len(cut[0]) > 4


def test_sentence_dedup_by_brute_force(docs, rows):
    """Every run of every document in plain Python: what isn't first goes."""
    rows = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    runs, parts = {}, {}
    for d, (_, t) in enumerate(rows):
        data = np.frombuffer(t.encode(), np.uint8)
        a, b, _, _, _ = sentence_dedup.sentences(sentence_dedup.C.LOWER[data], np.array([0, len(data)]))
        own = parts[d] = [words(t.encode()[x:y].decode()) for x, y in zip(a, b, strict=True)]
        assert [w for s in own for w in s] == words(t)
        assert all(s[-1][-1:] in b".!?" or i + 1 == len(own) or len(own) > 1 for i, s in enumerate(own))
        n = list(map(len, own))
        for i in range(len(own)):
            fits = [next((x for x in range(2, len(own) - j + 1) if sum(n[j : j + x]) >= 24), 0) for j in (i, i + 1)]
            for size in {fits[0] or (0 if i else len(own)), len(own) - i if fits[0] and not fits[1] else 0} - {0}:
                runs.setdefault(tuple(w.lower() for s in own[i : i + size] for w in s), []).append((d, i, size))
    gone = {(d, j) for places in runs.values() for d, i, x in sorted(places)[1:] for j in range(i, i + x)}
    want = {(rows[d][0], len(own), sum((d, j) in gone for j in range(len(own))), sum(len(own[j]) for j in range(len(own)) if (d, j) in gone)) for d, own in parts.items()}
    got = sentence_dedup.dedup_sentences(docs).collect()
    assert {(x.doc_id, x.n_sentences, x.n_removed, x.n_removed_words) for x in got} == want


def test_secrets(put, docs, none):
    r = np.random.default_rng(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    keys = ["".join(r.choice(alphabet, 48)) for _ in range(20)]
    texts = ["password=abcd1234 ſecret=abcd12345 Token: 'short' é", "é AKIAABCDEFGHIJKL x", "0123456789abcdef0123456789abcdef", None, "", *(f"é text {k} more" for k in keys), "the_quick_brown_fox_jumps_over_the_lazy_dog " * 3]
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in secrets.secret_spans(put(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0] == [("assign", 0, 17)]
    assert got[1] == [("access", 2, 18)]
    assert got[2] == [("hex", 0, 32)]
    assert got[3] == got[4] == got[len(texts) - 1] == []
    found = sum(("random", 7, 55) in got[5 + i] for i in range(20))
    assert found >= 12
    out = secrets.redact(put([(0, texts[0], 7), (1, None, 8)], "doc_id bigint, text string, spans int")).orderBy("doc_id").collect()
    assert out[0].text.startswith("<secret> ") and out[1].text is None and out[0].spans == 7
    assert secrets.secret_spans(none).count() == 0


def test_packing(docs, rows, none):
    got = packing.packed(docs, 64).collect()
    ids = packing.Ids()
    assert sum(r.length for r in got) == sum(len(ids(r[1] or "")) + 1 for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert packing.packed(none).count() == 0


def test_packing_ids_are_the_tokenizers(rows):
    """Both encoders against Tokenizer.encode, id by id; special tokens in a text are ordinary characters."""
    from tokenizers import Tokenizer

    ids = packing.Ids()
    whole = Tokenizer.from_file(ids.path)
    whole.encode_special_tokens = True
    r = random.Random(8)
    kinds = ["plain text, it's 1234567 words.", "  spaces \t\r\n\n  lines ", "Straße œuvre ĳ ſ Ωμέγα Привет — “x” 10€", "日本語 \u0301e ﬁ ١٢٣", "\u00a0\u2003\u200b\ufeff", "🙂👩‍👩‍👧", "x" * 2500, "=" * 1999, "a<|endoftext|>b", "", " ", "\x00\x1c\x85"]
    pool = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(161, 384), *range(913, 1104), 0x2014, 0x201C, 0x20AC, 0x4E2D, 0x1F642)]
    texts = kinds + [x[1] or "" for x in rows] + ["".join(r.choice(pool[: r.choice((100, 320, len(pool)))]) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    fast = [ids.odd(t) is None for t in texts]
    assert sum(fast) > 100 and sum(not x for x in fast) > 100
    for t in texts:
        assert ids(t) == whole.encode(t, add_special_tokens=False).ids, t


def test_quality_rules(docs, rows, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        count, mark = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [0] * len(w)
        for i in range(len(w) - 7):
            if count[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(mark), len(w) < 20 or 100 * sum(mark) > 30 * len(w)] += 1
    assert got == want
    assert quality_rules.judge(none).count() == 0


def test_chat_format(put):
    turns = [(1, 0, "system", "Be [brief] <s>"), *((1, i, "user" if i % 2 else "assistant", f"turn {i} \\b \\ [/INST]\n" * (i % 9)) for i in range(1, 90)), (2, 0, None, None), (None, 1, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    frame = put([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, window string")
    formatted = chat_format.windows(frame, 100, 40)
    got = {r.conv_id: r for r in chat_format.digest(chat_format.read_back(formatted)).collect()}
    for c in (1, 2, 3, None):
        own = [(t[2] or "", t[3] or "") for t in turns if t[0] == c]
        loss = "".join(x for role, x in own if role == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    windows = [r for r in formatted.collect() if r.conv_id == 1]
    assert len(windows) > 3 and all(w.formatted.startswith("[INST]system\n") for w in windows)
    assert any(w.n_repeated > 1 for w in windows)
    assert chat_format.windows(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [20_000, 1])
def test_decontaminate(docs, rows, none, put, most):
    low = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(0, " ".join(low(rows[2][1])[3:20])), (1, "one"), (2, None), (3, "a b"), (4, "nowhere to be found at all in any of these texts")]
    windows = {}
    for i, t in items:
        w = low(t)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    want = Counter()
    for r in rows:
        w, mark, found = low(r[1]), [0] * len(low(r[1])), set()
        for x, ids in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    mark[s : s + len(x)], found = [1] * len(x), found | ids
        if found:
            want[r[0], sum(mark), len(found), tuple(sorted(map(str, found)))] += 1
    frame = put(items, "item_id bigint, text string")
    spans = decontaminate.hits(docs, frame, 10, most)
    assert {r.doc_id for r in spans.collect()} == {k[0] for k in want}
    if most > 1:
        got = decontaminate.judged(docs, frame).collect()
        assert {(r.doc_id, r.n_hit, r.n_items, tuple(r.item_ids)) for r in got} == set(want)
        assert decontaminate.decontaminate(docs, frame).count() == len(rows) - sum(want.values())
        assert decontaminate.decontaminate(none, frame).count() == 0


def test_quality_classifier(put, docs, none):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["river", "stone", "the", "of", "and", "light."]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY###", "$$$", "NOW!!", "***"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    labels = put([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    got = quality_classifier.scores(put(rows, "doc_id bigint, text string"), labels).collect()
    assert sum(x.predicted == x.doc_id % 2 for x in got if x.held_out) > 0.95 * sum(x.held_out for x in got)
    assert all(0 <= x.score <= 1 for x in quality_classifier.scores(docs, labels.limit(0)).collect())
    assert quality_classifier.scores(none, labels).count() == 0
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def test_url_filter(put):
    urls = ["http://www.EXAMPLE.com/en/x?y", "http://a.example.com/en/", "http://b.com/", "http://x.net/es/q", "http://notcom", None, "nothing", "http://free-casino.example.org/xxx/viagra-casino-bonus", "http://wiki.example.org/en/page/river", "http://com"]
    got = {r.page_id: r for r in url_filter.judge(put(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "allow", "block"]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/x") and (got[5].host, got[6].path) == ("", "")
    assert got[7].verdict == "block" and got[8].verdict == "allow" and got[5].verdict == "allow"
