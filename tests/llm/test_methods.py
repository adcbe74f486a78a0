"""Parts of the methods against plain Python: verdicts, models, windows, places in sequences, and odd tables."""

import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from nestwright.llm import chat_format, common, decontaminate, exact_substrings, near_dedup, packing, quality_classifier, quality_rules, secrets, sentence_dedup, url_filter

CLASHES = "row string, id string, key string, k_id int, h1 string, k_h1 string, spans string, at int, number int, lone int, node int, root int, band int, words string, __id int"


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return lambda n: " ".join(r.choice(vocabulary) for _ in range(n))


def clashing(rows):
    return [(*r, "r", "i", "k", 1, "h", "h", "s", 1, 1, 1, 1, 1, 1, "w", 1) for r in rows]


def test_columns_that_clash(put):
    text = texts()
    rows = [(0, text(60)), (1, text(60)), (2, None), (3, ""), (None, text(50)), (4, "password=abcd1234567 " + text(30))]
    rows += [rows[0], (7, rows[0][1])]
    docs = put(clashing(rows), f"doc_id bigint, text string, {CLASHES}")
    items = put([(0, rows[1][1][:80])], "item_id bigint, text string")
    labels = put([(0, 1)], "doc_id bigint, quality int")
    made = {"redact": secrets.redact(docs), "keep_first": near_dedup.keep_first(docs), "decontaminate": decontaminate.decontaminate(docs, items), "keep_good": quality_classifier.keep_good(docs, labels, least=0.0)}
    for name, out in made.items():
        assert out.columns == docs.columns, name
        assert all(r["row"] == "r" and r["__id"] == 1 for r in out.collect()), name
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in made["decontaminate"].collect()) == [-1, 0, 0, 2, 3, 4, 7]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in made["keep_first"].collect()) == [-1, 0, 1, 2, 3, 4]
    assert [r.text[:9] for r in made["redact"].collect() if r.doc_id == 4] == ["<secret> "]
    for f in (sentence_dedup.dedup_sentences, exact_substrings.dedup_substrings, quality_rules.judge, packing.packed, secrets.secret_spans, near_dedup.near_duplicates):
        assert f(docs).count() >= len(rows)


def test_session_is_left_as_it_was(spark, put):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    spark.conf.set(names[0], "777")
    sentence_dedup.dedup_sentences(put([(1, "a b c")], "doc_id bigint, text string")).collect()
    assert spark.conf.get(names[0]) == "777"
    spark.conf.unset(names[0])
    before = [spark.conf.get(n, None) for n in names]
    near_dedup.near_duplicates(put([(1, "a b c")], "doc_id bigint, text string")).collect()
    assert [spark.conf.get(n, None) for n in names] == before


def test_tables_go_with_their_scope(spark, put):
    rows = put([(i, "x" * i) for i in range(9)], "doc_id bigint, text string")
    with common.scratch() as keep:
        gone, kept = common.materialize(rows), common.materialize(rows)
        keep.append(kept)
    assert kept.count() == 9
    with pytest.raises(Exception):  # noqa: B017
        gone.collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        master = "spark://far:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Far()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_quality_verdicts(put):
    """Distances and verdicts of every document, worked out in Python."""
    r, text = random.Random(2), texts(2)
    rows = []
    for i in range(120):
        lang = r.choice(["en", "de", "xx", None])
        common_words = quality_rules.COMMON.get(lang, ["foo"])
        own = " ".join(r.choice(common_words) if r.random() < 0.35 else text(1) for _ in range(r.randint(5, 200)))
        rows.append((i, own if i % 7 else own.upper() + " 123 ### $$$ " * (i % 5), lang))
    rows += [(500, None, "en"), (501, "", None), (502, "### " * 300, "en"), (503, "the " * 150, "en"), (504, "né à " * 80, "fr")]
    docs = put(rows, "doc_id bigint, text string, lang string")

    def histograms(t, lang):
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        inside = "".join(words)
        count = lambda p: len(re.findall(p, inside))
        symbols, upper, digits, points, wide = count(r"[#*$%&|<>]"), count("[A-Z]"), count("[0-9]"), count(r"[.,;:!?'\"()\-]"), len(t.encode()) - len(t)
        classes = [len(t) - len(inside), symbols, upper, digits, points, wide, max(0, len(inside) - symbols - upper - digits - points - wide)]
        listed = quality_rules.COMMON.get(lang)
        hist = None
        if listed:
            n = Counter(words)
            hist = [n[w] for w in listed]
            hist.append(max(0, len(words) - sum(hist)))
        return words, classes, hist

    made = {i: histograms(t or "", lang) for i, t, lang in rows}
    share = lambda h: [x / sum(h) if sum(h) else 0.0 for x in h]
    langs = {i: lang if lang in quality_rules.COMMON else None for i, _, lang in rows}
    ref = {}
    for lang in {*langs.values(), None}:
        own = [made[i] for i in made if lang is None or langs[i] == lang]
        ref[lang] = share([sum(m[1][k] for m in own) for k in range(7)]), share([sum(m[2][k] for m in own) for k in range(len(own[0][2]))]) if lang else None

    def js(p, q):
        part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q, strict=False)) / 2))

    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    verdicts = Counter()
    for i, (words, classes, hist) in made.items():
        a = js(share(classes), ref[langs[i]][0])
        b = js(share(hist), ref[langs[i]][1]) if hist else None
        assert got[i].class_distance == pytest.approx(a, abs=1e-9), i
        assert (got[i].common_distance is None) == (b is None) and (b is None or got[i].common_distance == pytest.approx(b, abs=1e-9)), i
        odd = len(words) >= quality_rules.CLASS_WORDS and a > quality_rules.CLASS_DISTANCE or len(words) >= quality_rules.COMMON_WORDS and (b or 0) > quality_rules.COMMON_DISTANCE
        assert got[i].kept == (not got[i].base_failed and not odd), i
        verdicts[got[i].base_failed, bool(odd)] += 1
    assert verdicts[False, False] and verdicts[True, False] and sum(n for (failed, odd), n in verdicts.items() if odd)


def test_classifier_solves_its_equations(put):
    r = np.random.default_rng(3)
    words = ["river", "stone", "the", "of", "and", "light."], ["BUY###", "$$$", "NOW!!", "***", "the"]
    rows = [(i, " ".join(r.choice(words[i % 2], r.integers(5, 80)))) for i in range(300)]
    labels = [(i, 1 - i % 2) for i in range(300)] + [(0, 0), (1, None), (None, 1), (2, 7)]
    docs, table = put(rows, "doc_id bigint, text string"), put(labels, "doc_id bigint, quality int")
    model = quality_classifier.fit(docs, table)
    kept = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]  # a document labelled twice counts with its best label
    data = "".join(rows[i][1] for i in kept).encode()
    offsets = np.append(0, np.cumsum([len(rows[i][1].encode()) for i in kept]))
    x, y = quality_classifier.statistics(np.frombuffer(data, np.uint8), offsets).astype(float), np.array([1 - i % 2 for i in kept], float)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-6) and np.allclose(model.deviation, np.maximum(x.std(axis=0), 1e-6), atol=1e-6)
    z = model.rows(x)
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z / len(y) + quality_classifier.RIDGE * np.eye(z.shape[1]), z.T @ y / len(y)), atol=1e-5)
    assert (np.diff(model.curve[1]) >= 0).all() and (np.diff(model.curve[0]) >= 0).all()
    got = {v.doc_id: v for v in quality_classifier.scores(docs, table).collect()}
    assert [got[i].score for i in kept] == pytest.approx(list(model.score(x)), abs=1e-9)
    held = [i for i in range(300) if got[i].held_out]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1] and sum(got[i].predicted == 1 - i % 2 for i in held) > 0.97 * len(held)


def test_isotonic_is_the_best_rising_fit():
    r = random.Random(8)
    for _ in range(60):
        v = [r.choice([0, 0.2, 0.5, 0.9, 1]) for _ in range(r.randint(1, 7))]
        w = [r.randint(1, 4) for _ in v]
        got = quality_classifier.isotonic(np.array(v, float), np.array(w, float)).tolist()
        # The best rising fit at i: the largest, over starts, of the least weighted mean over ends.
        mean = lambda a, b: sum(x * y for x, y in zip(v[a:b], w[a:b], strict=True)) / sum(w[a:b])  # noqa: E731, B023
        assert got == pytest.approx([max(min(mean(a, b) for b in range(i + 1, len(v) + 1)) for a in range(i + 1)) for i in range(len(v))])


def test_url_model_holds_on_urls_it_has_not_seen(put):
    model = url_filter.train(url_filter.sample_table())
    assert model.held_out > 200 and model.caught >= 0.95 and model.blocked_by_mistake == 0
    other = url_filter.sample_table(400, seed=99)
    risks = [(model.risk(*url_filter.cut(u)) >= model.bar, y) for u, y in other]
    assert sum(b for b, y in risks if y) >= 0.95 * sum(y for _, y in risks) and sum(b for b, y in risks if not y) <= 0.02 * sum(not y for _, y in risks)
    urls = ["https://mega-casino-club.example.org/", "http://www.library-hub.info/en/3", "http://m.thorel.org/de/77", "https://cheap-viagra.net/", None, "x", "http://spam-zone.example.net/es/1"]
    got = {r.page_id: r for r in url_filter.judge(put(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["block", "allow", "allow", "block", "allow", "allow", "block"]
    assert got[6].rule == "net/es/" and got[6].risk is None and got[0].rule is None
    nothing = url_filter.judge(put([(0, urls[0])], "page_id bigint, url string"), labelled=[]).collect()
    assert nothing[0].verdict == "allow"
    assert url_filter.judge(put([], "page_id bigint, url string")).count() == 0


def test_recall_of_random_tokens(put):
    """Shares of planted tokens that are found beside ordinary text, by length; the README has the same figures."""
    r, text = random.Random(5), texts(5)
    alphabets = {"base64": string.ascii_letters + string.digits + "+/", "alnum": string.ascii_letters + string.digits, "HEX": string.digits + "ABCDEF", "base32": string.ascii_uppercase + "234567"}
    rows, planted = [], {}
    for n in (20, 24, 32, 40, 64):
        for kind, alphabet in alphabets.items():
            for _ in range(100):
                token = "".join(r.choice(alphabet) for _ in range(n))
                planted[len(rows)] = n, kind
                rows.append((len(rows), f"{text(20)} {token} {text(20)}"))
    plain = [(10_000 + i, text(200) + " the-quick-brown-fox-jumps-over snake_case_names_of_functions https://example.org/a/long/path/to/some/page") for i in range(300)]
    got = {x.doc_id: x.spans for x in secrets.secret_spans(put(rows + plain, "doc_id bigint, text string")).collect()}
    found = Counter(planted[i][0] for i in planted if got[i])
    assert found[20] >= 0.5 * 400 and found[24] >= 0.75 * 400 and found[32] >= 0.9 * 400 and found[40] >= 0.95 * 400 and found[64] >= 0.98 * 400
    assert not any(got[i] for i, _ in plain)


def test_tokens_with_separators():
    part = "4eC39HqLyjWDarjtT1zdp7dc9Q"
    assert secrets.pieces(f"sk_live_{part}") == [(0, 34, f"sk_live_{part}")]  # base64 by its characters
    assert secrets.pieces("123e4567-e89b-12d3-a456-426614174000") == [(0, 36, "123e4567e89b12d3a456426614174000")]
    assert secrets.pieces("some-words-and-" + "z9" * 12) == [(15, 39, "z9" * 12)]
    assert secrets.pieces("the_quick_brown_fox_jumps_over") == []


def test_base_secrets_by_brute_force(put):
    r = random.Random(7)
    bits = ["password", "PassWD", "secret", "api_key", "apikey", "token", " = ", ": ", "='", '":"', "abc12345", "x", "AKIA", "ABCDEFGHIJKLMN", "12", "0123456789abcdef" * 2, " ", "é", "\n", "ſ"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    got = {x.doc_id: [tuple(s) for s in x.spans if s.kind != "random"] for x in secrets.secret_spans(put(rows, "doc_id bigint, text string")).collect()}
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
    for i, t in rows:
        want = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, t or "") if len(m[1]) >= 8]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        assert got[i] == [(k, a, b) for a, _, k, b in sorted(want)], t


def test_pieces_and_places(put):
    """Every piece's ids, start and checksum by the tokenizer itself, and its place in a sequence."""
    from tokenizers import Tokenizer

    text = texts(4)
    rows = [(i, text(n)) for i, n in enumerate((0, 1, 5, 300, 2500, 40, 41, 42))] + [(8, None), (9, "a<|endoftext|>b"), (9, "a<|endoftext|>b"), (None, text(700))]
    ids = packing.Ids()
    whole = Tokenizer.from_file(ids.path)
    whole.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        own = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(own) % 128 or 128
        at = [0, *range(first, len(own) + 1, 128)]
        want.update((i, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    got = packing.packed(put(rows, "doc_id bigint, text string"), 128).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 128
    assert len(held) <= -(-sum(r.length for r in got) // 128) + 2


def windows_of(turns, stride, history):
    """The windows of one conversation in plain Python: (formatted, repeated turns, texts under the loss mask)."""
    low = lambda v: (v is not None, v or "")
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, low(t[1]), t[2] or ""))
    esc = lambda x: x.replace("\\", "\\b").replace("<", "\\l").replace("[", "\\k")
    write = lambda t: "[INST]" + ("\\z" if t[1] is None else esc(t[1]).replace("\n", "\\j")) + "\n" + esc(t[2] or "") + "[/INST]"
    size = [-(-len((t[2] or "").encode()) // 4) + 2 for t in turns]
    ends = np.cumsum(size).tolist()
    window = [(e - s) // stride for e, s in zip(ends, size, strict=True)]
    out = {}
    for w in sorted(set(window)):
        own = [i for i in range(len(turns)) if window[i] == w]
        before = [i for i in range(len(turns)) if window[i] == w - 1]
        lead = turns[0][1] == "system"
        again = [i for i in before if max(ends[j] for j in before) - ends[i] + size[i] <= history and not (i == 0 and lead)]
        head = [0] if lead and own[0] > 0 else []
        out[w] = "".join(write(turns[i]) for i in [*head, *again, *own]), len(head) + len(again), [turns[i][2] or "" for i in own if turns[i][1] == "assistant"]
    return out


def test_chat_windows_by_brute_force(put):
    r, text = random.Random(3), texts(3)
    turns = []
    for c in range(12):
        n = 400 if c == 0 else r.randint(1, 30)
        for i in range(n):
            role = "system" if i == 0 and c % 3 else r.choice(["user", "assistant", None, "a\nb"])
            turns.append((c or None, r.choice([i, i, i // 2, None]) if c % 4 == 3 else i, role, r.choice([None, "", "[INST] \\b <x>", text(r.randint(1, 120))])))
    turns += turns[-3:]
    frame = put([(*t, "w", 1, 2) for t in turns], "conv_id bigint, turn bigint, role string, text string, window string, row int, place int")
    got = {(x.conv_id, x.window): x for x in chat_format.windows(frame, 200, 90).collect()}
    want = {}
    for c in {t[0] for t in turns}:
        want |= {(c, w): v for w, v in windows_of([t[1:] for t in turns if t[0] == c], 200, 90).items()}
    assert set(got) == set(want)
    for k, (formatted, repeated, loss) in want.items():
        assert (got[k].formatted, got[k].n_repeated) == (formatted, repeated), k
    back = {(x.conv_id, x.window): x.loss_texts for x in chat_format.read_back(chat_format.windows(frame, 200, 90)).collect()}
    assert back == {k: v[2] for k, v in want.items()}
    assert any(v[1] > 1 for v in want.values()) and len(want) > 40
    empty = chat_format.digest(chat_format.read_back(chat_format.windows(put([], "conv_id bigint, turn bigint, role string, text string"))))
    assert empty.count() == 0


def linked(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0d]+", t or "")]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset({tuple(w)} if w else ()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


@pytest.mark.parametrize(("stars", "pairs"), [(1, 1_000_000), (0, 20)])
def test_large_groups_of_near_copies(put, monkeypatch, stars, pairs):
    """Groups that drift away from their first member, so that buckets stay mixed, in several rounds too."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", stars)
    monkeypatch.setattr(near_dedup, "PAIRS_A_TASK", pairs)
    r, text = random.Random(13), texts(13)
    rows = []
    for _ in range(3):
        own = text(120).split()
        for step in range(40):
            if step % 4:
                own[r.randrange(len(own))] = text(1)
                own[r.randrange(len(own))] = text(1)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, text(20_000 if i == 0 else 80)) for i in range(3)]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(put(rows, "doc_id bigint, text string")).collect()}
    assert got == linked(rows)


def test_long_texts(put):
    text = texts(21)
    long = text(20_000)
    rows = [(0, long), (1, text(10) + " " + long), (2, "word " * 20_000), (3, "x" * 150_000)]
    docs = put(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.n_removed > 0 for x in sentence_dedup.dedup_sentences(docs).collect()} == {0: False, 1: True, 2: True, 3: False}
    spans = {x.doc_id: sum(s.end - s.start for s in x.removed) for x in exact_substrings.dedup_substrings(docs).collect()}
    assert spans == {i: len(t.encode()) - (len(t) - len(long) if i == 1 else 0) for i, t in rows}
    assert {x.doc_id: x.n_words for x in quality_rules.judge(docs).collect()} == {i: len(t.split()) for i, t in rows}
    assert sum(x.length for x in packing.packed(docs).collect()) == sum(len(packing.Ids()(t)) + 1 for _, t in rows)
    assert secrets.secret_spans(docs).count() == 4
    items = put([(0, " ".join(long.split()[15_000:15_030]))], "item_id bigint, text string")
    assert {x.doc_id: x.n_hit for x in decontaminate.judged(docs, items).collect()} == {0: 30, 1: 30}
