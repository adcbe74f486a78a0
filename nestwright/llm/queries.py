"""The queries of this folder by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from nestwright.llm import chat_format, decontaminate, exact_substrings, near_dedup, packing, quality_classifier, quality_rules, secrets, sentence_dedup, url_filter

QUERIES = {
    "op1_sentence_spans": sentence_dedup.query,
    "op2_secret_scan": secrets.query,
    "op3_exact_substrings": exact_substrings.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_chat_format": chat_format.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_url_filter": url_filter.query,
    "op10_minhash_near_dedup": near_dedup.query,
}
#: op3: all strings of 400 and 256 bytes by digest, of texts written in hexadecimal. op6: windows by running sums of tokens; repeated turns count in formatted_chars. op7: windows of items against all places
#: of documents. op10: all pairs of sets that share a shingle, and the least id that links reach.
SQL: dict[str, str] = {
    "op3_exact_substrings": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 800)) AS k FROM d, unnest(range(0, n - 399)) t(s)),
        r AS (SELECT doc_id, s FROM w WHERE k IN (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1)),
        i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM r)),
        spans AS (SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM i GROUP BY doc_id, g),
        edges AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM spans),
        gone AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) AS kept FROM edges JOIN d USING (doc_id) GROUP BY 1),
        v AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 512)) AS k FROM d, unnest(range(0, n - 255)) t(s)),
        q AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS later FROM v WHERE k IN (SELECT k FROM v GROUP BY 1 HAVING count(*) > 1)),
        near AS (SELECT doc_id, sum(least(coalesce(later - s, 256), 256)) AS n_repeated FROM q GROUP BY 1)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op6_chat_format": r"""
        WITH told AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, CAST(ceil(strlen(text) / 4) AS BIGINT) + 2 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS place,
                14 + length(replace(replace(replace(replace(coalesce(role, '\z'), '\', CASE WHEN role IS NULL THEN '\' ELSE '\b' END), '<', '\l'), '[', '\k'), chr(10), '\j'))
                + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\k')) AS chars
            FROM told),
        summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized),
        placed AS (SELECT *, CAST(floor((upto - tokens) / 1024) AS BIGINT) AS w, place = 1 AND coalesce(role = 'system', false) AS is_system FROM summed),
        spans AS (SELECT conv_id, w, max(upto) AS closes, min(place) AS opens FROM placed GROUP BY ALL),
        again AS (
            SELECT p.conv_id, sum(p.chars) AS chars FROM placed p JOIN spans s USING (conv_id, w) JOIN spans n ON n.conv_id = p.conv_id AND n.w = p.w + 1
            WHERE s.closes - p.upto + p.tokens <= 256 AND NOT p.is_system GROUP BY 1),
        led AS (SELECT p.conv_id, sum(p.chars) AS chars FROM placed p JOIN spans s ON s.conv_id = p.conv_id AND s.opens > 1 WHERE p.is_system GROUP BY 1),
        whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY place) AS said,
                coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
            FROM placed GROUP BY 1)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
            CAST(whole.chars + coalesce(again.chars, 0) + coalesce(led.chars, 0) AS BIGINT) AS formatted_chars
        FROM whole LEFT JOIN again USING (conv_id) LEFT JOIN led USING (conv_id)""",
    "op7_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS x, least(len(w), 10) AS n FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS x FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
        met AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN windows v USING (x)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM met, unnest(range(s, s + n)) t(k) GROUP BY 1),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM met GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS x FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        one AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)""",
}
