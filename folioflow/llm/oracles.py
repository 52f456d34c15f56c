"""Queries of the subpackage that SQL expresses over whole tables; the others are tested against brute force."""

from __future__ import annotations

_SQUEEZED = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_KEYED = rf"""keyed AS (SELECT triple_id, list_sort([{', '.join(_SQUEEZED.format(c) for c in ('subject', 'relation', 'object'))}]) AS k FROM kg_triples
    WHERE regexp_matches(subject, '[^\s\p{{Z}}]') AND regexp_matches(relation, '[^\s\p{{Z}}]') AND regexp_matches(object, '[^\s\p{{Z}}]'))"""
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_LONG = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(\n|[。！？；])', '\1' || chr(1), 'g'), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 500)"

ORACLES: dict[str, str] = {
    "p1_found": rf"""WITH s AS (SELECT chunk_id, list_distinct({_WORDS.format('text')}) AS w FROM chunks WHERE content_type = 'text'), t AS (SELECT chunk_id, w, len(w) AS n FROM s WHERE len(w) >= 20)
        SELECT chunk_a, chunk_b FROM (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, len(list_intersect(a.w, b.w)) AS o, a.n + b.n AS n FROM t a JOIN t b ON a.chunk_id < b.chunk_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)) WHERE 10 * o >= 7 * (n - o)""",
    "p1_groups": rf"""WITH RECURSIVE s AS (SELECT chunk_id, list_sort(list_distinct({_WORDS.format('text')})) AS w FROM chunks WHERE content_type = 'text'), m AS MATERIALIZED (SELECT chunk_id, w, len(w) AS n, min(chunk_id) OVER (PARTITION BY w) AS rep FROM s WHERE len(w) >= 20),
        t AS MATERIALIZED (SELECT * FROM m WHERE chunk_id = rep), p AS MATERIALIZED (SELECT a, b FROM (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.w, b.w)) AS o, a.n + b.n AS n FROM t a JOIN t b ON a.rep <> b.rep AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)) WHERE 10 * o >= 7 * (n - o)),
        r(a, root) AS (SELECT rep, rep FROM t UNION SELECT p.b, r.root FROM r JOIN p USING (a)), g AS (SELECT a, min(root) AS root FROM r GROUP BY a), l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
        SELECT chunk_id, root AS group_id, coalesce(links, 0) AS links FROM m JOIN g ON g.a = m.rep LEFT JOIN l ON l.a = m.rep""",
    "p5_found": rf"""WITH v AS (SELECT 'chunks.text' AS field, chunk_id AS row_id, 0 AS pos, text AS value FROM chunks UNION ALL SELECT 'answers_for_ragas.answer_keys', answer_id, unnest(range(len(answer_keys)))::INT, unnest(answer_keys) FROM answers_for_ragas)
        SELECT field, row_id, pos FROM v WHERE regexp_matches(value, '[\x{{ff10}}-\x{{ff19}}\x{{ff21}}-\x{{ff3a}}\x{{ff41}}-\x{{ff5a}}\x{{132}}\x{{133}}\x{{1c4}}-\x{{1cc}}\x{{1f1}}-\x{{1f3}}\x{{fb00}}-\x{{fb06}}\x{{fb13}}-\x{{fb17}}]|\p{{M}}|\p{{Cf}}|[\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{3164}}\x{{ffa0}}]')
            OR len(list_filter(regexp_extract_all(value, '[\p{{L}}\p{{N}}]+'), lambda w: regexp_matches(w, '[\p{{Greek}}\p{{Cyrillic}}]') AND regexp_matches(w, '\p{{Latin}}'))) > 0""",
    "p4_found": f"WITH {_KEYED} SELECT first_id, triple_id FROM (SELECT triple_id, min(triple_id) OVER (PARTITION BY k) AS first_id FROM keyed) WHERE triple_id > first_id",
    "p4_collapsed": f"WITH {_KEYED} SELECT min(triple_id) AS first_id, count(*) AS copies FROM keyed GROUP BY k",
    "p7_found": f"""SELECT chunk_id, 'text' AS field, CASE WHEN len({_LONG}) > 0 THEN 'hard' ELSE 'soft' END AS kind FROM chunks WHERE length(text) > 500
        UNION ALL SELECT chunk_id, 'section', CASE WHEN len(list_filter(string_split(section, ' > '), lambda x: length(trim(x)) > 80)) > 0 THEN 'hard' ELSE 'soft' END FROM chunks WHERE length(section) > 80""",
    "p9_found": rf"""WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items), iw AS (SELECT item_id, array_to_string(list_slice(w, n, n + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS n FROM i)),
        d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), dw AS (SELECT doc_id, array_to_string(list_slice(w, n, n + 9), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS n FROM d))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
}
