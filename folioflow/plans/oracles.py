"""The queries in SQL, for DuckDB over the same tables. Queries that SQL cannot express are absent and tested elsewhere."""

from __future__ import annotations

# Fixed values, stated here again so that a wrong one in the operators shows.
RELATION_STEMS = {
    "proposes": ["propose", "present", "introduce", "develop"], "based_on": ["based on", "built on", "extend", "derived from"], "uses": ["use", "utilize", "employ", "adopt", "leverage"],
    "outperforms": ["outperform", "surpass", "beat", "exceed"], "trained_on": ["train", "pretrain", "fine-tune", "finetune"], "evaluated_on": ["evaluate", "test", "benchmark", "assess"],
    "achieves": ["achieve", "reach", "obtain", "attain"], "consists_of": ["consist of", "compose", "comprise", "contain"], "compared_with": ["compare", "versus", "against"], "part_of": ["part of", "component", "module", "submodule"],
}
RELATION_SYNONYMS = {
    "uses": ["uses", "use", "utilize", "utilizes", "employ", "employs", "adopt", "adopts", "powered by", "poweredby", "based on", "built on", "accomplish", "accomplishes"],
    "proposes": ["proposes", "propose", "present", "presents", "introduce", "introduces", "develop", "develops"], "supports": ["supports", "support", "enable", "enables", "provide", "provides", "offer", "offers"],
    "outperforms": ["outperforms", "outperform", "surpass", "surpasses", "beat", "beats", "exceed", "exceeds", "superior to", "comparable to", "better than"],
    "compared_with": ["compared with", "compare with", "compared to", "compare to", "versus", "vs"], "trained_on": ["trained on", "train on", "pretrained on", "fine-tuned on", "finetuned on"],
    "evaluated_on": ["evaluated on", "evaluate on", "tested on", "test on", "benchmark on", "benchmarked on"], "achieves": ["achieves", "achieve", "reach", "reaches", "obtain", "obtains", "attain", "attains"],
    "consists_of": ["consists of", "consist of", "compose of", "comprises", "comprise", "contain", "contains"], "part_of": ["part of", "component of", "module of", "subcategory of"],
    "is_a": ["is a", "is an", "is", "are", "instance of"], "released_with": ["released with", "release with", "comes with", "launched with"],
}
CITATIONS = ["authored", "authors", "author of", "authored by", "affiliated with", "cited", "cites", "referenced by", "references"]
MATH_GLYPHS = "𝑖𝑡𝑗𝑘𝑛𝑚𝑠𝑟𝐴𝐽𝐺𝑀𝑅𝑜𝑞𝜃𝜋𝜖𝛽𝛾𝛼𝜆𝜇𝜎∑∫∂∇√𝔼ˆ"
SUMMARY = r"(?i)\b(summar|overview|main idea|main contribution|abstract|key point|big picture|give me .* about (?:the )?paper|describe the paper|tl;?dr)"
QUANTITY = r"(?i)\b(how many|how much|how long|how big|number of|amount of|size of|cost of|total of|count of)"
RELATION = r"(?i)\b(relation|relationship|compare|comparison|versus|\bvs\.?\b|differ(?:ence)?|between|based on|outperform|use[sd]?|utilize|employ|propos|develop|creat|author|consist of|derive from|built on| powered by)"
IMAGE = r"(?i)\b(figure|chart|diagram|image|picture|plot|table|graph)\b"

_TERMS = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]'))"


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _bm25(queries: str, k: int, texts: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs ending in ``bm25(query_id, doc_id, score, rank)`` for a query table (query_id, text) over ``texts`` (doc_id, text)."""
    return rf"""
    q AS ({queries}),
    docs AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM ({texts}) WHERE text IS NOT NULL),
    corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
    post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY doc_id, term),
    raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term),
    w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TERMS.format('text')}) AS term FROM q) GROUP BY query_id, term),
    scored AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN w USING (term) JOIN post USING (term), corpus GROUP BY query_id, doc_id),
    bm25 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def _vec(k: int, id_: str = "doc_id") -> str:
    return f"""
    vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    vs AS (SELECT query_id, vec_id AS {id_}, round(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM vq, embeddings),
    vec AS (SELECT * FROM (SELECT query_id, {id_}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id_}) AS rank FROM vs) WHERE rank <= {k})"""


_SAMPLED = "SELECT doc_id AS query_id, text, source AS expect_source FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL"
_ITEMS = "SELECT item_id AS query_id, text FROM eval_items"
_SYNONYM = "CASE " + " ".join(f"WHEN lower(trim(relation)) IN ({_quoted(w)}) THEN '{n}'" for n, w in RELATION_SYNONYMS.items()) + " ELSE trim(relation) END"
_STEM = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(trim(relation)), '{s}')" for s in stems) + f" THEN '{n}'" for n, stems in RELATION_STEMS.items()) + " ELSE trim(relation) END"
_EDGES = f"""
    mapped AS (SELECT triple_id, trim(subject) AS subject, {_SYNONYM} AS relation, trim(object) AS object, coalesce(count, 1) AS c, source_page, source_section FROM kg_triples WHERE trim(subject) <> '' AND trim(relation) <> '' AND trim(object) <> ''),
    edges AS (SELECT subject, relation, object, sum(c)::BIGINT AS count, arg_min_null(source_page, triple_id) AS source_page, arg_min_null(source_section, triple_id) AS source_section FROM mapped WHERE lower(trim(relation)) NOT IN ({_quoted(CITATIONS)}) GROUP BY subject, relation, object)"""
_ENDS = "SELECT trim(unnest([subject, object])) AS entity FROM kg_triples"
_FREQ = f"freq AS (SELECT entity, count(*) AS freq FROM ({_ENDS}) WHERE entity <> '' GROUP BY entity)"
_PATH_ID = "coalesce(source, 'unknown') || '::p' || coalesce(page, 0)::VARCHAR || '::c' || coalesce(chunk_index, 0)::VARCHAR"
_BOXES = "boxes AS (SELECT l_returnflag AS source, (l_orderkey % 5000)::INT AS page, l_linenumber AS no, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS x0, l_tax AS y0, l_quantity + 10 AS x1, l_tax + l_discount AS y1 FROM lineitem)"
_EDGE = r"[^\p{L}\p{N}_]"  # DuckDB's own word boundary knows ASCII only
_RE = {k: v.replace(r"\b(", f"(?:^|{_EDGE})(").replace(r"\bvs\.?\b", f"vs\\.?(?:$|{_EDGE})").replace(r")\b", f")(?:$|{_EDGE})").replace("'", "''") for k, v in {"s": SUMMARY, "q": QUANTITY, "r": RELATION, "i": IMAGE}.items()}
_LINES = "list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x))"
_SECTION = "CASE WHEN trim(coalesce(section, '')) = '' THEN '(unsectioned)' ELSE section END"

ORACLES: dict[str, str] = {
    "tokenize_terms": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_batch_topk": f"WITH {_bm25(_ITEMS, 15)} SELECT query_id, doc_id, score, rank FROM bm25",
    "vector_batch_topk": f"WITH {_vec(15, 'vec_id')} SELECT query_id, vec_id, score, rank FROM vec",
    "vector_topk_filtered": """WITH f AS (SELECT embedding AS q, label AS l FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
        s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM f, embeddings WHERE label = l)
        SELECT * FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 15""",
    "hybrid_rrf": f"""WITH {_bm25(_SAMPLED, 15)}, {_vec(15)},
        every AS (SELECT query_id, doc_id, rank, 0 AS channel FROM vec UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm25),
        fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, min({{'c': channel, 'r': rank}}) AS first FROM every GROUP BY query_id, doc_id)
        SELECT * FROM (SELECT query_id, doc_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, doc_id) AS rank FROM fused) WHERE rank <= 5""",
    "lexical_supplement": f"WITH {_bm25(_SAMPLED, 5)}, {_vec(5)} SELECT query_id, doc_id, score FROM vec UNION ALL SELECT query_id, doc_id, 0.3 FROM bm25 ANTI JOIN vec USING (query_id, doc_id)",
    "dedup_max_score": """WITH h AS (SELECT source, page, chunk_index, chunk_id AS seq, length(text) AS score FROM chunks)
        SELECT source, page, chunk_index, seq, score, first_seq FROM (SELECT *, min(seq) OVER (PARTITION BY source, page, chunk_index) AS first_seq, row_number() OVER (PARTITION BY source, page, chunk_index ORDER BY score DESC, seq) AS r FROM h) WHERE r = 1""",
    "rerank_recorded": f"""WITH {_bm25(_ITEMS, 15)}
        SELECT query_id, doc_id, rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM (SELECT query_id, doc_id, rank, CASE WHEN rank % 3 <> 0 THEN (rank * 7) % 11 END AS rerank_score FROM bm25)) WHERE new_rank <= 5""",
    "section_asof": """WITH h AS (SELECT source, level, substr(title, 1, 80) AS title, page, line FROM headers WHERE source IS NOT NULL AND page IS NOT NULL AND level IN ('h1', 'h2')),
        p AS (SELECT DISTINCT source, page FROM chunks WHERE source IS NOT NULL AND page IS NOT NULL),
        one AS (SELECT p.source, p.page, max(CASE WHEN level = 'h1' THEN {'p': h.page, 'l': line, 't': title} END) AS a FROM p LEFT JOIN h ON h.source = p.source AND h.page <= p.page GROUP BY p.source, p.page),
        two AS (SELECT one.source, one.page, any_value(a) AS a, max({'p': h.page, 'l': line, 't': title}) FILTER (h.source IS NOT NULL) AS b FROM one LEFT JOIN h ON h.source = one.source AND h.page <= one.page AND level = 'h2' AND (a IS NULL OR h.page > a.p OR h.page = a.p AND line > a.l) GROUP BY one.source, one.page)
        SELECT chunk_id, CASE WHEN c.source IS NULL OR c.page IS NULL THEN NULL WHEN c.source NOT IN (SELECT source FROM h) THEN '' WHEN a IS NOT NULL AND b IS NOT NULL THEN a.t || ' > ' || b.t WHEN a IS NOT NULL THEN a.t WHEN b IS NOT NULL THEN b.t WHEN c.page <= 2 THEN 'Abstract / 摘要' ELSE '未分类' END AS heading FROM chunks c LEFT JOIN two ON c.source = two.source AND c.page = two.page""",
    "running_line_removal": rf"""WITH b AS (SELECT source, chunk_id AS page_id, text, {_LINES} AS ls FROM chunks WHERE source IS NOT NULL AND text IS NOT NULL),
        e AS (SELECT *, CASE WHEN len(ls) >= 1 THEN ls[1] END AS t, CASE WHEN len(ls) >= 2 THEN ls[-1] END AS f FROM b), n AS (SELECT source, count(*) AS n FROM b GROUP BY source),
        top AS (SELECT source, regexp_replace(t, '\d+', '{{N}}', 'g') AS s FROM e JOIN n USING (source) WHERE t IS NOT NULL GROUP BY source, s HAVING any_value(n) >= 3 AND count(*) > 0.5 * any_value(n)),
        foot AS (SELECT source, regexp_replace(f, '\d+', '{{N}}', 'g') AS s FROM e JOIN n USING (source) WHERE f IS NOT NULL GROUP BY source, s HAVING any_value(n) >= 3 AND count(*) > 0.5 * any_value(n)),
        m AS (SELECT e.*, EXISTS (FROM top WHERE top.source = e.source AND s = regexp_replace(t, '\d+', '{{N}}', 'g')) AS x, EXISTS (FROM foot WHERE foot.source = e.source AND s = regexp_replace(f, '\d+', '{{N}}', 'g')) AS y FROM e)
        SELECT source, page_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) = '' OR NOT (x AND trim(l) = t OR y AND trim(l) = f)), chr(10)) AS text FROM m""",
    "formula_split": f"""WITH l AS (SELECT chunk_id, string_split(text, chr(10)) AS ls FROM chunks)
        SELECT chunk_id, array_to_string(list_filter(ls, lambda x: NOT (trim(x) <> '' AND (contains(x, '(cid:') OR length(trim(x)) <= 15 AND regexp_matches(x, '[{MATH_GLYPHS}]')))), chr(10)) AS body, len(list_filter(ls, lambda x: trim(x) <> '' AND (contains(x, '(cid:') OR length(trim(x)) <= 15 AND regexp_matches(x, '[{MATH_GLYPHS}]')))) AS formulas FROM l""",
    "equation_count": r"""WITH l AS (SELECT source, page, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE source IS NOT NULL AND page IS NOT NULL),
        n AS (SELECT source, page, try_cast(regexp_extract(right(rtrim(line), 25), '\((\d{1,2})\)', 1) AS INT) AS no FROM l), f AS (SELECT source, no, min(page) AS page FROM n WHERE no BETWEEN 1 AND 20 GROUP BY source, no)
        SELECT source, page, count(*) AS n FROM f GROUP BY source, page""",
    "region_merge": f"""WITH {_BOXES}, c AS (SELECT *, count(x0) OVER (PARTITION BY source, page) AS n FROM boxes)
        SELECT source, page, round(min(x0), 1) AS x0, round(min(y0), 1) AS y0, round(max(x1), 1) AS x1, round(max(y1), 1) AS y1, count(*) AS parts FROM c WHERE n > 1 AND x0 IS NOT NULL GROUP BY source, page UNION ALL SELECT source, page, x0, y0, x1, y1, 1 FROM c WHERE n <= 1""",
    "region_exclusion": f"""WITH {_BOXES}, f AS (FROM boxes WHERE no <= 2 AND x0 IS NOT NULL)
        SELECT * FROM boxes b WHERE no > 2 AND x0 IS NOT NULL AND NOT EXISTS (FROM f WHERE f.source = b.source AND f.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN f.x0 AND f.x1 AND (b.y0 + b.y1) / 2 BETWEEN f.y0 AND f.y1)""",
    "idempotent_upsert": f"""WITH c AS (SELECT {_PATH_ID} AS id, chunk_id, text, ingested_at FROM chunks)
        SELECT id, min(chunk_id) AS chunk_id FROM c WHERE trim(text) <> '' AND id NOT IN (SELECT id FROM c WHERE ingested_at < TIMESTAMP '2025-01-01') GROUP BY id""",
    "chunk_metadata": f"SELECT {_PATH_ID} AS id, coalesce(source, 'unknown') AS source, coalesce(page, 0)::INT AS page, coalesce(section, '') AS section, coalesce(content_type, 'text') AS chunk_type, coalesce(chunk_index, 0)::INT AS chunk_index FROM chunks",
    "chunk_diagnostics": "SELECT content_type, count(*) AS chunks, count(*) FILTER (trim(section) <> '') AS with_section FROM chunks GROUP BY content_type",
    "source_listing": "SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL",
    "entity_frequency": f"WITH {_FREQ} SELECT entity, freq FROM freq",
    "relation_normalize_a": f"SELECT relation, count(*) AS triples FROM (SELECT {_STEM} AS relation FROM kg_triples WHERE relation IS NOT NULL) GROUP BY relation",
    "relation_normalize_b": f"SELECT relation, count(*) AS triples FROM (SELECT {_SYNONYM} AS relation FROM kg_triples WHERE relation IS NOT NULL) GROUP BY relation",
    "triple_validate": rf"""WITH t AS (SELECT triple_id, trim(subject) AS subject, relation, trim(object) AS object, concat_ws(' ', subject, object) AS p FROM kg_triples)
        SELECT triple_id, subject, {_STEM} AS relation, object FROM t WHERE subject <> object AND length(subject) >= 2 AND length(object) >= 2 AND NOT regexp_full_match(subject, '\d+') AND NOT regexp_full_match(object, '\d+') AND regexp_matches(subject, '[\x{{4e00}}-\x{{9fff}}a-zA-Z0-9]') AND regexp_matches(object, '[\x{{4e00}}-\x{{9fff}}a-zA-Z0-9]') AND contains(p, subject) AND contains(p, object) AND length(trim(relation)) BETWEEN 1 AND 15""",
    "triple_vote": "SELECT subject, relation, object, count(*) AS count FROM kg_triples GROUP BY subject, relation, object",
    "triple_first_wins": "SELECT subject, relation, object, min(triple_id) AS triple_id, arg_min_null(source_page, triple_id) AS source_page FROM kg_triples GROUP BY subject, relation, object",
    "triple_merge": f"WITH {_EDGES} SELECT subject, relation, object, count, source_page, source_section FROM edges",
    "entity_candidates": f"WITH {_FREQ}, p AS (SELECT a.entity AS short, b.entity AS long FROM freq a, freq b WHERE length(b.entity) > length(a.entity) AND contains(lower(b.entity), lower(a.entity))) SELECT short, long FROM (SELECT *, count(*) OVER (PARTITION BY short) AS n FROM p) WHERE n = 1",
    "relation_distribution": f"WITH {_EDGES} SELECT relation, count(*) AS edges FROM edges GROUP BY relation",
    "graph_stats": f"WITH {_EDGES} SELECT (SELECT count(DISTINCT n) FROM (SELECT unnest([subject, object]) AS n FROM edges)) AS nodes, count(*) AS edges, count(DISTINCT relation) AS relations FROM edges",
    "graph_one_hop": f"WITH {_EDGES} SELECT subject, relation AS predicate, object, count FROM edges WHERE contains(lower(subject), 'lab') AND relation IN ('uses', 'proposes', 'based_on')",
    "graph_pattern_query": f"WITH {_EDGES} SELECT subject, relation AS predicate, object, count FROM edges WHERE (relation IN ('uses', 'proposes') OR contains(lower(object), 'graph')) AND suffix(lower(subject), 'lab')",
    "graph_answer_projection": f"WITH {_EDGES} SELECT DISTINCT object AS answer FROM edges WHERE starts_with(lower(subject), 'b')",
    "graph_paths": f"""WITH {_EDGES}, step AS (SELECT subject AS s, object AS o, min(relation) AS r FROM edges GROUP BY subject, object),
        p1 AS (SELECT [s, o] AS e, [r] AS rs FROM step WHERE starts_with(lower(s), 'ba') AND s <> o), p2 AS (SELECT list_append(e, o) AS e, list_append(rs, r) AS rs FROM p1 JOIN step ON e[-1] = s WHERE NOT list_contains(e, o)), p3 AS (SELECT list_append(e, o) AS e, list_append(rs, r) AS rs FROM p2 JOIN step ON e[-1] = s WHERE NOT list_contains(e, o))
        SELECT array_to_string(e, ' > ') AS path, array_to_string(rs, ',') AS relations, len(rs) AS hops FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)""",
    "graph_degree": f"WITH {_EDGES} SELECT entity, count(*) AS degree FROM (SELECT unnest([subject, object]) AS entity FROM edges) GROUP BY entity",
    "graph_degree_subgraph": f"WITH {_EDGES}, n AS (SELECT entity FROM (SELECT unnest([subject, object]) AS entity FROM edges) GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 60) SELECT subject, relation, object, count FROM edges WHERE subject IN (FROM n) AND object IN (FROM n)",
    "section_grouping": f"SELECT source, s AS section, min(page) AS page, count(*) AS n_chunks, sum(length(text))::BIGINT AS chars FROM (SELECT *, {_SECTION} AS s FROM chunks WHERE source IS NOT NULL AND text IS NOT NULL) GROUP BY source, s",
    "route_rules": f"""WITH r AS (SELECT answer_id, question, regexp_matches(question, '{_RE['s']}') AS s, regexp_matches(question, '{_RE['q']}') AS q, regexp_matches(question, '{_RE['r']}') AS r FROM answers_for_ragas WHERE question IS NOT NULL), t AS (SELECT *, CASE WHEN s THEN 'summary' WHEN q THEN 'fact' WHEN r THEN 'relation' ELSE 'fact' END AS type FROM r)
        SELECT answer_id, type, CASE WHEN s OR q OR r THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, CASE type WHEN 'summary' THEN 'document' WHEN 'relation' THEN 'section' ELSE 'paragraph' END AS level, CASE WHEN type = 'summary' THEN 'summary_index,vector' WHEN type = 'relation' THEN 'graph,vector' WHEN regexp_matches(question, '{_RE['i']}') THEN 'vector,summary_index,vlm' ELSE 'vector,summary_index' END AS tools, CASE WHEN type = 'relation' THEN 3 ELSE 1 END AS max_hops FROM t""",
    "think_strip": r"SELECT answer_id, regexp_replace(regexp_replace(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS answer FROM answers_for_ragas",
    "self_consistency_pick": "SELECT query_id, draft, faithfulness FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY faithfulness DESC, length(answer) DESC, draft) AS r FROM (SELECT id AS query_id, answer_id AS draft, answer, (answer_id % 5) / 4.0::DOUBLE AS faithfulness FROM answers_for_ragas WHERE answer IS NOT NULL)) WHERE r = 1",
    "set_f1": """WITH s AS (SELECT answer_id, list_distinct(regexp_extract_all(answer, '[A-Za-z0-9]+')) AS f, list_distinct(list_filter(answer_keys, lambda k: k IS NOT NULL)) AS g FROM answers_for_ragas WHERE answer IS NOT NULL AND answer_keys IS NOT NULL), t AS (SELECT *, len(list_intersect(f, g)) AS tp FROM s),
        p AS (SELECT answer_id, len(f) + len(g) AS n, CASE WHEN len(f) > 0 THEN tp / len(f)::DOUBLE ELSE 0 END AS p, CASE WHEN len(g) > 0 THEN tp / len(g)::DOUBLE ELSE 0 END AS r FROM t)
        SELECT answer_id, round(CASE WHEN n = 0 THEN 1 ELSE p END, 6) AS precision, round(CASE WHEN n = 0 THEN 1 ELSE r END, 6) AS recall, round(CASE WHEN n = 0 THEN 1 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""",
    "eval_rollup": """WITH k AS (SELECT *, coalesce(list_filter(answer_keys, lambda x: x IS NOT NULL AND x <> ''), []) AS ks, lower(coalesce(array_to_string(list_filter(contexts, lambda x: x IS NOT NULL), ' '), '')) AS c, lower(coalesce(answer, '')) AS a FROM answers_for_ragas WHERE pdf IS NOT NULL),
        m AS (SELECT pdf, type, error, CASE WHEN len(ks) = 0 THEN 1.0 ELSE len(list_filter(ks, lambda x: contains(c, lower(x)))) / len(ks)::DOUBLE END AS cr, CASE WHEN len(ks) = 0 THEN 1.0 ELSE len(list_filter(ks, lambda x: contains(a, lower(x)))) / len(ks)::DOUBLE END AS co FROM k)
        SELECT pdf, count(*) AS items, count(error) AS failed, round(avg(cr) FILTER (error IS NULL), 4) AS context_recall, round(avg(co) FILTER (error IS NULL), 4) AS completeness, round(avg((co >= 0.9999)::INT) FILTER (error IS NULL), 4) AS pass_rate, round(coalesce(avg((co >= 0.9999)::INT) FILTER (error IS NULL AND type = 'relation'), 1.0), 4) AS multihop_success FROM m GROUP BY ROLLUP (pdf)""",
    "confusion_counts": "SELECT tp, fp, fn, tn, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM (SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS tp, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS fp, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS fn, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS tn FROM lineitem)",
    "retrieval_ablation": f"""WITH {_bm25(_SAMPLED, 5)}, {_vec(5)}, h AS (SELECT 'lexical' AS mode, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'vector', query_id, doc_id, rank FROM vec),
        g AS (SELECT mode, query_id, min(rank) AS r FROM h JOIN q USING (query_id) JOIN documents d ON d.doc_id = h.doc_id AND d.source = expect_source GROUP BY mode, query_id)
        SELECT m.mode, count(*) AS queries, count(*) FILTER (r = 1) AS top1, count(*) FILTER (r <= 5) AS top5 FROM q CROSS JOIN (SELECT DISTINCT mode FROM h) m LEFT JOIN g ON g.mode = m.mode AND g.query_id = q.query_id GROUP BY m.mode""",
}

_CHUNK_TEXTS = "SELECT chunk_id AS doc_id, text FROM chunks"
_FORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_GRAPH_ASKED = "gq AS (SELECT min(answer_id) AS query_id, question AS text FROM answers_for_ragas WHERE question IS NOT NULL GROUP BY question)"
_GRAPH_CHANNEL = f"""{_GRAPH_ASKED}, gr AS (SELECT query_id, subject, relation AS predicate, object, count FROM gq JOIN edges ON {_FORM.format('subject')} <> '' AND contains(' ' || {_FORM.format('gq.text')} || ' ', ' ' || {_FORM.format('subject')} || ' ')),
    gt AS (SELECT query_id, 'subject=' || subject || ', predicate=' || predicate || ', object=' || object AS text, row_number() OVER (PARTITION BY query_id ORDER BY count DESC, subject, predicate, object) AS r FROM gr),
    gc AS (SELECT query_id, 'graph:' || md5(text) AS doc_id, text, 0.9::DOUBLE AS score, 'knowledge_graph' AS source_tool FROM gt WHERE r <= 5)"""
_PAGES = """pages AS (SELECT source, page, arg_min(CASE WHEN chunk_id % 3 = 0 THEN 'Figure ' || chunk_id % 50 || ': ' WHEN chunk_id % 7 = 0 THEN 'Table ' || chunk_id % 50 || ' | ' ELSE '' END || text, chunk_id) AS text FROM chunks WHERE source IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL GROUP BY source, page),
    caps AS (SELECT source, page, unnest(range(len(c)))::INT AS seq, unnest(c) AS caption FROM (SELECT source, page, regexp_extract_all(text, '(?:Figure|Table)\\s*\\d+\\s*[|:][^\\n]{0,200}') AS c FROM pages))"""
_CELLS = "list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' | '))"
_HINTS = ["def ", "import ", "return ", "for ", "# ", "()", "self.", "lambda", "enumerate", "gradient_checkpointing", "torch"]
_RULED = f"""ruled AS (SELECT answer_id, type AS given, CASE WHEN s THEN 'summary' WHEN q THEN 'fact' WHEN r THEN 'relation' ELSE 'fact' END AS type, CASE WHEN s OR q OR r THEN 0.95 ELSE 0.5 END::DOUBLE AS rc FROM (SELECT answer_id, type, regexp_matches(question, '{_RE['s']}') AS s, regexp_matches(question, '{_RE['q']}') AS q, regexp_matches(question, '{_RE['r']}') AS r FROM answers_for_ragas WHERE question IS NOT NULL))"""

ORACLES |= {
    "bm25_kept_index": ORACLES["bm25_batch_topk"],
    "bm25_within_source": f"WITH {_bm25(_SAMPLED + ' AND source IS NOT NULL', 10**9)} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, score FROM bm25) JOIN q USING (query_id) JOIN documents d USING (doc_id) WHERE d.source = expect_source) WHERE rank <= 15",
    "hybrid_text_rrf": f"""WITH {_bm25(_SAMPLED, 15)}, {_vec(15)}, every AS (SELECT query_id, doc_id, rank, 0 AS channel FROM vec UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm25),
        single AS (SELECT query_id, d.text, channel, min(rank) AS rank, list(DISTINCT e.doc_id) AS ids FROM every e JOIN documents d ON d.doc_id = e.doc_id AND d.text IS NOT NULL GROUP BY query_id, d.text, channel),
        fused AS (SELECT query_id, text, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, min({{'c': channel, 'r': rank}}) AS first, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS ids FROM single GROUP BY query_id, text)
        SELECT * FROM (SELECT query_id, text, ids, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, text) AS rank FROM fused) WHERE rank <= 5""",
    "hit_projection": f"WITH {_bm25(_ITEMS, 5)} SELECT query_id, doc_id, substr(d.text, 1, 500) AS text, floor(score * 10000 + 0.5000001) / 10000 AS score, nullif((rank - 1)::DOUBLE, 0) AS rrf_score FROM bm25 JOIN documents d USING (doc_id)",
    "collection_count": "SELECT count(*) AS vectors FROM embeddings",
    "rerank_reply": f"""WITH {_bm25(_ITEMS, 15)}, s AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 9 AND count(*) OVER (PARTITION BY query_id) > 5 THEN ((rank * 7) % 11)::DOUBLE END AS rerank_score FROM bm25)
        SELECT query_id, doc_id, rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM s) WHERE new_rank <= 5""",
    "graph_channel": f"WITH {_EDGES}, {_GRAPH_CHANNEL} SELECT * FROM gc",
    "channel_candidates": f"WITH {_EDGES}, {_GRAPH_CHANNEL}, {_bm25('SELECT query_id, text FROM gq', 5, _CHUNK_TEXTS)} SELECT query_id, doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.8 ELSE 0.3 END::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN 'vector' ELSE 'lexical' END AS source_tool FROM bm25 UNION ALL SELECT DISTINCT query_id, doc_id, score, source_tool FROM gc",
    "graph_append": "SELECT trim(subject) AS subject, trim(relation) AS relation, trim(object) AS object, count(*) AS rows FROM kg_triples WHERE trim(subject) <> '' AND trim(relation) <> '' AND trim(object) <> '' GROUP BY 1, 2, 3",
    "graph_nodes": f"WITH {_EDGES} SELECT DISTINCT unnest([subject, object]) AS name FROM edges",
    "graph_node_sample": f"WITH {_EDGES} SELECT name FROM (SELECT DISTINCT unnest([subject, object]) AS name FROM edges) ORDER BY name LIMIT 10",
    "graph_record_text": f"WITH {_EDGES} SELECT 'subject=' || subject || ', predicate=' || relation || ', object=' || object AS text FROM edges WHERE relation = 'uses'",
    "graph_pattern_limit": f"WITH {_EDGES} SELECT subject, relation AS predicate, object, count FROM edges WHERE NOT contains(lower(subject), 'lab') ORDER BY subject, relation, object LIMIT 7",
    "graph_components": f"""WITH RECURSIVE {_EDGES}, e AS (SELECT subject AS a, object AS b FROM edges WHERE subject <> object UNION SELECT object, subject FROM edges WHERE subject <> object),
        r(a, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e USING (a) WHERE r.root < e.b) SELECT component, count(*) AS entities FROM (SELECT a, min(root) AS component FROM (FROM r UNION ALL SELECT a, a FROM e) GROUP BY a) GROUP BY component""",
    "sentence_split": r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 25))::INT AS sentences FROM documents WHERE text IS NOT NULL""",
    "table_chunks": f"""WITH t AS (SELECT chunk_id, {_CELLS} AS c FROM chunks WHERE content_type = 'table'), f AS (SELECT *, flatten(c) AS fl, list_filter(c[2:], lambda r: len(list_filter(r, lambda x: trim(x) <> '')) > 0) AS rs FROM t)
        SELECT chunk_id, coalesce(len(c) >= 2 AND len(list_filter(fl, lambda x: trim(x) = '')) / len(fl)::DOUBLE < 0.4, false) AS is_real, len(list_filter([{_quoted(_HINTS)}], lambda h: contains(lower(array_to_string(list_filter(fl, lambda x: x <> ''), ' ')), h))) >= 3 AS is_code,
        CASE WHEN len(c) >= 2 AND len(rs) > 0 THEN '表格内容：' || chr(10) || array_to_string(list_filter(list_transform(rs, lambda r: array_to_string(list_filter(list_transform(range(1, least(len(r), len(c[1])) + 1), lambda i: CASE WHEN trim(r[i]) <> '' THEN c[1][i] || ': ' || r[i] END), lambda p: p IS NOT NULL), ' | ')), lambda x: x <> ''), chr(10)) END AS rendered FROM f""",
    "captions": f"WITH {_PAGES} SELECT source, page, seq, caption FROM caps",
    "caption_match": f"WITH {_PAGES}, one AS (SELECT source, page, substr(caption, 1, 120) AS caption FROM caps WHERE seq = 0) SELECT source, page, page::DOUBLE AS x0, caption FROM pages LEFT JOIN one USING (source, page) WHERE page % 2 = 0 UNION ALL SELECT source, page, NULL, caption FROM one WHERE page % 2 <> 0",
    "figure_filter": f"WITH {_BOXES}, b AS (SELECT source, page, x0, y0, x0 + x0 * 1.5 AS x1, y0 + x0 * 2 AS y1 FROM boxes WHERE x0 IS NOT NULL) SELECT source, page, round(x0, 1) AS x0, round(y0, 1) AS y0, round(x1, 1) AS x1, round(y1, 1) AS y1 FROM b WHERE x1 - x0 > 20 AND y1 - y0 > 20",
    "column_count": """WITH c AS (SELECT l_returnflag AS source, (l_orderkey % 40)::INT AS page, (l_extendedprice % 600)::DOUBLE AS x, (l_quantity * 16)::DOUBLE AS top FROM lineitem), a AS (SELECT source, page, count(*) AS n, count(*) FILTER (abs(x - 300) <= 10) AS mid, count(*) FILTER (x < 300) AS l, count(*) FILTER (x >= 300) AS r, count(*) FILTER (abs(x - 600 * (1 / 3.0::DOUBLE)) <= 8) AS g1, count(*) FILTER (abs(x - 600 * (2 / 3.0::DOUBLE)) <= 8) AS g2, count(*) FILTER (x < 200) AS t1, count(*) FILTER (x BETWEEN 200 AND 400) AS t2, count(*) FILTER (x > 400) AS t3 FROM c WHERE top > 80 AND top < 720 GROUP BY source, page)
        SELECT source, page, CASE WHEN n < 30 THEN 1 WHEN t1 > 100 AND t2 > 100 AND t3 > 100 AND g1 < 0.02 * n AND g2 < 0.02 * n THEN 3 WHEN mid < 0.05 * n AND l > 100 AND r > 100 THEN 2 ELSE 1 END AS columns FROM a""",
    "section_guess": r"""SELECT chunk_id, CASE WHEN regexp_matches(text, '(?im)^abstract\b') THEN 'Abstract' WHEN regexp_matches(text, '(?im)^1\.?\s*introduction') THEN '1. Introduction' WHEN regexp_extract(text, '(?m)^(\d+)\.\s*(.+)$', 2) <> '' THEN substr(trim(regexp_extract(text, '(?m)^(\d+)\.\s*(.+)$', 2)), 1, 60) WHEN length(trim(string_split(text, chr(10))[1])) > 40 THEN 'Abstract / 论文摘要' ELSE substr(trim(string_split(text, chr(10))[1]), 1, 80) END AS section FROM chunks WHERE text IS NOT NULL""",
    "query_guard": "SELECT * FROM (VALUES (0, true, ''), (1, true, ''), (2, false, 'forbidden word DELETE'), (3, false, 'several statements'), (4, true, ''), (5, false, 'no MATCH'), (6, false, 'forbidden word SET'), (7, false, 'empty query'), (8, false, 'empty query')) AS t(no, allowed, reason)",
    "evaluation_report": f"""WITH r AS ({ORACLES['eval_rollup']}) SELECT pdf, coalesce(pdf, 'all documents') || ': ' || items || ' items, ' || failed || ' failed, recall ' || coalesce(round(100::DOUBLE * context_recall, 2)::VARCHAR || '%', '-') || ', complete ' || coalesce(round(100::DOUBLE * completeness, 2)::VARCHAR || '%', '-') || ', passed ' || coalesce(round(100::DOUBLE * pass_rate, 2)::VARCHAR || '%', '-') AS line FROM r""",
    "judged_scores": "SELECT answer_id, CASE WHEN answer_id % 4 = 0 THEN 0.0 ELSE (answer_id % 10) / 10.0 END::DOUBLE AS recall, CASE WHEN answer_id % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS faithfulness FROM answers_for_ragas",
    "retrieval_keywords": f"""WITH kq AS (SELECT answer_id AS query_id, question AS text, list_filter(list_transform(answer_keys, lambda k: {_FORM.format('k')}), lambda k: k <> '') AS ks FROM answers_for_ragas WHERE question IS NOT NULL AND answer_keys IS NOT NULL AND answer_id % 10 = 0), {_bm25('SELECT query_id, text FROM kq', 5, _CHUNK_TEXTS)},
        e AS (SELECT query_id, len(ks) AS n, unnest(list_filter(ks, lambda k: contains({_FORM.format('c.text')}, k))) AS key FROM bm25 JOIN kq USING (query_id) JOIN chunks c ON c.chunk_id = doc_id), g AS (SELECT query_id, count(DISTINCT key) / any_value(n)::DOUBLE AS share FROM e GROUP BY query_id)
        SELECT 'lexical' AS mode, count(*) AS queries, round(avg(coalesce(share, 0)), 6) AS ratio FROM kq LEFT JOIN g USING (query_id) WHERE len(ks) > 0""",
    "route_arbitration": f"""WITH {_RULED}, m AS (SELECT *, CASE WHEN given IN ('fact', 'relation', 'summary') THEN given ELSE 'fact' END AS mt, (answer_id % 10) / 10.0::DOUBLE AS mc FROM ruled)
        SELECT answer_id, CASE WHEN rc < 0.9 AND mc > rc + 0.1 THEN mt ELSE type END AS type, CASE WHEN rc < 0.9 AND mc > rc + 0.1 THEN 'llm' WHEN rc < 0.9 AND mt <> type AND mc >= rc THEN 'rule+llm' ELSE 'rule' END AS source FROM m""",
    "answer_projection": "SELECT answer_id, array_to_string(list_transform(list_filter(contexts, lambda c: c IS NOT NULL), lambda c: substr(c, 1, 300)), '|') AS passages, round(answer_id / 7.0::DOUBLE, 4) AS confidence FROM answers_for_ragas",
    "ingest_report": "WITH n AS (SELECT source, count(*) AS chunks FROM chunks GROUP BY source) SELECT d.source, CASE WHEN coalesce(chunks, 0) = 0 THEN 'empty' ELSE 'ok' END AS status, coalesce(chunks, 0) AS chunks FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) d LEFT JOIN n USING (source)",
    "triple_extract": rf"""WITH t AS (SELECT triple_id, trim(subject) AS subject, relation, trim(object) AS object, concat_ws(' ', 'The passage states:', subject, relation, CASE WHEN triple_id % 5 <> 0 THEN object END) AS p FROM kg_triples WHERE subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL AND triple_id % 7 <> 0),
        v AS (SELECT triple_id, subject, {_STEM} AS relation, object FROM t WHERE subject <> object AND length(subject) >= 2 AND length(object) >= 2 AND NOT regexp_full_match(subject, '\d+') AND NOT regexp_full_match(object, '\d+') AND regexp_matches(subject, '[\x{{4e00}}-\x{{9fff}}a-zA-Z0-9]') AND regexp_matches(object, '[\x{{4e00}}-\x{{9fff}}a-zA-Z0-9]') AND contains(p, subject) AND contains(p, object) AND length(trim(relation)) BETWEEN 1 AND 15)
        SELECT subject, relation, object, min(triple_id) AS triple_id FROM v GROUP BY subject, relation, object""",
}
