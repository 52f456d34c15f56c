"""Queries over the data directory, one per operator group; each takes (spark, directory)."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions import sets
from folioflow.functions.text import evidence_terms, keywords, sentences, strip_think, terms
from folioflow.operators import chunking, diversity, evaluate, fusion, graph, layout, lexical, replies, summary, vectors, verify
from folioflow.plans import pattern, retrieve
from folioflow.providers import Providers
from folioflow.runtime import cut, ensure_checkpoint_dir, table
from folioflow.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "source")


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def _sampled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stated query set (every row whose id is divisible by 100) with texts and vectors, and all vectors by document."""
    vectors_ = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(s, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "text", F.col("source").alias("expect_source"))
    q = vectors_.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    return asked, q, vectors_


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.merge_triples(table(s, d, "kg_triples"))


@query
def tokenize_terms(s, d):
    t = _documents(s, d).where("text is not null").select("doc_id", F.explode(terms("text")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df"))


@query
def bm25_batch_topk(s, d):
    return lexical.search(_items(s, d), _documents(s, d), 15)


@query
def vector_batch_topk(s, d):
    q = table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.batch_top_k(q, table(s, d, "embeddings"), 15)


@query
def vector_topk_filtered(s, d):
    e = table(s, d, "embeddings")
    first = e.where("embedding is not null").orderBy("vec_id").select("embedding", "label").first()
    return vectors.top_k(e, list(first["embedding"]), 15, where=f"label = {first['label']}")


@query
def hybrid_rrf(s, d):
    asked, q, v = _sampled(s, d)
    return retrieve.hybrid(asked.select("query_id", "text"), _documents(s, d), v, q, 5)


@query
def lexical_supplement(s, d):
    asked, q, v = _sampled(s, d)
    vec = vectors.batch_top_k(q, v, 5, "doc_id").select("query_id", "doc_id", "score")
    lex = lexical.search(asked, _documents(s, d), 5).select("query_id", "doc_id")
    return fusion.supplement(vec, lex, ["query_id", "doc_id"])


@query
def dedup_max_score(s, d):
    c = table(s, d, "chunks").select("source", "page", "chunk_index", F.col("chunk_id").alias("seq"), F.length("text").cast("long").alias("score"))
    return fusion.keep_best(c, ["source", "page", "chunk_index"])


@query
def rerank_recorded(s, d):
    found = lexical.search(_items(s, d), _documents(s, d), 15)
    scores = found.where("rank % 3 <> 0").select("query_id", F.col("rank").alias("index"), ((F.col("rank") * 7) % 11).alias("score"))
    return fusion.rerank(found.select("query_id", "doc_id", "rank"), scores, 5).select("query_id", "doc_id", "rerank_score", "new_rank")


@query
def multi_channel_retrieve(s, d):
    asked, q, v = _sampled(s, d)
    docs = _documents(s, d).select("doc_id", "text")
    vec = vectors.batch_top_k(q, v, 15, "doc_id").select("query_id", "doc_id", "score", F.lit("vector").alias("source_tool")).join(docs, "doc_id")
    lex = lexical.search(asked, docs, 15).select("query_id", "doc_id", F.lit(0.3).alias("score"), F.lit("lexical").alias("source_tool")).join(docs, "doc_id")
    return retrieve.multi_channel([vec, lex], asked.select("query_id", "text"))


@query
def chunk_pack(s, d):
    pages = table(s, d, "documents").where("source is not null").select("source", F.coalesce("page", F.lit(0)).alias("page"), F.col("doc_id").alias("page_seq"), "text")
    return chunking.chunk_pages(pages)


@query
def section_asof(s, d):
    c = table(s, d, "chunks").select("chunk_id", "source", "page")
    return chunking.sections(c, table(s, d, "headers"), spacing=False).select("chunk_id", "heading")


@query
def section_labels(s, d):
    return chunking.sections(table(s, d, "chunks").select("chunk_id", "source", "page"), table(s, d, "headers")).groupBy("heading").agg(F.count("*").alias("chunks"))


@query
def table_chunks(s, d):
    rows = table(s, d, "chunks").where("content_type = 'table'").select("chunk_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, r" \| ")).alias("cells"))
    c = F.col("cells")
    return rows.select("chunk_id", chunking.is_real_table(c).alias("is_real"), chunking.is_code_table(c).alias("is_code"), chunking.table_text(c).alias("rendered"))


@query
def running_line_removal(s, d):
    pages = table(s, d, "chunks").where("source is not null").select("source", F.col("chunk_id").alias("page_id"), "text")
    return layout.remove_running_lines(pages)


@query
def formula_split(s, d):
    body, formulas = layout.split_formulas(F.col("text"))
    return table(s, d, "chunks").select("chunk_id", body.alias("body"), F.size(formulas).cast("long").alias("formulas"))


@query
def equation_count(s, d):
    return layout.equation_counts(table(s, d, "chunks").where("source is not null and page is not null"))


@query
def header_extract(s, d):
    pages = table(s, d, "chunks").select(F.col("source"), F.col("page"), "text")
    return layout.headings(pages)


def _boxes(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("source"), (F.col("l_orderkey") % 5000).cast("int").alias("page"), F.col("l_linenumber").alias("no"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_tax") + F.col("l_discount")).alias("y1"))


@query
def region_merge(s, d):
    return layout.merge_regions(_boxes(s, d).drop("no"))


@query
def region_exclusion(s, d):
    b = _boxes(s, d)
    return layout.outside_figures(b.where("no > 2 and x0 is not null"), b.where("no <= 2 and x0 is not null")).select("source", "page", "no", "x0", "y0", "x1", "y1")


@query
def idempotent_upsert(s, d):
    c = table(s, d, "chunks").select(files.chunk_id().alias("id"), "chunk_id", "text", "ingested_at")
    return files.new_rows(c.where("ingested_at < timestamp_ntz '2025-01-01 00:00:00'").select("id"), c, ["id"], "chunk_id").select("id", "chunk_id")


@query
def chunk_metadata(s, d):
    return files.metadata(table(s, d, "chunks")).drop("text")


@query
def chunk_diagnostics(s, d):
    return table(s, d, "chunks").groupBy("content_type").agg(F.count("*").alias("chunks"), F.count_if(F.trim("section") != "").alias("with_section"))


@query
def source_listing(s, d):
    return files.sources(table(s, d, "chunks"))


@query
def entity_frequency(s, d):
    return graph.entity_frequency(table(s, d, "kg_triples"))


@query
def relation_normalize_a(s, d):
    t = table(s, d, "kg_triples").where("relation is not null")
    return t.select(graph.relation_by_stem(F.col("relation")).alias("relation")).groupBy("relation").agg(F.count("*").alias("triples"))


@query
def relation_normalize_b(s, d):
    t = table(s, d, "kg_triples").where("relation is not null")
    return t.select(graph.relation_by_synonym(F.col("relation")).alias("relation")).groupBy("relation").agg(F.count("*").alias("triples"))


@query
def triple_validate(s, d):
    t = table(s, d, "kg_triples").select("triple_id", "subject", "relation", "object", F.concat_ws(" ", "subject", "object").alias("passage"))
    return graph.valid_triples(t).drop("passage")


@query
def triple_vote(s, d):
    t = table(s, d, "kg_triples")
    return graph.vote([t.where("triple_id % 2 = 0"), t.where("triple_id % 2 = 1")])


@query
def triple_first_wins(s, d):
    t = table(s, d, "kg_triples").select("subject", "relation", "object", "triple_id", "source_page")
    return graph.first_of_each(t, ["triple_id"], ["subject", "relation", "object"])


@query
def triple_merge(s, d):
    return _edges(s, d)


@query
def entity_candidates(s, d):
    return graph.entity_candidates(graph.entity_frequency(table(s, d, "kg_triples")))


@query
def entity_resolve(s, d):
    return graph.resolve_entities(graph.entity_frequency(table(s, d, "kg_triples")))


@query
def relation_distribution(s, d):
    return graph.relation_distribution(_edges(s, d))


@query
def graph_stats(s, d):
    return graph.graph_stats(_edges(s, d))


@query
def graph_one_hop(s, d):
    return graph.one_hop(_edges(s, d), subject=("contains", "lab"), relations=["uses", "proposes", "based_on"], limit=None)


@query
def graph_pattern_query(s, d):
    return pattern.run("MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE (r.relation IN ['uses', 'proposes'] OR toLower(b.name) CONTAINS 'graph') AND a.name ENDS WITH 'Lab' RETURN a, b", _edges(s, d), every=True)


@query
def graph_answer_projection(s, d):
    text = "MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE a.name STARTS WITH 'b' RETURN b"
    return pattern.answers(text, pattern.run(text, _edges(s, d), every=True))


@query
def graph_paths(s, d):
    return graph.paths(_edges(s, d), ("starts with", "ba"), (1, 3)).select(F.array_join("entities", " > ").alias("path"), F.array_join("relations", ",").alias("relations"), "hops")


@query
def graph_degree(s, d):
    return graph.degrees(_edges(s, d))


@query
def graph_degree_subgraph(s, d):
    return graph.top_subgraph(_edges(s, d), 60)[1].select("subject", "relation", "object", "count")


@query
def graph_components(s, d):
    from folioflow.operators.components import connected_components

    return connected_components(_edges(s, d).select("subject", "object"), "subject", "object").groupBy("component").agg(F.count("*").alias("entities"))


@query
def keyword_extract(s, d):
    return _documents(s, d).where("text is not null").select(F.explode(keywords("text")).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("documents"))


@query
def sentence_split(s, d):
    return _documents(s, d).where("text is not null").select("doc_id", F.size(sentences("text")).alias("sentences"))


@query
def section_grouping(s, d):
    return summary.section_groups(table(s, d, "chunks"))


@query
def summary_index(s, d):
    return summary.summary_index(table(s, d, "chunks"))


def _asked(s, d):
    return table(s, d, "answers_for_ragas").where("question is not null").groupBy("id").agg(F.min_by(F.struct("question", "pdf"), "answer_id").alias("x"), F.min("answer_id").alias("query_id")).select("query_id", "x.question", F.col("x.pdf").alias("source"))


@query
def section_retrieve(s, d):
    return summary.search_sections(_asked(s, d), summary.summary_index(table(s, d, "chunks")))


@query
def hierarchical_retrieve(s, d):
    q = _asked(s, d).where("query_id % 100 = 0")
    chunks = table(s, d, "chunks")
    index = cut(summary.summary_index(chunks))
    return summary.hierarchical(q, index, summary.search_paragraphs(q, index, chunks))


@query
def route_rules(s, d):
    a = table(s, d, "answers_for_ragas").where("question is not null")
    return a.select("answer_id", verify.route(F.col("question")).alias("r")).select("answer_id", "r.type", "r.confidence", "r.level", "r.tools", F.col("r.max_hops").alias("max_hops"))


@query
def think_strip(s, d):
    return table(s, d, "answers_for_ragas").select("answer_id", strip_think("answer").alias("answer"))


@query
def claim_check(s, d):
    return verify.checked_claims(table(s, d, "answers_for_ragas"))


@query
def faithfulness(s, d):
    return verify.faithfulness(table(s, d, "answers_for_ragas"))


@query
def self_consistency_pick(s, d):
    a = table(s, d, "answers_for_ragas").where("answer is not null").select(F.col("id").alias("query_id"), F.col("answer_id").alias("draft"), "answer", ((F.col("answer_id") % 5) / 4.0).alias("faithfulness"))
    return verify.best_draft(a).select("query_id", "draft", "faithfulness")


@query
def keyword_hit_ratio(s, d):
    return evaluate.answer_metrics(table(s, d, "answers_for_ragas")).select("answer_id", "context_recall", "completeness")


@query
def set_f1(s, d):
    a = table(s, d, "answers_for_ragas").where("answer is not null and answer_keys is not null")
    gold = F.filter("answer_keys", lambda k: k.isNotNull())
    scores = sets.set_scores(F.regexp_extract_all("answer", F.lit("[A-Za-z0-9]+"), F.lit(0)), gold)
    return a.select("answer_id", scores.alias("s")).select("answer_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def eval_rollup(s, d):
    a = table(s, d, "answers_for_ragas")
    keys = F.filter("answer_keys", lambda k: k.isNotNull() & (k != ""))
    n = F.coalesce(F.size(keys), F.lit(0))
    share = lambda text: F.when(n <= 0, 1.0).otherwise(F.size(F.filter(keys, lambda k: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(k)))) / n)
    return evaluate.roll_up(a.select("answer_id", "pdf", "type", "error", share(F.array_join(F.filter("contexts", lambda c: c.isNotNull()), " ")).alias("context_recall"), share(F.col("answer")).alias("completeness")))


@query
def confusion_counts(s, d):
    li = table(s, d, "lineitem").select((F.col("l_returnflag") == "R").alias("found"), (F.col("l_linestatus") == "F").alias("gold"))
    return evaluate.confusion(li)


@query
def retrieval_ablation(s, d):
    asked, q, v = _sampled(s, d)
    place = table(s, d, "documents").select("doc_id", "source")
    lex = lexical.search(asked, _documents(s, d), 5).select(F.lit("lexical").alias("mode"), "query_id", "doc_id", "rank")
    vec = vectors.batch_top_k(q, v, 5, "doc_id").select(F.lit("vector").alias("mode"), "query_id", "doc_id", "rank")
    return evaluate.retrieval_quality(lex.unionByName(vec).join(place, "doc_id"), asked.select("query_id", "expect_source"))


# --- operators of model replies, interfaces and layout, over recorded columns -----------------------------------------
@query
def bm25_kept_index(s, d):
    """The index is written to the shared folder, found fresh and searched."""
    docs = _documents(s, d)
    path = f"{ensure_checkpoint_dir(s)}/lexical-{uuid4().hex}"
    lexical.write_index(docs, path)
    return lexical.search_index(_items(s, d), lexical.read_index(docs, path), 15)


@query
def bm25_within_source(s, d):
    asked, _, _ = _sampled(s, d)
    return lexical.search_within(asked.where("expect_source is not null").select("query_id", "text", F.col("expect_source").alias("source")), _documents(s, d), 15)


@query
def hybrid_text_rrf(s, d):
    asked, q, v = _sampled(s, d)
    return retrieve.hybrid_texts(asked.select("query_id", "text"), _documents(s, d), v, q, 5).select("query_id", "text", F.array_join("ids", ",").alias("ids"), "rrf_score", "rank")


@query
def hit_projection(s, d):
    found = lexical.search(_items(s, d), _documents(s, d), 5).join(_documents(s, d), "doc_id")
    return fusion.hit_projection(found.select("query_id", "doc_id", "text", "score", (F.col("rank") - 1).cast("double").alias("rrf_score")))


@query
def collection_count(s, d):
    return table(s, d, "embeddings").agg(F.count("*").alias("vectors"))


@query
def rerank_reply(s, d):
    """Scores out of recorded replies: a JSON array with words around it for two thirds of the queries, loose text for the rest."""
    found = lexical.search(_items(s, d), _documents(s, d), 15)
    pairs = F.array_sort(F.collect_list(F.struct("rank", (F.col("rank") * 7 % 11).alias("s"))))
    strict = F.concat(F.lit("<think>[1]</think>Here: ["), F.array_join(F.transform(pairs, lambda x: F.concat(F.lit('{"index": '), x["rank"].cast("string"), F.lit(', "score": '), x["s"].cast("string"), F.lit("}"))), ", "), F.lit("] as asked"))
    loose = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("index: "), x["rank"].cast("string"), F.lit(", score: "), x["s"].cast("string"))), "\n")
    replied = found.where("rank <= 9").groupBy("query_id").agg(F.when(F.col("query_id") % 3 < 2, strict).otherwise(loose).alias("reply"))
    scores = replied.select("query_id", F.explode(replies.scores("reply")).alias("x")).select("query_id", "x.index", "x.score")
    return fusion.rerank(found.select("query_id", "doc_id", "rank"), scores, 5).select("query_id", "doc_id", "rerank_score", "new_rank")


def _graph_asked(s, d):
    return table(s, d, "answers_for_ragas").where("question is not null").groupBy("question").agg(F.min("answer_id").alias("query_id")).select("query_id", F.col("question").alias("text"))


@query
def graph_channel(s, d):
    return retrieve.graph_channel(retrieve.mentioned_edges(_graph_asked(s, d), _edges(s, d)))


@query
def channel_candidates(s, d):
    """What three channels give before diversity: the best score of each passage."""
    q = _graph_asked(s, d)
    chunks = table(s, d, "chunks").select(F.col("chunk_id").alias("doc_id"), "text")
    lex = lexical.search(q, chunks, 5).join(chunks, "doc_id").select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(0.3).alias("score"), F.lit("lexical").alias("source_tool"))
    first = lex.where("cast(doc_id as long) % 2 = 0").withColumn("score", F.lit(0.8)).withColumn("source_tool", F.lit("vector"))
    return retrieve.candidates([first, lex, retrieve.graph_channel(retrieve.mentioned_edges(q, _edges(s, d)))]).select("query_id", "doc_id", "score", "source_tool")


@query
def multi_channel_routed(s, d):
    """All channels that a question's route names, diversity, and the forced document summary."""
    q = _asked(s, d).where("query_id % 100 = 0")
    texts = q.select("query_id", F.col("question").alias("text"))
    chunks = table(s, d, "chunks")
    index = cut(summary.summary_index(chunks))
    passages = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    lex = lexical.search(texts, passages, 15).join(passages, "doc_id").select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(0.3).alias("score"), F.lit("lexical").alias("source_tool"))
    known = retrieve.graph_channel(retrieve.mentioned_edges(texts, _edges(s, d)))
    levels = retrieve.summary_channel(summary.hierarchical(q, index, summary.search_paragraphs(q, index, chunks)))
    return retrieve.multi_channel(retrieve.routed([lex, known, levels, retrieve.document_channel(q, index)], texts), texts)


@query
def mmr_diversity(s, d):
    found = lexical.search(_items(s, d), _documents(s, d), 15).join(_documents(s, d), "doc_id")
    words = lambda c: F.array_distinct(F.filter(F.split(evaluate.plain_fold(c), " "), lambda w: w != ""))
    asked = _items(s, d).select("query_id", words("text").alias("query_tokens"))
    return diversity.marginal_relevance(found.select("query_id", "doc_id", "rank", words("text").alias("tokens")).join(asked, "query_id"), 5, 0.6)


@query
def triple_extract(s, d):
    """Replies as a model writes them, from the triples themselves; the passage is what they were found in."""
    t = table(s, d, "kg_triples").where("subject is not null and relation is not null and object is not null")
    one = F.to_json(F.struct("subject", "relation", "object"))
    passages = t.select("triple_id", F.concat_ws(" ", F.lit("The passage states:"), "subject", "relation", F.when(F.col("triple_id") % 5 != 0, F.col("object"))).alias("text"), F.concat(F.lit("<think>\nsome [thoughts]</think>```json\n["), one, F.when(F.col("triple_id") % 7 == 0, "").otherwise("]"), F.lit("\n```")).alias("reply"))
    return replies.extracted(passages, ["triple_id"]).select("subject", "relation", "object", "triple_id")


@query
def graph_append(s, d):
    return graph.raw_edges(table(s, d, "kg_triples")).groupBy("subject", "relation", "object").agg(F.count("*").alias("rows"))


@query
def graph_nodes(s, d):
    return graph.nodes(_edges(s, d))


@query
def graph_node_sample(s, d):
    return graph.node_sample(_edges(s, d), 10)


@query
def graph_record_text(s, d):
    return pattern.as_text(pattern.run("MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE r.relation = 'uses' RETURN a, b", _edges(s, d), every=True))


@query
def graph_pattern_limit(s, d):
    return pattern.run("MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE NOT a.name CONTAINS 'lab' RETURN a, b LIMIT 7", _edges(s, d))


@query
def entity_resolve_judged(s, d):
    """Resolution with recorded judgements on the ends of triples that look alike."""
    t = table(s, d, "kg_triples")
    judged = t.where("subject is not null and object is not null").select(F.trim("subject").alias("a"), F.trim("object").alias("b"), (F.length("subject") % 2 == 0).alias("same")).groupBy("a", "b").agg(F.max("same").alias("same"))
    return graph.resolve_entities(graph.entity_frequency(t), judged)


@query
def graph_build(s, d):
    return graph.build(table(s, d, "kg_triples"))[1]


@query
def query_guard(s, d):
    """The guard over question texts, most of them no queries at all, and over some that are."""
    given = ["MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) RETURN a", "MATCH (a) WHERE a.name = 'training set' RETURN a", "MATCH (a) DELETE a RETURN a", "MATCH (a) RETURN a; MATCH (b) RETURN b", "OPTIONAL MATCH (a) RETURN a", "RETURN 1", "match (n) set n.x = 1 return n", "", "   "]
    return s.createDataFrame([(i, *pattern.guard(x)) for i, x in enumerate(given)], "no int, allowed boolean, reason string")


@query
def evidence_term_counts(s, d):
    each = table(s, d, "answers_for_ragas").where("answer is not null").select(F.explode(evidence_terms("answer")).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("answers"))


def _pages(s, d):
    """Passages as pages, some of which carry a caption."""
    c = table(s, d, "chunks").where("source is not null and page is not null and text is not null")
    mark = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("Figure "), (F.col("chunk_id") % 50).cast("string"), F.lit(": "))).when(F.col("chunk_id") % 7 == 0, F.concat(F.lit("Table "), (F.col("chunk_id") % 50).cast("string"), F.lit(" | "))).otherwise("")
    return c.groupBy("source", "page").agg(F.min_by(F.concat(mark, F.col("text")), "chunk_id").alias("text"))


@query
def captions(s, d):
    return layout.captions(_pages(s, d)).select("source", "page", "seq", "caption")


@query
def caption_match(s, d):
    figures = _pages(s, d).where("page % 2 = 0").select("source", "page", F.col("page").cast("double").alias("x0"))
    return layout.match_captions(figures, layout.captions(_pages(s, d))).select("source", "page", "x0", "caption")


@query
def figure_filter(s, d):
    return layout.figure_rows(_boxes(s, d).where("x0 is not null").withColumn("y1", F.col("y0") + F.col("x0") * 2).withColumn("x1", F.col("x0") + F.col("x0") * 1.5))


@query
def vector_figures(s, d):
    rows = table(s, d, "chunks").where("content_type = 'table' and source is not null and page is not null")
    cells = F.transform(F.split("text", "\n"), lambda x: F.transform(F.split(x, r" \| "), lambda c: F.when(F.length(c) % 2 == 0, c)))
    box = F.struct(cells.alias("cells"), F.col("chunk_id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    drawings = rows.groupBy("source", "page").agg(F.array_sort(F.collect_list(box)).alias("tables"), (F.sum("chunk_id") % 31).alias("n_shapes"))
    return layout.vector_figures(drawings).select("source", "page", "x0")


def _characters(s, d):
    """Characters with a place, from line items: 100 to a page row."""
    li = table(s, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("source"), (F.col("l_orderkey") % 40).cast("int").alias("page"), (F.col("l_extendedprice") % 600).cast("double").alias("x0"), (F.col("l_quantity") * 16).cast("double").alias("top"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


@query
def column_count(s, d):
    return layout.column_count(_characters(s, d))


@query
def chars_to_text(s, d):
    p = table(s, d, "headers").where("source is not null and page is not null and title is not null").groupBy("source", "page").agg(F.min("title").alias("t"))
    chars = p.select("source", "page", F.posexplode(F.split("t", "")).alias("i", "char")).where("char not in ('', ' ')")
    return layout.chars_to_text(chars.select("source", "page", F.floor(F.col("i") / 20).cast("double").alias("top"), (F.col("i") * 6.0).alias("x0"), (F.col("i") * 6.0 + 5).alias("x1"), "char").withColumn("top", F.col("top") * 10))


@query
def section_guess(s, d):
    return table(s, d, "chunks").where("text is not null").select("chunk_id", chunking.guess_section(F.col("text")).alias("section"))


@query
def document_chunks(s, d):
    pages = table(s, d, "documents").where("source is not null and text is not null").select("source", F.coalesce("page", F.lit(0)).alias("page"), F.col("doc_id").alias("page_seq"), "text")
    rows = table(s, d, "chunks").where("content_type = 'table' and source is not null").select("source", F.coalesce("page", F.lit(0)).alias("page"), F.col("chunk_id").alias("page_seq"), F.transform(F.split("text", "\n"), lambda x: F.split(x, r" \| ")).alias("cells"))
    return chunking.chunk_documents(rows, pages)


@query
def sentence_scores(s, d):
    return summary.sentence_scores(_documents(s, d)).select("doc_id", "sentence_no", "score")


@query
def level_text(s, d):
    return summary.level_text(cut(summary.summary_index(table(s, d, "chunks"))), "section")


@query
def plain_key_hits(s, d):
    return evaluate.plain_hit_ratio(table(s, d, "answers_for_ragas"))


@query
def evaluation_rows(s, d):
    return evaluate.evaluation_rows(table(s, d, "answers_for_ragas")).select("answer_id", "context_recall", "completeness", "faithfulness", "needs_retry")


@query
def evaluation_report(s, d):
    return evaluate.report(eval_rollup(s, d))


@query
def judged_scores(s, d):
    reply = F.when(F.col("answer_id") % 4 == 0, "no figures").otherwise(F.concat(F.lit('Sure: {"recall": 0.'), (F.col("answer_id") % 10).cast("string"), F.lit(', "faithfulness": 1.0}')))
    return evaluate.judged_scores(table(s, d, "answers_for_ragas").withColumn("reply", reply))


@query
def retrieval_keywords(s, d):
    a = table(s, d, "answers_for_ragas").where("question is not null and answer_keys is not null and answer_id % 10 = 0").select(F.col("answer_id").alias("query_id"), F.col("question").alias("text"), F.col("answer_keys").alias("keys"))
    chunks = table(s, d, "chunks").select(F.col("chunk_id").alias("doc_id"), "text")
    found = lexical.search(a, chunks, 5).join(chunks, "doc_id")
    return evaluate.keyword_ratio(found.select(F.lit("lexical").alias("mode"), "query_id", "text"), a)


@query
def key_sentences(s, d):
    """Sentences of documents by the recorded vectors of their documents."""
    asked, q, v = _sampled(s, d)
    said = _documents(s, d).where("text is not null").select("doc_id", F.posexplode(sentences("text")).alias("n", "sentence")).select("doc_id", (F.col("doc_id") * 1000 + F.col("n")).alias("sentence_id"), "sentence")
    near = vectors.batch_top_k(q, v, 5, "doc_id").select("query_id", "doc_id").join(said, "doc_id")
    held = said.join(v, "doc_id").select("sentence_id", F.col("embedding").alias("vector"))
    return verify.key_sentences(near.drop("doc_id"), held, q)


@query
def route_arbitration(s, d):
    a = table(s, d, "answers_for_ragas").where("question is not null")
    reply = F.concat(F.lit('I think {"type": "'), F.coalesce("type", F.lit("none")), F.lit('", "confidence": 0.'), (F.col("answer_id") % 10).cast("string"), F.lit("}"))
    both = a.select("answer_id", verify.route(F.col("question")).alias("r"), replies.classified(reply).alias("m"))
    return both.select("answer_id", verify.arbitrate(F.col("r.type"), F.col("r.confidence"), F.col("m.type"), F.col("m.confidence")).alias("x")).select("answer_id", "x.type", "x.source")


@query
def retry_queries(s, d):
    return retrieve.retry_queries(verify.checked_claims(table(s, d, "answers_for_ragas"))).select("query_id", F.array_join("retries", " | ").alias("retries"))


@query
def answer_orchestration(s, d):
    """Questions answered by a stand-in for a model that repeats its first passage, in three drafts."""
    q = _graph_asked(s, d)
    chunks = table(s, d, "chunks").select(F.col("chunk_id").alias("doc_id"), "text")
    model = Providers(chat=lambda prompt: "<think>hm</think>" + prompt.partition("[Passage 1] ")[2].partition("\n\n")[0])
    return retrieve.answer_with_retrieval(q, lambda q: lexical.search(q, chunks, 5).join(chunks, "doc_id"), model)


@query
def answer_projection(s, d):
    a = table(s, d, "answers_for_ragas").select("answer_id", F.filter("contexts", lambda c: c.isNotNull()).alias("passages"), (F.col("answer_id") / 7.0).alias("confidence"))
    return retrieve.answer_projection(a).select("answer_id", F.array_join("passages", "|").alias("passages"), "confidence")


@query
def ingest_report(s, d):
    docs, c = table(s, d, "documents").where("source is not null"), table(s, d, "chunks")
    return files.ingest_report(docs, c)
