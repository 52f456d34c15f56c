"""Channels, replies and kept tables, with stand-ins for models, on stated cases, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from folioflow import schema
from folioflow.operators import chunking, evaluate, fusion, lexical, replies, summary, verify
from folioflow.plans import retrieve
from folioflow.providers import MissingProvider, Providers
from folioflow.sources import files

DOCS = [(1, "sparse attention for retrieval", "a"), (2, "dense retrieval of passages", "b"), (3, None, "a"), (4, "", "a"), (5, "sparse attention for retrieval", "b")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("term", F.lit("clash"))


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("Kuva Net", "uses", "Graph", 2), ("Kuva Net", "proposes", "Loss", 1), ("Boli", "uses", "Graph", 1)], "subject string, relation string, object string, count long")


def test_a_kept_index_finds_the_same_and_notices_new_texts(spark, docs, tmp_path):
    asked = spark.createDataFrame([(1, "sparse sparse retrieval"), (2, None), (3, "nothing here")], "query_id long, text string")
    path = str(tmp_path / "index")
    assert lexical.read_index(docs, path) is None
    lexical.write_index(docs, path)
    assert rows(lexical.search_index(asked, lexical.read_index(docs, path))) == rows(lexical.search(asked, docs)) != []
    assert lexical.read_index(docs.unionByName(docs.where("doc_id = 1")), path) is None
    assert lexical.search(asked, docs.limit(0)).count() == 0
    own = spark.createDataFrame([(1, "retrieval", "b")], "query_id long, text string, source string")
    assert {r["doc_id"] for r in lexical.search_within(own, docs).collect()} <= {2, 5}


def test_copies_fuse_to_one_text_with_all_ids(spark, docs):
    ranks = lambda *ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id long, doc_id long, rank long").join(docs.select("doc_id", "text"), "doc_id")
    got = fusion.fuse_texts([ranks(1, 2), ranks(2, 5, 1)]).orderBy("rank").collect()
    assert [(r["ids"], r["rank"]) for r in got] == [([2], 1), ([1, 5], 2)] or [(r["ids"], r["rank"]) for r in got] == [([1, 5], 1), ([2], 2)]
    assert sum(len(r["ids"]) for r in got) == 3


def test_replies(spark):
    said = ['[{"index": 1, "score": 4.5}]', "<think>[9]</think>index: 2, score: 7", "no idea", None, "[broken", '[{"index": 1}]']
    df = spark.createDataFrame(list(enumerate(said)), "i int, r string")
    got = [[tuple(x) for x in r["s"]] for r in df.select("i", replies.scores("r").alias("s")).orderBy("i").collect()]
    assert got == [[(1, 4.5)], [(2, 7.0)], [], [], [], []]
    kinds = spark.createDataFrame([('so {"type": "Summary", "confidence": 3}',), ('{"type": "odd"}',), ("?",), (None,)], "r string")
    assert [tuple(r["c"]) for r in kinds.select(replies.classified("r").alias("c")).collect()] == [("summary", 1.0), ("fact", 0.5), ("fact", 0.3), ("fact", 0.3)]
    text = "Kuva Net uses Graph in all its parts"
    told = [(1, text, '```json\n[{"subject": "Kuva Net", "relation": "uses", "object": "Graph"}, {"subject": "Kuva Net", "object": "x"}]\n```'), (2, "short", '[{"subject": "a", "relation": "b", "object": "c"}]'), (3, text, "nothing"), (4, text, None)]
    found = replies.extracted(spark.createDataFrame(told, "chunk long, text string, reply string"), ["chunk"])
    assert rows(found.select("subject", "relation", "object", "chunk")) == [("Kuva Net", "uses", "Graph", 1)]


def test_graph_search_asks_twice_and_falls_back(spark, edges):
    good = "```\nMATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE a.name = 'kuva net' RETURN a, b\n```"
    empty = "MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE a.name = 'nobody' RETURN a, b"

    def model(*said):
        left = list(said)
        return Providers(chat=lambda prompt: left.pop(0))

    for said, how, n in (([good], "graph", 2), ([empty, good], "retry", 2), (["MATCH (a) DELETE a RETURN a", "what?"], "empty", 0), ([empty, empty], "empty", 0)):
        found, by = retrieve.graph_search("What does Kuva Net use?", edges, model(*said))
        assert (by, found.count()) == (how, n)
    assert retrieve.graph_search("?", edges, model("", ""), edges.limit(1))[1] == "fallback"
    with pytest.raises(MissingProvider):
        retrieve.graph_search("?", edges, Providers())


def test_names_are_met_word_for_word(spark, edges):
    asked = spark.createDataFrame([(1, "What does KUVA-NET use?"), (2, "Is Bolivia in it?"), (3, None), (4, "")], "query_id long, text string")
    assert {(r["query_id"], r["object"]) for r in retrieve.mentioned_edges(asked, edges).collect()} == {(1, "Graph"), (1, "Loss")}
    assert retrieve.graph_channel(retrieve.mentioned_edges(asked, edges), 1).select("text").first()[0] == "subject=Kuva Net, predicate=uses, object=Graph"


def test_a_cross_encoder_chooses_and_the_document_summary_keeps_its_place(spark):
    asked = spark.createDataFrame([(1, "Give an overview of sparse attention")], "query_id long, text string")
    hit = lambda tool, *pairs: spark.createDataFrame([(1, i, t, s, tool) for i, t, s in pairs], "query_id long, doc_id string, text string, score double, source_tool string")
    vector = hit("vector", *((str(i), f"passage {'x' * i} number {i}", 0.9 - i / 100) for i in range(8)))
    floor = hit("summary_doc", ("summary:1", "all of it", 0.4))
    judge = Providers(cross_encode=lambda pairs: [float(len(p)) for _, p in pairs])
    got = [r["doc_id"] for r in retrieve.multi_channel([vector, floor], asked, 3, providers=judge).orderBy("rank").collect()]
    assert got[0] == "7" and got[-1] == "summary:1" and len(got) == 3
    quantity = asked.select("query_id", F.lit("Compare A versus B").alias("text"))
    assert [c.count() for c in retrieve.routed([vector, floor], quantity)] == [8, 0]


def test_imagined_passages_and_other_models(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "silent"), (4, None)], "query_id long, text string")

    def chat(prompt):
        if prompt.endswith("bad"):
            raise RuntimeError
        return "" if prompt.endswith("silent") else "a passage"

    model = Providers(chat=chat, embed=lambda texts: [[3.0, 4.0] for _ in texts], judge=lambda a, b: a == b, ocr=lambda picture: picture.decode())
    assert [(r["query_id"], [round(x, 2) for x in r["q"]]) for r in retrieve.imagined_vectors(asked, model).collect()] == [(1, [0.6, 0.8])]
    df = spark.createDataFrame([("x", "x", bytearray(b"page")), ("x", "y", None)], "a string, b string, c binary")
    assert [tuple(r) for r in df.select(model.same("a", "b"), model.page_text("c")).collect()] == [(True, "page"), (False, None)]


def test_tables_come_before_pages_under_one_index(spark):
    pages = spark.createDataFrame([("s", 1, 1, "a page of text that is long enough"), ("s", 2, 2, "another page of text, long enough too"), ("s", 2, 3, None), ("t", 1, 4, "short")], "source string, page int, page_seq long, text string")
    tables = spark.createDataFrame([("s", 2, 9, [["name", "score"], ["x", "1"]]), ("s", 1, 8, [["only"]])], "source string, page int, page_seq long, cells array<array<string>>")
    got = chunking.chunk_documents(tables, pages).orderBy("source", "chunk_index").collect()
    assert [(r["chunk_index"], r["content_type"], r["page"]) for r in got] == [(0, "table", 2), (1, "text", 1), (2, "text", 2)]
    assert chunking.chunk_documents(tables.limit(0), pages.limit(0)).count() == 0


def test_kept_files(spark, tmp_path):
    triples = spark.createDataFrame([("A", "uses", "B", 1, None, None)], schema.TRIPLE)
    files.write_triples(triples, str(tmp_path / "t"))
    assert [r["subject"] for r in spark.read.schema(schema.TRIPLE).json(str(tmp_path / "t")).collect()] == ["A"]
    files.reset(spark, str(tmp_path / "c"), schema.CHUNK)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 0
    docs, chunks = spark.createDataFrame([("a",), ("b",)], "source string"), spark.createDataFrame([("a",)], "source string")
    assert rows(files.ingest_report(docs, chunks, ["a", "b", "c"])) == [("a", "ok", 1), ("b", "empty", 0), ("c", "missing", 0)]
    assert docs.select(files.default_source(docs)).first()[0] == "a" and docs.select(files.default_source(docs.limit(0), "z")).first()[0] == "z"


def test_sentences_and_scores(spark):
    v = lambda *x: list(map(float, x))
    said = spark.createDataFrame([(1, 10, "The same opening of a sentence here"), (1, 11, "the same opening of a sentence HERE"), (1, 12, "short"), (1, 13, "Something else is said in this one")], "query_id long, sentence_id long, sentence string")
    vectors = spark.createDataFrame([(10, v(1, 0)), (11, v(1, 1)), (12, v(1, 0)), (13, v(0, 1))], "sentence_id long, vector array<double>")
    got = verify.key_sentences(said, vectors, spark.createDataFrame([(1, v(1, 0))], "query_id long, q array<double>")).orderBy("rank").collect()
    assert [(r["sentence"][:8], r["score"]) for r in got] == [("The same", 1.0), ("Somethin", 0.0)]
    text = "Kuva reaches 45.9 points on retrieval today. It was built with 1,200 GPUs and data."
    scored = summary.sentence_scores(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("sentence_no").collect()
    first = "Kuva reaches 45.9 points on retrieval today."
    assert len(scored) == 2 and scored[0]["score"] == round((6 + 1.5) * 1.3 / (1 + abs(len(first) - 180) / 180), 6)
    near = spark.createDataFrame([(v(1, 0), v(1, 0)), (v(1, 0), v(-1, 0)), (None, v(1, 0)), (v(0, 0), v(1, 0))], "q array<double>, a array<double>")
    assert [r[0] for r in near.select(evaluate.relevancy(F.col("q"), F.col("a"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    keys = spark.createDataFrame([(1, "fine-tuned on 1,200 items", ["fine tuned", "1200", None, ""]), (2, None, None)], "answer_id long, answer string, answer_keys array<string>")
    assert rows(evaluate.plain_hit_ratio(keys)) == [(1, 2, 2, 1.0), (2, 0, 0, 1.0)]


def test_search_makes_no_pairs_of_queries_and_texts(spark):
    """Every query shares a word with every text; only what may be among the best becomes rows."""
    from pyspark.sql import functions as F

    from folioflow.operators import lexical

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word w"), (F.col("id") % 40).cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("common w"), (F.col("id") % 50).cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    vocab = lexical.vocabulary(docs)
    each = docs.select("doc_id", "source", F.explode(F.split("text", " ")).alias("term")).join(lexical.term_weights(vocab), "term")
    pairs = lexical.asked_terms(asked).join(each, "term").groupBy("query_id", "doc_id", "source").agg(F.round(F.sum(F.col("qf") * F.col("idf")), 6).alias("score"))
    full = {(r["query_id"], r["doc_id"], r["rank"]) for r in lexical.ranked(pairs, 7).collect()}  # all texts have three words, so a term counts its weight
    found = lexical.search(asked, docs, 7)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()} == full
    own = lexical.ranked(pairs.join(asked.select("query_id", "source"), ["query_id", "source"]), 7)
    within = lexical.search_within(asked, docs, 7)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in within.collect()} == {(r["query_id"], r["doc_id"], r["rank"]) for r in own.collect()}
    for df in (found, within):  # the plan ends in what was found: 2,100 rows, not 120,000 pairs
        assert df.count() == 2100 and "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_texts_agree_with_all_scores():
    import numpy as np

    from folioflow.functions.impact import Block

    rng = np.random.default_rng(5)
    n, terms = 600, 60
    held = rng.random((terms, n)) < np.linspace(0.01, 0.6, terms)[:, None]
    term, doc = np.nonzero(held)
    impact = rng.choice([0.5, 1.0, 1.25], len(term))
    full = np.zeros((terms, n))
    full[term, doc] = impact
    block = Block(term, doc, impact, terms, n)
    queries = [(t := rng.choice(terms, size, replace=False), rng.choice([0.1, 2.0, 5.0, -0.5] if size == 7 else [0.1, 2.0, 5.0], len(t))) for size in [1, 2, 4, 6, 7, 30] * 20]
    for q, docs, scores in block.search(queries, 5):
        every = queries[q][1] @ full[queries[q][0]]
        best = [d for d in np.lexsort((np.arange(n), -np.round(every, 6)))[:5] if every[d] > 1e-9]
        assert set(best) <= set(docs.tolist()) and np.allclose(every[docs], scores)


def test_drafts_are_written_once_and_judged_as_written(spark):
    import itertools

    from folioflow.plans import retrieve
    from folioflow.providers import Providers

    turn = itertools.count()
    model = Providers(chat=lambda p: f"Draft {next(turn)} says that Alpha Model has 12 layers in it.")
    hits = spark.createDataFrame([(1, "Alpha Model has 12 layers.", 1)], "query_id long, text string, rank long")
    got = retrieve.answer(spark.createDataFrame([(1, "How many layers?")], "query_id long, text string"), hits, model).first()
    assert got["answer"] == "Draft 0 says that Alpha Model has 12 layers in it."
