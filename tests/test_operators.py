from pyspark.sql import functions as F

from conftest import rows
from folioflow.operators import chunking, evaluate, fusion, graph, layout, lexical, summary, vectors, verify
from folioflow.operators.components import connected_components
from folioflow.plans import pattern, retrieve
from folioflow.providers import MissingProvider, Providers
from folioflow.sources import files

import pytest


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (1, 1), (None, 2), (8, 7)], "u long, v long")
    assert rows(connected_components(e)) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
    assert connected_components(e.limit(0)).count() == 0
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(path).select("component").distinct().count() == 1


def test_sections_follow_the_last_heading(spark):
    h = spark.createDataFrame([("a", "h1", "One", 2, 5), ("a", "h2", "Sub", 2, 9), ("a", "h1", "Two", 4, 1), ("a", "h2", "Late", 4, 0)], "source string, level string, title string, page int, line int")
    c = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "a", 5), (5, "b", 1), (6, None, 1)], "chunk_id long, source string, page int")
    assert rows(chunking.sections(c, h).select("chunk_id", "heading")) == [(1, chunking.FRONT), (2, "One > Sub"), (3, "One > Sub"), (4, "Two"), (5, ""), (6, None)]
    assert chunking.sections(c.limit(0), h).count() == 0


def test_running_lines(spark):
    p = spark.createDataFrame([("a", i, f"Report {i}\nbody {i}\npage {i}") for i in range(4)] + [("b", 0, "Report 1\nx\ny")], "source string, page_id int, text string")
    assert rows(layout.remove_running_lines(p)) == [("a", i, f"body {i}") for i in range(4)] + [("b", 0, "Report 1\nx\ny")]


def test_regions_and_captions(spark):
    f = spark.createDataFrame([("a", 1, 0.0, 0.0, 5.0, 5.0), ("a", 1, 4.0, 4.0, 9.0, 9.0), ("a", 1, None, None, None, None), ("a", 2, None, None, None, None)], "source string, page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.merge_regions(f)) == [("a", 1, 0.0, 0.0, 9.0, 9.0, 2), ("a", 2, None, None, None, None, 1)]
    pages = spark.createDataFrame([("a", 1, "Figure 1: first\nFigure 2: second"), ("a", 3, "Table 4 | alone")], "source string, page int, text string")
    got = rows(layout.match_captions(f.select("source", "page").distinct(), layout.captions(pages)))
    assert got == [("a", 1, "Figure 1: first"), ("a", 2, None), ("a", 3, "Table 4 | alone")]


def test_column_count(spark):
    two = [("a", 1, float(x), 100.0, 600.0, 800.0) for x in [50] * 150 + [350] * 150]
    df = spark.createDataFrame(two + [("a", 2, 10.0, 100.0, 600.0, 800.0)], "source string, page int, x0 double, top double, width double, height double")
    assert rows(layout.column_count(df)) == [("a", 1, 2), ("a", 2, 1)]


def test_fusion_is_the_same_whatever_the_partitioning(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, text string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, text string, rank int")
    got = rows(fusion.reciprocal_rank([a, b]).select("text", "rank"))
    assert got == [("x", 2), ("y", 1), ("z", 3)]
    best = fusion.keep_best(spark.createDataFrame([("k", 1.0, 2), ("k", 1.0, 1), ("j", 0.5, 3)], "key string, score double, seq int"), ["key"])
    assert rows(best.select("key", "seq", "first_seq")) == [("j", 3, 3), ("k", 1, 1)]


def test_lexical_search_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "gamma"), (5, ""), (6, "delta")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "ALPHA"), (8, None)], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in lexical.search(q, d, 5).orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 2)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert rows(vectors.batch_top_k(q, v, 2)) == [(1, 1, 1.0, 1), (1, 4, 0.707107, 2)]
    assert vectors.batch_top_k(q.limit(0), v, 2).count() == 0
    many = v.where("vec_id <> 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).where("size(q) = 2")
    whole = rows(vectors.batch_top_k(many, v, 2))
    vectors.QUERY_BLOCK, kept = 1, vectors.QUERY_BLOCK
    try:
        assert rows(vectors.batch_top_k(many, v, 2)) == whole and len(whole) == 6
    finally:
        vectors.QUERY_BLOCK = kept
    assert rows(vectors.top_k(v.where("size(embedding) = 2"), [0.0, 1.0], 1)) == [(2, 1.0, 1)]


def test_relations(spark):
    df = spark.createDataFrame([("based on",), ("focuses on",), (" Vs ",), ("other",)], "relation string")
    got = [(r[0], r[1]) for r in df.select(graph.relation_by_stem(F.col("relation")), graph.relation_by_synonym(F.col("relation"))).collect()]
    assert got == [("based_on", "uses"), ("uses", "focuses on"), ("Vs", "compared_with"), ("other", "other")]


def test_merge_counts_first_page_and_drops_citations(spark):
    t = spark.createDataFrame([(1, "A", "use", "B", 2, 7, "s"), (2, "A", "uses", "B", None, 3, "t"), (3, "A", "cites", "B", 1, 1, "u"), (4, " ", "use", "B", 1, 1, "u"), (5, None, "use", "B", 1, 1, "u")], "triple_id long, subject string, relation string, object string, count long, source_page int, source_section string")
    assert rows(graph.merge_triples(t)) == [("A", "uses", "B", 3, 7, "s")]
    mapping = spark.createDataFrame([("B", "Beta")], "raw string, canonical string")
    assert rows(graph.merge_triples(t, mapping))[0][2] == "Beta"


def by_hand(frequency, judged=(), budget=20):
    """Resolution as it is defined, over all pairs."""
    from difflib import SequenceMatcher

    order = sorted(frequency, key=lambda e: (-frequency[e], -len(e), e))
    low = {e: e.lower() for e in order}
    within = {e: sum(len(x) > len(e) and low[e] in low[x] for x in order) for e in order}
    goes, asks = {}, 0
    for i, a in enumerate(order):
        if a in goes:
            continue
        for b in order[i + 1 :]:
            if b in goes:
                continue
            if low[a] in low[b] or low[b] in low[a]:
                short, long = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
                if within[short] <= 1:
                    goes[short] = long
                continue
            ratio = SequenceMatcher(None, *sorted((low[a], low[b]))).ratio()
            if ratio >= 0.88 or ratio >= 0.75 and (min(a, b), max(a, b)) in judged:
                goes[b] = a
    def end(e):
        return end(goes[e]) if e in goes else e

    return {e: end(e) for e in order}


def test_resolution_order(spark):
    freq = lambda d: spark.createDataFrame(list(d.items()), "entity string, freq long")
    names = {"Orvella-M1": 5, "Orvella-M1-80k": 2, "orvella": 1, "VEQ": 9, "VEQ-M3": 3, "VEQ-Large": 2, "orvellam1x": 3, "orvellam2x": 1, "Bazateke": 4, "bazateke": 2, "BAZATEKE": 1, "abcdefgh": 3, "abcdefxy": 1}
    got = dict(rows(graph.resolve_entities(freq(names))))
    assert got == by_hand(names) and got["Orvella-M1"] == "Orvella-M1-80k" and got["VEQ"] == "VEQ" and got["abcdefxy"] == "abcdefxy"
    judged = spark.createDataFrame([("abcdefxy", "abcdefgh", True), ("VEQ", "orvella", True)], "a string, b string, same boolean")
    assert dict(rows(graph.resolve_entities(freq(names), judged))) == by_hand(names, {("abcdefgh", "abcdefxy")})
    assert dict(rows(graph.resolve_entities(freq(names), judged, budget=0))) == got


def test_resolution_against_all_pairs(spark, root):
    from folioflow.runtime import table

    freq = graph.entity_frequency(table(spark, root, "kg_triples"))
    assert dict(rows(graph.resolve_entities(freq))) == by_hand(dict(rows(freq)))


def test_entity_pairs(spark):
    f = spark.createDataFrame([("VEQ", 3), ("veq-m3", 1), ("x", 1), ("Attention", 2), ("Atention", 1)], "entity string, freq long")
    assert rows(graph.entity_candidates(f)) == [("VEQ", "veq-m3")]
    assert [(r["a"], r["b"]) for r in graph.similar_entities(f, 0.88).collect()] == [("Atention", "Attention")]
    assert dict(rows(graph.resolve_entities(f)))["Atention"] == "Attention"


def test_a_name_in_several_longer_ones_stays_although_one_is_in_its_block(spark):
    f = spark.createDataFrame([("Bazateke Lab", 3), ("BAZATEKE LAB:", 1), ("Bazateke Lab base", 1)], "entity string, freq long")
    assert dict(rows(graph.resolve_entities(f)))["Bazateke Lab"] == "Bazateke Lab"


def test_similar_names_are_all_found(spark):
    import random
    from difflib import SequenceMatcher

    r = random.Random(3)
    base = ["Pulisuku Institute", "Bazateke Lab", "aaaaaaaaaa", "ab", "Orvella-M1-80k", "x"]
    names = {"[Pulisuku Institute]", '"Pulisuku Institute"'}
    for _ in range(300):
        e = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            e[r.randrange(len(e))] = r.choice(["", "q", "z[", e[0]])
        names.add("".join(e))
    names = sorted(names - {""})
    f = spark.createDataFrame([(n, 1) for n in names], "entity string, freq long")
    for least in (0.88, 0.75):
        want = {(a, b) for a in names for b in names if a < b and round(SequenceMatcher(None, a.lower(), b.lower()).ratio(), 6) >= least}
        assert {(x["a"], x["b"]) for x in graph.similar_entities(f, least).collect()} == want


def test_guard_and_parser(spark):
    assert pattern.guard("MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE a.name = 'training SET' RETURN b")[0]
    for bad in ("", None, "CREATE (a)", "MATCH (a) DELETE a RETURN a", "MATCH (a)", "MATCH (a) RETURN a; MATCH (b) RETURN b"):
        assert not pattern.guard(bad)[0]
    e = spark.createDataFrame([("A", "uses", "B", 1), ("B", "uses", "C", 1), ("C", "uses", "A", 1), ("A", "is_a", "Model one", 2)], "subject string, relation string, object string, count long")
    q = "MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE (a.name = 'a' OR b.name CONTAINS 'model one') AND r.relation IN ['uses', 'is_a'] RETURN b.name"
    assert rows(pattern.run(q, e)) == [("A", "is_a", "Model one", 2), ("A", "uses", "B", 1)]
    back = "MATCH (a:Entity)<-[:RELATES_TO]-(b:Entity) WHERE a.name = 'B' RETURN b"
    assert rows(pattern.answers(back, pattern.run(back, e))) == [("A",)]
    path = "MATCH p = (a:Entity)-[:RELATES_TO*2..3]->(b:Entity) WHERE a.name = 'A' RETURN p"
    assert [r["entities"] for r in pattern.run(path, e).collect()] == [["A", "B", "C"]]
    for bad in ("MATCH (a:Entity) RETURN a", "MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE a.size = 1 RETURN a"):
        with pytest.raises(pattern.PatternError):
            pattern.run(bad, e)


def test_paths_are_simple(spark):
    e = spark.createDataFrame([(a, "r", b, 1) for a in "abcd" for b in "abcd" if a != b], "subject string, relation string, object string, count long")
    for r in graph.paths(e, ("=", "a"), (1, 3)).collect():
        assert len(set(r["entities"])) == len(r["entities"]) == r["hops"] + 1


def test_summaries(spark):
    text = " ".join(f"Sentence number {i} speaks about Topic{i} and value {i}{i}." for i in range(30))
    assert summary.summarise(text, 5).count("Sentence") <= 6
    assert summary.summarise("short", 5) == "short" and summary.summarise(None) == ""
    c = spark.createDataFrame([(i, "a", None if i % 2 else "S", 1, f"The chunk number {i} mentions Item{i}.") for i in range(300)], "chunk_id long, source string, section string, page int, text string")
    got = summary.summary_index(c)
    assert sorted((r["level"], r["section"]) for r in got.collect()) == [("document", ""), ("section", "(unsectioned)"), ("section", "S")]
    assert summary.summary_index(c.limit(0)).count() == 0


def test_large_groups_are_summarised_as_the_joined_text_is(spark):
    import random

    r = random.Random(7)
    words = [f"{a}{b}" for a in ("Graph", "net", "Inter", "model", "data-", "un") for b in ("work", "node", "Layer", "7b", "s", "net")]
    text = lambda: " ".join(r.choice(words) + r.choice(["", "", ".", " 1,2" + str(r.randint(0, 99)), "  ", "! Then", "? x"]) for _ in range(r.randint(0, 30)))
    data = [(g, i, text()) for g, n in (("a", 150), ("b", 64), ("c", 3), ("d", 70)) for i in range(n)] + [("e", i, "tiny") for i in range(200)] + [("f", i, "One sentence that is long enough here." if i == 50 else "") for i in range(80)]
    r.shuffle(data)
    expected = {g: summary.summarise(" ".join(t for _, _, t in sorted(x for x in data if x[0] == g)), 4) for g in "abcdef"}
    items = spark.createDataFrame(data, "k string, ord long, text string")
    assert dict(rows(summary.summarise_groups(items, ["k"], 4))) == expected
    assert dict(rows(summary._summarise_large(items, ["k"], 4, bound=300))) == expected


def test_paragraphs_come_from_the_own_source(spark):
    text = ["Alpha Gadget one is described here in full.", "Nothing of that kind is written in this.", "The Gadget alone is named in this part.", "Other words."]
    c = spark.createDataFrame([(i, "a", s, 1, t) for i, (s, t) in enumerate(zip(("S", "S", "", "T"), text))] + [(100 + i, "b", "S", 1, f"Alpha Gadget {i} of another paper.") for i in range(20)], "chunk_id long, source string, section string, page int, text string")
    q = spark.createDataFrame([(1, "Alpha Gadget?", "a"), (2, "Zebra?", "a")], "query_id long, question string, source string")
    index = summary.summary_index(c)
    # first: drill-down and keyword; then keyword alone at place 2 and drill-down alone at place 2 with its bonus
    assert set(rows(summary.search_paragraphs(q, index, c))) == {(1, text[0], 1), (1, text[1], 2), (1, text[2], 3), *((2, t, i + 1) for i, t in enumerate(text))}
    near = spark.createDataFrame([(1, text[3], 1)], "query_id long, text string, rank int")
    assert (1, text[3], 3) in rows(summary.search_paragraphs(q, index, c, vector_hits=near))


def test_a_brief_document_summary_is_redrawn(spark):
    c = spark.createDataFrame([(i, "a", f"S{i}", i, f"Part {i}. Brief {i}.") for i in range(2)] + [(9, "a", "S0", 3, "No sentence")], "chunk_id long, source string, section string, page int, text string")
    assert rows(summary.summary_index(c).where("level = 'document'").select("text")) == [("Part 0. Brief 0. Part 1. Brief 1. No sentence",)]


def test_diversity_weighs_all_candidates(spark):
    q = spark.createDataFrame([(1, "red fox den")], "query_id long, text string")
    schema = "query_id long, doc_id long, text string, score double, source_tool string"
    vector = spark.createDataFrame([(1, i, "red same words", 0.9 - i / 100, "vector") for i in range(15)], schema)
    lexical_ = spark.createDataFrame([(1, 50, "fox den here", 0.3, "lexical")], schema)
    assert (1, 50, 1) in rows(retrieve.multi_channel([vector, lexical_], q, k=2))
    document = spark.createDataFrame([(1, -1, "nothing alike", 0.4, "summary_doc")], schema)
    assert rows(retrieve.multi_channel([vector, lexical_, document], q, k=2)) == [(1, -1, 2), (1, 50, 1)]
    assert (1, -1, 2) in rows(retrieve.multi_channel([vector.where("doc_id = 0"), document], q))


def test_faithfulness(spark):
    a = spark.createDataFrame([(1, "The Model reaches 45 points here. The Model beats Other by 99 points.", ["model reaches 45 points"]), (2, None, ["x"]), (3, "Some answer stands here.", []), (4, "Some answer stands here.", None)], "answer_id long, answer string, contexts array<string>")
    assert rows(verify.faithfulness(a).select("answer_id", "n_claims", "n_supported", "faithfulness", "needs_retry")) == [(1, 2, 1, 0.5, True), (2, 0, 0, 1.0, False), (3, 0, 0, 1.0, False), (4, 0, 0, 1.0, False)]


def test_routes(spark):
    q = spark.createDataFrame([("Summarize the paper",), ("How many layers are used?",), ("Who proposed X?",), ("What does Figure 2 show?",)], "q string")
    assert [(r[0]["type"], r[0]["tools"]) for r in q.select(verify.route(F.col("q"))).collect()] == [("summary", "summary_index,vector"), ("fact", "vector,summary_index"), ("relation", "graph,vector"), ("fact", "vector,summary_index,vlm")]
    m = spark.createDataFrame([("fact", 0.5, "relation", 0.9), ("fact", 0.95, "relation", 0.99), ("fact", 0.5, "relation", 0.55)], "a string, b double, c string, d double")
    assert [tuple(r[0]) for r in m.select(verify.arbitrate(*map(F.col, "abcd"))).collect()] == [("relation", "llm"), ("fact", "rule"), ("fact", "rule+llm")]


def test_metrics(spark):
    a = spark.createDataFrame([(1, "p", "fact", None, ["534,700", "café"], ["It has 534700 rows"], "the Cafe"), (2, "p", "relation", "boom", None, None, None), (3, "p", "relation", None, [None, ""], [], "x")], "answer_id long, pdf string, type string, error string, answer_keys array<string>, contexts array<string>, answer string")
    assert [tuple(r)[-2:] for r in evaluate.answer_metrics(a).orderBy("answer_id").collect()] == [(0.5, 0.5), (1.0, 1.0), (1.0, 1.0)]
    total = [r for r in evaluate.roll_up(evaluate.answer_metrics(a)).collect() if r["pdf"] is None][0]
    assert (total["items"], total["failed"], total["completeness"], total["multihop_success"]) == (3, 1, 0.75, 1.0)


def test_providers(spark):
    df = spark.createDataFrame([(1, "q", "long answer text about things.")], "query_id long, text string, p string")
    with pytest.raises(Exception) as error:
        df.select(Providers().reply("text")).collect()
    assert MissingProvider.__name__ in str(error.value)
    given = Providers(chat=lambda p: "<think>x</think>The Model has 42 layers in total.", embed=lambda ts: [[3.0, 4.0] for _ in ts], cross_encode=lambda ps: [float(len(b)) for _, b in ps])
    assert df.select(given.embedding("text")).first()[0] == pytest.approx([0.6, 0.8])
    hits = spark.createDataFrame([(1, 1, "the model has 42 layers in total", 1)], "query_id long, doc_id long, text string, rank int")
    got = retrieve.answer(spark.createDataFrame([(1, "How many layers?"), (2, "Nothing found?")], "query_id long, text string"), hits, given).orderBy("query_id").collect()
    assert [(r["answer"], r["confidence"]) for r in got] == [("The Model has 42 layers in total.", 1.0), ("", None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x", "source": "a", "page": 1, "chunk_index": 0}]')
    assert files.read_chunks(spark, str(tmp_path / "*.json"), "a").count() == 1
    assert files.read_triples(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g.json").write_text('{"qa": [{"id": "1", "question": "q"}], "reflection_cases": [{"id": "c", "supported": true}]}')
    qa, cases = files.read_gold(spark, str(tmp_path / "g.json"))
    assert qa.count() == cases.count() == 1
    (tmp_path / "b.jpg").write_bytes(b"1")
    pictures = spark.read.format("binaryFile").load(str(tmp_path / "b.jpg"))
    assert pictures.select(files.data_url(F.col("path"), F.col("content"))).first()[0] == "data:image/jpeg;base64,MQ=="
    rows_ = spark.createDataFrame([("k", "t", 2), ("k", "u", 1), ("l", " ", 3)], "id string, text string, n int")
    assert files.upsert(spark, str(tmp_path / "t"), rows_, ["id"], "n") == 1
    assert files.upsert(spark, str(tmp_path / "t"), rows_, ["id"], "n") == 0
    files.write_index(rows_, str(tmp_path / "i"))
    assert files.read_index(spark, str(tmp_path / "i")).count() == 3 and files.read_index(spark, str(tmp_path / "none")) is None
    files.write_by_source(rows_.withColumn("source", F.col("id")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("source = 'k'").count() == 2


def test_stream_drops_repeats(spark, root, tmp_path):
    from folioflow.streaming import ingest

    chunks = spark.read.parquet(f"{root}/chunks.parquet")
    chunks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.chunk_stream(spark, str(tmp_path / "in"), chunks), "3000 days")
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunks.select(files.chunk_id()).distinct().count()
    assert ingest.arrivals(ingest.chunk_stream(spark, str(tmp_path / "in"), chunks)).isStreaming


def test_groups_of_many_texts_are_one_tasks_work(spark, monkeypatch):
    from folioflow.operators import summary

    text = lambda i: f"Model Word{i % 90} has {i * 7} layers and uses gated-attention part{i % 13} here. It was then run on Data{i % 31}, as well as others."
    data = [("a", i, text(i)) for i in range(150)]
    joined = " ".join(t for _, _, t in data)
    found, words = summary._sentences(joined), summary._keywords(joined)
    naive = " ".join(found[i] for i in sorted(summary._pick([{w for w in words if w in s.lower()} for s in found], words, 10)))
    monkeypatch.setattr(summary, "_summarise_large", None)  # a group of some hundred texts needs no rows of sentences
    assert dict(rows(summary.summarise_groups(spark.createDataFrame(data, "k string, ord int, text string"), ["k"], 10))) == {"a": naive}
