from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from folioflow.functions import sets, text
from folioflow.operators import chunking, diversity, layout


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ",".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_terms_and_folding(spark):
    assert one(spark, text.terms("t"), t="VEQ-M3 用模型") == ["veq", "m3", "用", "模", "型"]
    assert text.folded("Café 534,700 self-\nknowledge Mixture-of-Experts") == "cafe 534700 selfknowledge mixtureofexperts"
    assert text.folded(None) == ""
    for t in ("Café naïve", "a-b c_d 1,234 x", "", "ｆｕｌｌ"):
        assert one(spark, text.fold("t"), t=t) == text.folded(t)
    assert one(spark, text.fold_each("t"), t=["Ab-c", "é", None]) == ["abc", "e", ""]


def test_sentences_keywords_claims(spark):
    t = "The Model reaches 45.9 points on retrieval. It was built in 2019 with 1,200 GPUs and data. no"
    assert one(spark, text.sentences("t"), t=t) == ["The Model reaches 45.9 points on retrieval.", "It was built in 2019 with 1,200 GPUs and data. no"]
    words = set(one(spark, text.keywords("t"), t=t))
    assert {"model", "reaches", "45.9", "gpus", "data"} <= words and "2019" not in words and "with" not in words
    answer = "Claim one is long enough [Passage 2]. Short. Second claim stands here!\nSupporting evidence\nquoted text here is dropped."
    assert one(spark, text.claims("t"), t=answer) == ["Claim one is long enough  .", "Second claim stands here!"]
    said = "Transformer beats VERA-Large by 45 points (Smith et al., 2019) and a million rows in 2020"
    assert one(spark, text.evidence_terms("t"), t=said) == ["transformer", "vera-large", "45", "million"]
    assert one(spark, text.evidence_terms("t"), t="") == []


def test_spacing_and_think(spark):
    for given, want in {"3.1 DataCurationPipeline": "3.1 Data Curation Pipeline", "OrVella-M1 short": "Or Vella-M1 short", "transformerswithattention": "trans for mers with attention", "Pre-trainingGPT4Models\tx": "Pre-training GPT 4 Models\tx", "": ""}.items():
        assert one(spark, text.english_spacing("t"), t=given) == want
    assert one(spark, text.strip_think("t"), t="<think>a</think> yes <think>open") == "yes"


def test_set_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "f array<string>, g array<string>")
    got = [tuple(round(x, 4) for x in r["s"]) for r in df.select(sets.set_scores(F.col("f"), F.col("g")).alias("s")).collect()]
    assert got == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。！\n ", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_packing_keeps_all_text(t, size, overlap):
    chunks = chunking.packed(t, size, overlap)
    if chunks:
        kept = chunks[0]
        for c in chunks[1:]:
            kept += c[min(overlap, len(kept)) if overlap else 0 :] if overlap else c
        assert "".join(kept.split()) == "".join(t.split())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdef")), max_size=8), st.sets(st.sampled_from("abcdef")), st.integers(0, 5))
def test_diversity_selects_distinct(tokens, query, k):
    chosen = diversity.select(tokens, query, k, 0.6)
    assert len(chosen) == len(set(chosen)) == min(k, len(tokens))


def test_diversity_prefers_new_content():
    assert diversity.select([{"a", "b"}, {"a", "b"}, {"a", "c"}], {"a", "b", "c"}, 2, 0.5) == [0, 2]


def test_headings(spark):
    lines = ["3.1 DataCuration", "2", "Related Work", "12. Smith", "0.5 Axis", "1 https://x.org", "3 small letters", "4 A, b", "2 The model is", "1.2 Billion", "4 Opus", "1 Year 2024", "8 A heading. And then more follows", "三、结果"]
    df = spark.createDataFrame([("s", 1, "\n".join(lines)), ("s", 2, None), ("s", 3, "")], "source string, page int, text string")
    assert rows(layout.headings(df).select("line", "level", "title")) == sorted([(0, "h2", "3.1 Data Curation"), (1, "h1", "2 Related Work"), (12, "h1", "8 A heading"), (13, "h1", "三、结果")], key=str)


def test_sentences_and_keywords_agree_in_both_forms(spark, root):
    """The rules stand once as expressions and once for the summary's own texts."""
    from folioflow.operators import summary
    from folioflow.runtime import table

    for r in table(spark, root, "documents").where("text is not null").select("text", text.sentences("text").alias("s"), text.keywords("text").alias("k")).collect():
        assert summary._sentences(r["text"]) == r["s"] and summary._keywords(r["text"]) == set(r["k"])


def test_chars_become_lines():
    chars = [(10, 0, 5, "a"), (10.5, 5.5, 9, "b"), (11, 12, 15, "c"), (20, 0, 4, "d")]
    assert layout.lines_of_chars(chars) == "ab c\nd"
    assert layout.lines_of_chars([]) == ""


def test_tables(spark):
    df = spark.createDataFrame([(1, [["name", "score"], ["x", "1"], ["", None]]), (2, [["a"]]), (3, None)], "id int, cells array<array<string>>")
    c = F.col("cells")
    got = rows(df.select("id", chunking.is_real_table(c).alias("r"), chunking.table_text(c).alias("t")))
    assert got == [(1, True, "表格内容：\nname: x | score: 1"), (2, False, None), (3, False, None)]
