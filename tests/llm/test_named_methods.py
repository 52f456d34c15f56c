"""That the method named for a problem is what finds its rows, and that no bound or switch drops any."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from folioflow.llm import defects, leakage, mapping, near_duplicates, privacy, scans

ENTRIES = [(1, "outperforms", "优于", ["surpass", "beat"]), (2, "evaluated_on", "评测于", ["test on", "assess on"]), (3, "achieves", "达到", ["reach", "attain"]), (4, "uses", "使用", ["employ", "use"])]


# --- 1: near-duplicates -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(12))
def test_masks_of_three_bits_and_rounds_cover_every_pair(seed):
    r = np.random.default_rng(seed)
    n = [20, 21, 33, 44, 63, 64, 70, 91, 92, 150, 204, 260][seed]
    a = r.integers(1, 2**63, n, np.uint64)
    swap = int(0.3 * n / 1.7)  # the most that leaves seven tenths
    b = np.concatenate([a[swap:], r.integers(1, 2**63, swap, np.uint64)])
    h, size = np.concatenate([a, b, a[: n * 7 // 10 + 1]]), np.array([n, n, n * 7 // 10 + 1])
    for width, least in near_duplicates.WIDTHS.items():
        masks = near_duplicates.Masks(r.integers(0, 50, 512).astype(np.int32), width=width)
        whole = masks.keys(h, size)
        assert set(whole.key[(whole.text == 0) & whole.small]) & set(whole.key[whole.text == 1])
        if size[2] >= least[0][0]:
            assert set(whole.key[(whole.text == 2) & whole.small]) & set(whole.key[whole.text == 0])
        for rounds in (2, 5, 3 * least[0][1]):
            parts = [masks.keys(h, size, (k, rounds)) for k in range(rounds)]
            assert sorted(zip(whole.key, whole.text, whole.small)) == sorted(x for p in parts for x in zip(p.key, p.text, p.small))


def test_rounds_lose_no_pair_and_bound_what_is_shuffled(spark):
    """Also where disk allows a few rows a round, with three bits a mask, hot buckets and counts from a part of the texts."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(70)]
    base = [r.sample(vocabulary, 40) for _ in range(60)]
    texts = [(k, " ".join(w[:-swap] + r.sample(vocabulary, swap))) for k, (w, swap) in enumerate((w, swap) for w in base for swap in (1, 4, 7))]
    members, reps = near_duplicates.classes_of_equal_sets(near_duplicates.word_sets(spark.createDataFrame(texts, "chunk_id long, text string"), "chunk_id", "text"))
    sets = {i: set(t.split()) for i, t in texts}
    assert members.count() == len(texts)
    expected = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert len(expected) > 60
    for bounds in ({"round_bytes": 100_000}, {"width": 3, "round_bytes": 100_000, "hot": 9}, {"width": 3}):
        assert {(min(p[:2]), max(p[:2])) for p in map(tuple, near_duplicates.similar_pairs(reps, **bounds).collect())} == expected


# --- 3: mapping -------------------------------------------------------------------------------------------------------
def test_token_sets_find_what_the_automaton_leaves():
    m = mapping.Mapper(ENTRIES)
    for value, id_ in {"outprforms": 1, "on evaluted": 2, "evaluated often onn": 2, "us3s": 4, "评侧于": 2, "assessed mostly oon": 2}.items():
        words = mapping.plain(value).split()
        assert m._mention(words) is None and m.map(value) == id_, value
    off = mapping.Mapper(ENTRIES)
    off._token_set = lambda words: None
    assert off.map("on evaluted") == 0 and off.map("outprforms") == 1  # without it, the order of words matters


def test_a_first_letter_is_a_misspelling_where_the_table_shows_it(spark):
    types = spark.createDataFrame(ENTRIES, "relation_id int, std_relation string, label_zh string, keywords array<string>")
    values = ["outperforms"] * 10 + ["Outperformed"] * 30 + ["evaluated on"] * 20 + ["reaches"] * 12 + ["breaches"] * 9 + ["utperforms", "valuated on", "mploys"]
    t = spark.createDataFrame(list(enumerate(values)), "triple_id long, relation string")
    got = {r["relation"]: r["relation_id"] for r in mapping.map_relations(t, types).collect()}
    assert got["utperforms"] == 1 and got["valuated on"] == 2 and got["breaches"] == 0 and got["reaches"] == 3
    assert got["mploys"] == 0  # nothing in the table shows what it stands for


def test_a_list_in_blocks_maps_as_one(spark, root):
    from folioflow.runtime import table

    triples, types = table(spark, root, "kg_triples"), table(spark, root, "relation_types")
    assert rows(mapping.map_relations(triples, types, 5)) == rows(mapping.map_relations(triples, types))


# --- 2: scans ---------------------------------------------------------------------------------------------------------
def test_no_bound_changes_what_is_repaired(spark, root):
    """Few filter bits and small buckets give what brute force over all counts gives."""
    from folioflow.runtime import table

    chunks = table(spark, root, "chunks")
    texts = {r["chunk_id"]: r["text"] for r in chunks.where("text is not null and coalesce(content_type, '') <> 'table'").collect() if "\n" in r["text"]}
    counts = Counter(w for r in chunks.where("text is not null").collect() for w in re.findall(r"[^\W\d_]{2,40}", r["text"].lower()))
    counts = {w: n for w, n in counts.items() if n > 1}
    model = scans.fitted(chunks.where("coalesce(content_type, '') <> 'table'"))
    states = {i: scans.states_of(t, model) for i, t in texts.items()}
    asked = {i: scans.questions(t, states[i]) for i, t in texts.items()}
    words = scans.Words.of_corpus(counts, set().union(*(a[0] for a in asked.values())))
    expected = sorted(((i, *scans.analyse(t, states[i], words)) for i, t in texts.items()), key=str)
    got = lambda **bounds: sorted(((r["chunk_id"], r["kinds"], r["text"].split("\n\n")) for r in scans.repaired(chunks, **bounds).collect()), key=str)
    assert any("misread" in k for _, k, _ in expected)
    assert got() == got(bits=1 << 15, bucket_chars=3000) == [(i, k, "\n\n".join(p).split("\n\n")) for i, k, p in expected]


def test_a_rare_word_stays_known_in_a_large_corpus(spark):
    """A correction seen a few times counts however many other words there are."""
    common = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100))
    rows_ = [(i, "text", common) for i in range(400)] + [(1000 + i, "text", "evaluation matters") for i in range(3)] + [(2000, "text", "the long\nevaluatiOn evaluatlon of\nall")]
    for n in (10, 400):
        chunks = spark.createDataFrame([r for r in rows_ if r[0] < n or r[0] >= 1000], "chunk_id long, content_type string, text string")
        assert rows(scans.damage(chunks)) == [(2000, "misread")]


def test_texts_of_one_line_and_tables_are_read_too(spark):
    """Misread words are found wherever they stand; pieces that an invisible character leaves are none, and lines of tables stay."""
    fine = [(i, "text", "every evaluation of linking after another") for i in range(40)]
    odd = [(100, "text", "the evaluati0n of all"), (101, "table", "Table:\nA: evaluati0n | B: 2\nA: c | B: 3"), (102, None, "evaluati0n"), (103, "text", "ch\u200cunking and evalua\ufefftion"), (104, "text", "- 12 -"), (105, "text", ""), (106, "text", None), (107, "table", "evaluation")]
    chunks = spark.createDataFrame(fine + odd, "chunk_id long, content_type string, text string")
    assert rows(scans.damage(chunks)) == [(100, "misread"), (101, "misread"), (102, "misread"), (104, "page_number")]
    got = {r["chunk_id"]: (r["kinds"], r["text"]) for r in scans.repaired(chunks, whole=True, bits=1 << 15, bucket_chars=20).collect()}
    assert set(got) == {i for i, _, t in fine + odd if t} and got[0] == ([], fine[0][2]) and got[107] == ([], "evaluation")
    assert got[101] == (["misread"], "Table:\nA: evaluation | B: 2\nA: c | B: 3") and got[103] == ([], odd[3][2])


# --- 9: leakage -------------------------------------------------------------------------------------------------------
def test_items_in_blocks_leak_as_one_set(spark, root):
    from folioflow.runtime import table

    documents, items = table(spark, root, "documents"), table(spark, root, "eval_items")
    assert rows(leakage.leaks(documents, items, max_items=70)) == rows(leakage.leaks(documents, items)) != []


# --- 6: defects -------------------------------------------------------------------------------------------------------
def test_refusals_of_any_length():
    excuse = "The excerpts are short. They leave the matter open. Please ask the authors for it. "
    assert defects.defect("q", "I cannot answer this question. " + excuse) == "refusal"
    assert defects.defect("q", "I cannot answer this question. " + excuse * 20) == "refusal"
    assert defects.defect("q", "I cannot give one figure. It is 4.2 on code search. It is 5.1 for Kuvagemo. It is 7 for the rest.") != "refusal"


def _answers(spark, texts):
    return spark.createDataFrame([(i, "Which parts are used?", t, None) for i, t in enumerate(texts)], "answer_id long, question string, answer string, error string")


def test_neighbours_decide_what_the_text_alone_does_not_show(spark):
    short, long = "Adapter Bipuwele Kuvagemo Lab", "Adapter Bipuwele Kuvagemo Lab and Sepuzanu Recall parts."
    assert defects.defect("q", short) is None
    assert rows(defects.defects(_answers(spark, [short, long]))) == [(0, "truncated")]
    assert rows(defects.defects(_answers(spark, [short + "...", long]))) == [(0, "truncated")]
    assert rows(defects.defects(_answers(spark, [short, "Another answer."]))) == []


def test_length_peaks_decide_what_the_text_alone_does_not_show(spark):
    r = random.Random(2)
    name = lambda n: "".join(r.choices("BCDFG", k=1) + r.choices("aeiou", k=n - 1))
    cut = [" ".join([name(20), name(20), name(20), name(37)]) for _ in range(30)]
    assert {len(t) for t in cut} == {100} and all(defects.defect("q", t) is None for t in cut)
    assert len(rows(defects.defects(_answers(spark, cut)))) == 30
    assert rows(defects.defects(_answers(spark, cut[:3]))) == []


@pytest.mark.parametrize("n", [1, 3, 8])
def test_end_marks_do_not_hide_a_prefix(spark, n):
    r = random.Random(n)
    texts = ["".join(r.choices("ab. …", k=r.randint(0, 8))) for _ in range(300)]
    core = {t.rstrip(" \t\r\n.…-–—\"'”’»") for t in texts} - {""}
    expected = sorted(a for a in core if any(b != a and b.startswith(a) for b in core))
    assert sorted(x["core"] for x in defects.shortened_answers(_answers(spark, texts), n).collect()) == expected


# --- 10: privacy ------------------------------------------------------------------------------------------------------
def test_a_lexicon_over_the_bound_finds_the_same(spark, root):
    from folioflow.runtime import table

    docs = table(spark, root, "documents")
    assert rows(privacy.personal_data(docs, max_terms=0)) == rows(privacy.personal_data(docs)) != []
    assert rows(privacy.sanitised(docs, max_terms=0)) == rows(privacy.sanitised(docs))


def test_co_occurrence_reveals_names_no_cue_stands_before(spark):
    d = spark.createDataFrame([(i, f"We thank Dr. Irene Halv{c}en for notes.") for i, c in enumerate("abcdef")] + [(7, "Later Irene Osk spoke to Graph Lab.")] + [(10 + i, "We saw Kuva Graph, then Boli Lab and again Mado Net here.") for i in range(40)], "doc_id long, text string")
    names = lambda **k: {r["found"] for r in privacy.personal_data(d, **k).where("doc_id = 7").collect()}
    assert names() == {"Irene Osk"} and names(known={}) == set()
