"""Each operator against brute force or a stated case, and on nulls, empty and long texts, ties, repeats, empty tables and
columns with clashing names."""

import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import agree, rows
from folioflow.llm import copies, defects, leakage, mapping, near_duplicates, normalize, packing, privacy, queries, scans, split
from folioflow.llm.oracles import ORACLES

WORD = re.compile(r"[^\W_]+")
CLASH = ("key", "id", "rep", "n", "h", "words", "rank", "k1", "meta", "__value", "first_id", "at_limit", "n_chars")


def cluttered(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, root, name):
    agree(spark, duck, root, queries.QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(ORACLES)))
def test_query_runs(spark, root, name):
    assert queries.QUERIES[name](spark, root).count() > 0


# --- 1: near-duplicates -----------------------------------------------------------------------------------------------
def _texts(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(string.ascii_lowercase, k=4)) for _ in range(60)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = r.choices(vocabulary, k=r.randint(15, 90))
        out.append(" ".join(w))
    return out


def _brute(texts, least=20):
    s = {i: set(WORD.findall(t.lower())) for i, t in texts if t}
    s = {i: w for i, w in s.items() if len(w) >= least}
    return sorted((a, b) for a in s for b in s if a < b and 10 * len(s[a] & s[b]) >= 7 * len(s[a] | s[b]))


def test_no_pair_is_lost(spark):
    texts = list(enumerate(_texts(250, 1))) + [(900, None), (901, ""), (902, "too few words")]
    texts += [(903, texts[0][1].upper()), (904, " ".join(f"w{i}" for i in range(3000))), (905, " ".join(f"w{i}" for i in range(60, 3100)))]
    df = cluttered(spark.createDataFrame(texts, "chunk_id long, text string"))
    expected = _brute(texts)
    assert len(expected) > 20 and (904, 905) in expected
    assert rows(near_duplicates.near_duplicate_pairs(df)) == sorted(expected, key=str)
    members, reps = near_duplicates.classes_of_equal_sets(near_duplicates.word_sets(df, "chunk_id", "text"))
    whole = {tuple(r)[:2] for r in near_duplicates.similar_pairs(reps).collect()}
    for hot, depth in ((9, 0), (40, 1), (9, 1)):
        assert {tuple(r)[:2] for r in near_duplicates.similar_pairs(reps, hot=hot, depth=depth).collect()} == whole


def test_groups_are_linear_and_transitive(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:-4] + ["a", "b", "c", "d"])), (3, " ".join(base[4:-4] + ["a", "b", "c", "d", "e", "f", "g", "h"])), *((10 + i, " ".join(reversed(base))) for i in range(500)), (600, " ".join(f"z{i}" for i in range(30)))]
    got = {r["chunk_id"]: (r["group_id"], r["links"]) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(texts, "chunk_id long, text string")).collect()}
    assert len(got) == 504 and got[3][0] == got[2][0] == got[509][0] == 1 and got[600] == (600, 0) and got[2][1] == 2
    empty = spark.createDataFrame([], "chunk_id long, text string")
    assert near_duplicates.near_duplicate_groups(empty).count() == near_duplicates.near_duplicate_pairs(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(20, 200), st.integers(0, 10**6))
def test_masks_cover_every_pair_within_the_threshold(n, seed):
    r = np.random.default_rng(seed)
    a = r.integers(1, 2**63, n, np.uint64)
    swap = int(r.integers(0, max(1, math.floor(n * 0.3 / 1.7)) + 1))
    b = np.concatenate([a[swap:], r.integers(1, 2**63, swap, np.uint64)])
    if len(set(a) & set(b)) / len(set(a) | set(b)) < 0.7:
        return
    masks = near_duplicates.Masks(r.integers(0, 50, 512).astype(np.int32))
    h, size = np.concatenate([a, b]), np.array([len(a), len(b)])
    rows_ = masks.keys(h, size)
    assert set(rows_.key[(rows_.text == 0) & rows_.small]) & set(rows_.key[rows_.text == 1])
    finer, stay = masks.finer(h, size, rows_)  # and with two more bits
    assert not len(stay.key) and set(finer.key[(finer.text == 0) & finer.small]) & set(finer.key[finer.text == 1])
    s = near_duplicates.parity_sketch(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert sum((int(x[0]) ^ int(x[1])).bit_count() if x[0] >= 0 and x[1] >= 0 else ((int(x[0]) ^ int(x[1])) & (2**64 - 1)).bit_count() for x in s) <= len(set(a) ^ set(b))


# --- 2: scans -----------------------------------------------------------------------------------------------------
COUNTS = Counter({w: 400 for w in "the model predicts every cluster of annotations on code search before training ends and reaches accuracy with throughput from layers when tax onomy benchmark side leaderboard taxonomy fine grained".split()})


def _kinds(text):
    model = scans.LineModel()
    states = scans.states_of(text, model)
    return scans.analyse(text, states, scans.Words.of_corpus(COUNTS, scans.questions(text, states)[0]))


def test_damage_and_repair():
    body = "the model predicts every clu-\nster of annotations on code search before train-\n\ning ends and reaches accuracy with throughput"
    assert _kinds(body) == (["broken_word"], ["the model predicts every cluster of annotations on code search before training ends and reaches accuracy with throughput"])
    text = "LAYOUT READER\nthe model prcdicts every cluster of annotations on code\nsearch before training ends and reaches accuracy with\n[174]\nthroughput from layers when the model predicts every code."
    kinds, paragraphs = _kinds(text)
    assert kinds == ["misread", "running_line", "page_number"] and len(paragraphs) == 1 and "predicts every" in paragraphs[0]
    assert _kinds("the model predicts every cluster of annotations on code sea¬\nrch before training ends")[0] == ["broken_word"]


def test_what_is_no_damage():
    for text in ("both the benchmark-\nand the leaderboard-side cluster predicts every code", "the model predicts every cluster 12-\n15 of annotations on code search", "the model predicts every cluster. -\nThe model reaches accuracy", "the model predicts\nevery Kuvagemo cluster with Bipuwele of annotations"):
        assert "broken_word" not in _kinds(text)[0] and "misread" not in _kinds(text)[0]
    assert scans.LineModel().decode([]) == []


def test_scans_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "text", None), (2, "text", ""), (3, None, "one line"), (4, "table", "Table:\nA: 1 | B: 2"), (5, None, "\n\n"), (6, "text", "word " * 20000 + "\nend")], "chunk_id long, content_type string, text string")
    got = scans.repaired(cluttered(df)).collect()
    assert sorted(r["chunk_id"] for r in got) == [5, 6]
    assert scans.damage(df.limit(0)).count() == 0


def test_training_keeps_the_prior_on_little_data():
    m = scans.LineModel().fit([[(9, 2, 0)]])
    assert m.decode([(4, 0, 2), (12, 2, 1)])[0] == scans.RUNNING


# --- 3: mapping ---------------------------------------------------------------------------------------------------
ENTRIES = [(1, "proposes", "提出", ["propose", "introduce", "put forward"]), (2, "uses", "使用", ["utilize", "use"]), (3, "is_a", None, ["kind of", "type of"]), (4, "evaluated_on", "评测于", ["test on", "assess on"]), (5, "achieves", "达到", ["reach", "attain"]), (6, "reduces", "降低", ["lower", "cut"])]


def test_mapping():
    m = mapping.Mapper(ENTRIES)
    for value, id_ in {"Proposed": 1, "«puts forward»": 1, "also_introducing": 1, "introduecs": 1, "提出。": 1, "PutForward": 1, "makes use of": 2, "UTILISING": 2, "is a typef o": 3, "was tested on": 4, "evaluaten on": 4, "[Reached]": 5, "refuses": 0, "breaches": 0, "causes": 0, "attests to": 0, "->": 0, "n/a": 0, "Kuvagemo Lab": 0, "": 0, "x" * 10000: 0}.items():
        assert m.map(value) == id_, value


def test_mapping_of_tables(spark):
    types = spark.createDataFrame([e for e in ENTRIES], "relation_id int, std_relation string, label_zh string, keywords array<string>")
    t = spark.createDataFrame([(1, "proposes"), (2, None), (3, " 　"), (4, "Proposes"), (5, "Proposes"), (6, "zzz")], "triple_id long, relation string")
    assert rows(mapping.map_relations(cluttered(t), types).select("triple_id", "relation_id")) == [(4, 1), (5, 1), (6, 0)]
    assert mapping.map_relations(t.limit(0), types).count() == 0
    assert rows(mapping.map_relations(t.where("triple_id = 4"), types.limit(0)).select("relation_id")) == [(0,)]
    assert len(mapping.reference_blocks(types, 2)) == 3


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_edit_distance_is_bounded_and_symmetric(a, b):
    d = mapping.edit_distance(a, b, 9)
    assert d == mapping.edit_distance(b, a, 9) <= max(len(a), len(b)) and (d == 0) == (a == b)


# --- 4: copies ----------------------------------------------------------------------------------------------------
def test_copies_against_brute_force_with_a_hot_group(spark):
    r = random.Random(3)
    data = [(i, "Hot Subject", "uses", "B") if i % 3 == 0 else (i, r.choice(["a-B", "ab", "A B", None, " ", "c"]), r.choice(["x", "X.", "y"]), r.choice(["ab", "d", "D!"])) for i in range(900)]
    df = spark.createDataFrame(data, "triple_id long, subject string, relation string, object string")
    keys = defaultdict(list)
    for i, *parts in data:
        if all(p and p.strip() for p in parts):
            keys[tuple(sorted("".join(c for c in p.lower() if c.isalnum()) for p in parts))].append(i)
    expected = sorted(((min(v), i) for v in keys.values() for i in v if i != min(v)), key=str)
    for n in (1, 3, 8):
        assert rows(copies.copies(cluttered(df), queries.PARTS, "triple_id", n)) == expected
    assert rows(copies.collapse(df, queries.PARTS, "triple_id", 5)) == sorted(((min(v), len(v)) for v in keys.values()), key=str)
    assert copies.copies(df.limit(0), queries.PARTS, "triple_id").count() == 0


# --- 5: consistent form -------------------------------------------------------------------------------------------
def test_consistent_form():
    cases = {"ＡＢ１": "full_width", "ﬁne": "ligature", "résumé": "combining_mark", "a​b": "invisible", "a­b": "invisible", "a b": "space", "a　b": "space", "mоdel": "mixed_script"}
    for text, kind in cases.items():
        assert normalize.changes(text) == [kind], text
        assert normalize.changes(normalize.consistent(text)) == []
    for text in ("résumé", "α and β", "λόγος корпус", "你好，世界。", "a\tb\nc", "Erdős", ""):
        assert normalize.changes(text) == []
    assert normalize.consistent("mоdel ﬁt ＡＢ") == "model fit AB"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_consistent_form_is_stable(text):
    once = normalize.consistent(text)
    assert normalize.consistent(once) == once and normalize.comparison_key(normalize.comparison_key(text)) == normalize.comparison_key(text)


def test_every_case_is_a_suspect_for_the_jvm(spark):
    values = [chr(c) for c in range(0x250) if c] + list("​‌⁠﻿　  Ａ９ﬁΆ") + ["xα", "аb", None, ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    found = {r["i"] for r in normalize.inconsistent_values(df).collect()}
    assert found == {i for i, v in enumerate(values) if v and normalize.changes(v)}
    out = {r["i"]: r for r in normalize.normalize_values(cluttered(df), "value", keep=("i",)).collect()}
    assert all(out[i]["normalized"] == (None if v is None else normalize.consistent(v)) for i, v in enumerate(values))
    assert all(out[i]["match_key"] == (None if v is None else normalize.comparison_key(v)) for i, v in enumerate(values))


# --- 6: defects ---------------------------------------------------------------------------------------------------
def test_defects():
    q = "What limits the latent margin in Kuvagemo?"
    for answer in (None, "", " \n", "N/A", "**", '""', "<think>\n</think>", "Answer:", "...", "无", "​"):
        assert defects.defect(q, answer) == "empty", answer
    for answer in (q, q.upper(), f"> {q}", f"{q} {q}", f"Question: {q} Answer:", f'"{q}"', q[:-1]):
        assert defects.defect(q, answer) == "copies_question", answer
    for answer in ("I'm sorry, but I can't help with that.", "I must refrain from answering here. Please consult the paper itself.", "抱歉，我无法回答这个问题。", "Leider kann ich diese Frage nicht beantworten.", "Je préfère ne pas me prononcer.", "It's not possible for me to determine this from the excerpts."):
        assert defects.defect(q, answer) == "refusal", answer
    for answer in ("The optimizer of the linear va", "Between pooling and parsing,", "The summary exceeds 52.", "We compare (the first", "- one\n-", "The limits are: 1. Trajectory\n2.", "由于路由器比较自适应，Nelajije v2只需要795步就能"):
        assert defects.defect(q, answer) == "truncated", answer
    assert defects.defect(q, "Die Abdeckung ist kaum dichte, während der Graph 8 Schritte braucht.") == "other_language"
    for answer in ("42.7", "Kuvagemo Lab", '"latent margin"', "- one item\n- another item", "Kuvagemo (sparse)", "Lab with 10 tokens", "The decoder cannot handle inputs beyond 5 shards.", "Sorry-style replies make up 5 percent of outputs.", "The noise of Kuvagemo v2."):
        assert defects.defect(q, answer) is None, answer
    assert defects.defect(None, "The model is good.") is None


def test_shortened_answers_against_brute_force(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("ab ", k=r.randint(0, 9))) for _ in range(400)] + [None, "", "x" * 50000, "x" * 49999]
    df = spark.createDataFrame([(t,) for t in texts], "answer string")
    u = {t.rstrip() for t in texts if t and t.strip()}
    expected = sorted(a for a in u if any(b != a and b.startswith(a) for b in u))
    for n in (1, 4, 9):
        assert sorted(x["core"] for x in defects.shortened_answers(df, n).collect()) == expected


def test_length_limits(spark):
    texts = ["x" * n + str(i) for i, n in enumerate(random.Random(1).choices(range(50, 400), k=300))] + [f"{i:06d}" + "y" * 194 for i in range(60)]
    assert rows(defects.limit_lengths(spark.createDataFrame([(t,) for t in texts], "answer string"))) == [(200,)]


def test_defects_of_tables(spark):
    a = spark.createDataFrame([(1, "q", None, None), (2, None, None, None), (3, "q", "fine answer.", "timeout"), (4, "Is it so?", "is it so", None)], "answer_id long, question string, answer string, error string")
    assert rows(defects.defects(cluttered(a))) == [(1, "empty"), (2, "empty"), (4, "copies_question")]
    assert defects.defects(a.limit(0)).count() == 0


# --- 7: splitting -------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n。；", max_size=2500), st.integers(30, 500), st.integers(0, 20))
def test_pieces_give_the_text_back(text, limit, overlap):
    spans = split.split_text(text, limit, overlap)
    assert all(b - a <= limit for a, b in spans)
    assert "".join(text[a if i == 0 else spans[i - 1][1] : b] for i, (a, b) in enumerate(spans)) == text
    assert all(spans[i + 1][0] == max(0, spans[i][1] - overlap) for i in range(len(spans) - 1))


def test_cuts_prefer_natural_boundaries(spark):
    text = ("One sentence that stands here. " * 30).strip()
    assert all(text[b - 1] in ". " for _, b in split.split_text(text)[:-1])
    section = "1. A fairly long heading of the first level > 1.2 Another long heading of the second level here"
    assert [section[a:b].strip(" >") for a, b in split.split_section(section)] == section.split(" > ")
    c = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "x" * 501, "t"), (4, "x" * 500, "y" * 81), (5, "a. " * 400, "z")], "chunk_id long, text string, section string")
    assert rows(split.oversized(cluttered(c)).select("chunk_id", "field", "kind")) == [(3, "text", "hard"), (4, "section", "hard"), (5, "text", "soft")]
    p = split.pieces(c).collect()
    assert all(len(r["text"]) <= 500 for r in p) and {r["section"] for r in p if r["chunk_id"] == 5} == {"z"}
    assert split.pieces(c.limit(0)).count() == 0


# --- 8: packing ---------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 260), st.integers(0, 3), st.integers(0, 30)), max_size=120))
def test_packing_is_whole_and_within_capacity(items):
    sizes, sources, clusters = ([x[k] for x in items] for k in range(3))
    packed = packing.pack_group(np.array(sizes, int), np.array(sources), np.array(clusters), 100)
    parts = defaultdict(int)
    used, held = defaultdict(int), defaultdict(list)
    for i, part, start, n, b in packed:
        parts[i] += n
        used[b] += n
        held[b].append(clusters[i])
        assert start == part * 100
    assert dict(parts) == dict(enumerate(sizes)) and all(v <= 100 for v in used.values())
    assert all(len(set(v)) == len(v) for v in held.values())
    assert all(sum(i == j for j, *_ in packed) == 1 for i, n in enumerate(sizes) if n <= 100)


def test_packing_of_tables(spark, root):
    d = spark.createDataFrame([(1, None, "s", 0), (2, "  \n", "s", 0), (3, "word " * 5000, None, 0), (4, "same text", "a", 0), (5, "same text", "a", 0), (None, "x", "a", 0)], "doc_id long, text string, source string, g int")
    got = packing.pack(d).collect()
    assert {r["doc_id"] for r in got} == {3, 4, 5} and max(r["n_tokens"] for r in got) <= packing.CAPACITY
    boxes = {r["doc_id"]: r["container_id"] for r in got}
    assert boxes[4] != boxes[5]
    assert packing.pack(d.limit(0)).count() == 0
    whole = packing.containers(packing.pack(spark.read.parquet(f"{root}/documents.parquet")))
    use = whole.agg(F.sum("used_tokens") / F.count("*") / packing.CAPACITY).first()[0]
    assert use > 0.9


# --- 9: leakage ---------------------------------------------------------------------------------------------------
def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = ["alpha", "Beta", "x1", "é"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(8, 14)))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(i, "; ".join(r.choices(vocabulary, k=r.randint(5, 40)) + WORD.findall(items[i % 12][1])[: r.randint(0, 14)])) for i in range(120)] + [(900, None), (901, "")]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for j, text in docs:
            v = WORD.findall((text or "").lower())
            windows = {tuple(v[k : k + 10]) for k in range(len(v) - 9)}
            if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
                expected.add((j, i))
    got = leakage.leaks(cluttered(d), cluttered(e)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected) > 5
    text = dict(docs)
    for r in got:
        assert len(WORD.findall(text[r["doc_id"]][r["start_char"] : r["end_char"]])) >= 10
    assert leakage.leaks(d, e.limit(0)).count() == leakage.leaks(d.limit(0), e).count() == 0


# --- 10: privacy --------------------------------------------------------------------------------------------------
NAMES = frozenset({"irene", "hugo"})


@pytest.mark.parametrize(
    "text, found",
    [
        ("Contact: rastarelli+papers AT example(dot)com, tel. 617-555-0193 Decoding", [("email", "rastarelli+papers AT example(dot)com"), ("phone", "617-555-0193")]),
        ("Mail amina [at] lab dot example dot net or A.B@X.ORG.", [("email", "amina [at] lab dot example dot net"), ("email", "A.B@X.ORG")]),
        ("Call +44 (0)20 79460353, 030/23125679, 01.99.00.80.88 or (010) 5550 0817", [("phone", "+44 (0)20 79460353"), ("phone", "030/23125679"), ("phone", "01.99.00.80.88"), ("phone", "(010) 5550 0817")]),
        ("Participant Hugo van Norowitz (social security 99798192K) withdrew.", [("name", "Hugo van Norowitz"), ("id_number", "99798192K")]),
        ("Mr. Paula-Jo Albreetti and Ms. Kenji G. Wexetti annotated", [("name", "Paula-Jo Albreetti"), ("name", "Kenji G. Wexetti")]),
        ("Parcel for Irene Zettetti, 132-134 Hazelmoor St.. Removing", [("name", "Irene Zettetti"), ("address", "132-134 Hazelmoor St.")]),
        ("The reviewer lives at 162B Cobble Avenue in Town. Adresse : 50 bis rue des Corvales, 99750 X. C/ Corvelo n.º 92, Osserallee 58, ", [("address", "162B Cobble Avenue"), ("address", "50 bis rue des Corvales"), ("address", "C/ Corvelo n.º 92"), ("address", "Osserallee 58")]),
        ("联系人：宓翎翎，邮箱：a@b.test。通讯地址：霁禾大道113号。身份证号：995482195506166826", [("name", "宓翎翎"), ("email", "a@b.test"), ("address", "霁禾大道113号"), ("id_number", "995482195506166826")]),
        ("Later Irene Halvsen spoke.", [("name", "Irene Halvsen")]),
        ("Grant No. 2020-11-0479, ISBN 978-0-00-860860-2, arXiv:2171.07145, Rows 2059-12-31, Stages 1-800-555, Recall@10 and the @dev fold, build 10.0.56.1, (Ulmotto et al., 2021), The Monte Carlo estimate, Kunalifu Institute", []),
        ("", []),
    ],
)
def test_recognisers(text, found):
    assert [(k, text[a:b]) for k, a, b in privacy.find(text, NAMES)] == found


def test_redaction_and_tables(spark):
    d = spark.createDataFrame([(i, f"We thank Dr. Irene Halv{c}en for notes. Later Irene Halv{c}en spoke to Graph Lab.") for i, c in enumerate("abcdef")] + [(10 + i, "We saw Kuva Graph, then Boli Lab and again Mado Net here.") for i in range(40)] + [(90, None), (91, ""), (92, "x " * 100000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in privacy.sanitised(cluttered(d)).collect()}
    assert out[0]["text"] == "We thank Dr. [NAME] for notes. Later [NAME] spoke to Graph Lab." and out[90]["text"] is None and out[92]["n_found"] == 0
    assert privacy.personal_data(d).where("kind = 'name'").count() == 12
    assert privacy.personal_data(d.limit(0)).count() == 0
    scores = {r["term"]: r["bits"] for r in privacy.disclosure(d).where("place = 'opening'").collect()}
    assert scores["irene"] is not None and scores.get("graph") is None


def test_the_gate_lets_every_written_out_address_through():
    from folioflow.llm.privacy import EMAIL, Finder

    find = Finder()
    at = ["@", *(f"{a}{b}{c}{w}{d}{e}{f}" for a in ("", " ") for b, e in ("()", "[]") for c in ("", " ", "\n") for w in ("at", "AT", "@") for d in ("", " ") for f in ("", " ")), *(f"{a}{w}{b}" for a in " \n\u00a0" for w in ("at", "AT") for b in " \t\u3000")]
    dot = [".", *(f"{a}{b}{c}{w}{d}{e}{f}" for a in ("", " ") for b, e in ("()", "[]") for c in ("", " ") for w in ("dot", "DOT") for d in ("", " ") for f in ("", " ")), " dot ", "\nDOT "]
    for a in at:
        for d in dot:
            text = f"jane.doe{a}example{d}org"
            assert EMAIL.fullmatch(text) and ("email", 0, len(text)) in find(text), text
    assert find("They met at noon. It was late at night") == []
