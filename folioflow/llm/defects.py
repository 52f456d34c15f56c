"""Problem 6: unusable question and answer pairs, each with its defect.

Method: distinct answers, without the marks they end with, are range-partitioned and sorted by text; where the common prefix
with the successor is the whole answer, it is a shortened version, and sharp peaks of the length distribution mark length
limits. Either makes an answer truncated that no full stop closes, whatever its words. Rules for emptiness, copied questions, refusals,
broken endings and languages follow, over the distinct pairs only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioflow.runtime import cut

# Labels before an answer, stand-ins for nothing, function words by language, and the wording of refusals.
LABELS = ("question", "answer", "response", "reply", "output", "q", "a", "frage", "antwort", "pregunta", "respuesta", "réponse", "reponse", "问题", "问", "答案", "回答", "答")
NOTHING = {"n/a", "na", "n.a.", "null", "none", "nil", "nan", "nothing", "empty", "tbd", "todo", "undefined", "unknown", "no answer", "无", "空", "暂无", "没有", "keine", "keine antwort", "aucune", "aucun", "rien", "ninguna", "ninguno", "nada", "sin respuesta", "sans réponse", "无答案", "未知"}
FUNCTION_WORDS = {
    "en": "the a an of and to is are was were be been for with by on in at from that this these it its we our they as not no than when while after before because although whether each both which what how why who between during over under into only more most has have does do did can cannot i summarize describe explain name".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war wird werden mit von vom zu zum zur bei auf aus für nicht kein keine wir ihr sich als auch nach vor über unter durch ohne um im am während obwohl weil dass welche welcher welches wie warum was bleibt sinkt braucht nutzt".split(),
    "fr": "le la les un une des du de et ou est sont était avec pour par sur dans en au aux ce cette ces nous vous ils que qui quoi ne pas sans après avant quelle quel pourquoi comment tandis ainsi dont se son sa ses leur tombe repose à".split(),
    "es": "el la los las un una unos unas y o es son era con para por sobre en del al de que no sin nosotros se su sus lo como mientras cuando porque qué cuál cómo cuánto este esta estos muy más mucho poco tras usa".split(),
}
REFUSALS = re.compile(
    r"""
    \b(?:i|we)\s(?:really\s|simply\s|just\s)?(?:can(?:no|')t|can\snot|could\snot|couldn't|am\snot\sable|am\sunable|are\sunable|are\snot\sable|won't\sbe\sable|will\snot\sbe\sable|don't\shave\s(?:enough|any|the|sufficient)|do\snot\shave\s(?:enough|any|the|sufficient)|must\s(?:refrain|decline|pass|refuse)|have\sto\s(?:decline|pass|refuse)|would\srather\snot|prefer\snot|do\snot\sfeel|don't\sfeel|am\snot\sin\sa\sposition|am\snot\sallowed|am\snot\spermitted|don't\sknow|do\snot\sknow|decline|refuse)
    | \bi'(?:d\shave\sto\s(?:pass|decline)|m\s(?:afraid|sorry|unable|not\sable|not\sin\sa)|d\srather\snot)
    | \bwhat\si\scan\sdo\b | \bbeyond\s(?:me|my)\b | \bno\sway\sfor\sme\b | \blets?\sme\b | \b(?:not\s)?(?:possible|enough\s.{0,60})\sfor\sme\b | \ballows?\sme\b | \bas\sa(?:n\sai)?\slanguage\smodel\b
    | \bich\b.{0,60}\b(?:nicht|kein\w*)\b | \b(?:kann|möchte|darf)\sich\b.{0,60}\b(?:nicht|kein\w*)\b | \bmir\b.{0,30}\b(?:kein\w*|nicht)\b
    | \bje\s(?:ne\s|n'|préfère\sne|regrette|suis\sdésolée?) | \bdésolée?\b.{0,20}\bje\b | \bne\sme\spermet
    | \blo\ssiento\b | \b(?:no\s(?:puedo|tengo|dispongo|me\ses\sposible|estoy\sen)|prefiero\sno|no\ssabría)\b
    """,
    re.I | re.X,
)
REFUSALS_ZH = re.compile(r"无法(?:回答|得出|给出|提供|判断|确定|作答)|(?:不便|不能|不好|难以|拒绝)(?:回答|作答|提供|评论|判断)|没有足够的?(?:信息|资料|依据)|(?:抱歉|对不起).{0,12}(?:无法|不能|没有|不便)|我(?:无法|不能|不便|不知道)|未(?:找到|提供).{0,8}(?:信息|资料|答案)|超出.{0,6}(?:能力|范围)")
CJK = re.compile(r"[㐀-鿿豈-﫿]")

_MARKUP, _LABEL = re.compile(r"<[^<>\n]{0,40}>"), re.compile(rf"(?:^|(?<=[\s>*#(\"'“«]))(?:{'|'.join(sorted(LABELS, key=len, reverse=True))})\s*[:：]", re.I)
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_STATED = re.compile(r"\d|(?<=[^\W\d_]\s)[A-ZÀ-Þ][\w-]{2,}")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])(\s.*)?$")


def bare(text: str) -> str:
    """Without markup and labels."""
    return _LABEL.sub(" ", _MARKUP.sub(" ", text))


def squeeze(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def is_empty(answer: str) -> bool:
    rest = bare(answer)
    return not squeeze(rest) or rest.strip(" \t\r\n.\"'*`_()[]{}<>-–—:").lower() in NOTHING or rest.strip().lower() in NOTHING


def copies_question(question: str, answer: str) -> bool:
    """Whether nothing but the question, once or repeated, is left of the answer."""
    q = squeeze(bare(question)) or squeeze(question)
    for a in (squeeze(bare(answer)), squeeze(answer)):
        if q and a and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
            return True
    return False


def language(text: str, least: int = 2) -> str | None:
    """Language of a whole sentence by its function words, of which ``least`` must be there; None where too little tells."""
    cjk = len(CJK.findall(text))
    found = [w.lower() for w in _WORD.findall(CJK.sub(" ", text))]
    if cjk >= 6 and cjk > 2 * sum(w in ALL_FUNCTION_WORDS for w in found):
        return "zh"
    score = {k: sum(w in v for w in found) for k, v in _SETS.items()}
    order = sorted(score, key=lambda k: -score[k])
    if score[order[0]] >= least and score[order[0]] > score[order[1]]:
        return order[0]
    return None


_SETS = {k: set(v) for k, v in FUNCTION_WORDS.items()}
ALL_FUNCTION_WORDS = set().union(*_SETS.values())


def is_refusal(answer: str) -> bool:
    """Whether the answer only declines: a refusal in its first sentence, then excuses or pointers elsewhere, of any length. Three
    sentences that state something (a number or a name in it) and decline nothing make an answer of it."""
    text = unicodedata.normalize("NFKC", bare(answer)).replace("’", "'").strip()
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    if not parts or not declines(parts[0]):
        return False
    return sum(bool(_STATED.search(p)) and not declines(p) for p in parts[1:]) < 3


def declines(sentence: str) -> bool:
    return bool(REFUSALS.search(sentence) or REFUSALS_ZH.search(sentence))


def breaks_off(answer: str) -> bool:
    """Whether the text ends inside a word, number, sentence, list or bracket, judged by the text alone."""
    text = answer.rstrip()
    if not text:
        return False
    for a, b in ("()", "[]", "（）", "“”", "«»"):
        if text.count(a) > text.count(b):
            return True
    if text.count('"') % 2:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    item = _LIST_ITEM.match(lines[-1])
    if item and len(lines) > 1 and not squeeze(item[1] or ""):
        return True
    last = text.rstrip("\"'”’»)]）*_`")[-1:] or text[-1]
    if last in ",;:，；：、-–—(（[" or re.search(r"\w[-–]$", text):
        return True
    if last in ".!?。！？…":
        if re.search(r"(?<![\w.,])\d+\.$", text) and not re.search(r"(?:19|20)\d\d\.$", text):
            return True
        return bool(re.search(r"\d\.$", text)) and language(text) == "zh"
    if CJK.search(text[-12:]) or language(text) == "zh":
        return len(CJK.findall(text)) >= 8
    if all(_LIST_ITEM.match(x) for x in lines) and len(lines) > 1:
        return False
    # no full stop: short values, names and quoted terms are complete, sentences and texts of several are not
    found = _WORD.findall(text)
    if re.search(r"[.!?。！？]\s+\S", text) or "," in text or ";" in text:
        return True
    if len(re.findall(r"(?<!\S)[^\W\d_A-Z][^\W\d_-]+(?:-[^\W\d_]+)*(?!\S)", text)) >= 3:
        return True
    return len(found) >= 4 and sum(w.lower() in ALL_FUNCTION_WORDS for w in found) + (len(found) >= 6) + (found[0].lower() in _OPENERS) >= 2 or len(found) >= 2 and found[0].lower() in _OPENERS


_OPENERS = {"the", "a", "an", "our", "we", "each", "both", "no", "most", "between", "when", "unlike", "removing", "adding", "errors", "figure", "table", "with", "it", "for", "in", "on", "as", "by", "at", "after", "during", "under", "across", "der", "die", "das", "wir", "ohne", "für", "nach", "im", "bei", "trotz", "in", "le", "la", "les", "nous", "sans", "pour", "après", "dans", "en", "à", "el", "los", "las", "sin", "con", "para", "tras", "comparamos"}


def _unclosed(answer: str) -> bool:
    """Several words without an end of their own: no stop or closing mark, or dots that leave something out."""
    text = answer.rstrip()
    return (text[-1:] not in ".!?。！？)\"”" or text.endswith("...")) and len(_WORD.findall(text)) > 3


def defect(question: str | None, answer: str | None, shortened: bool = False, at_limit: bool = False) -> str | None:
    """At most one defect, in the order empty, copies_question, refusal, truncated, other_language.

    A null answer is empty. A null question cannot be copied and has no language. ``shortened``: a longer answer begins
    with this one; ``at_limit``: its length is a peak of the distribution; either alone does not make a complete text a case.
    """
    if answer is None or is_empty(answer):
        return "empty"
    if question and copies_question(question, answer):
        return "copies_question"
    if is_refusal(answer):
        return "refusal"
    if breaks_off(answer) or (shortened or at_limit) and _unclosed(answer):
        return "truncated"
    asked, given = language(question or "", 1), language(answer)
    if asked and given and asked != given and (len(_WORD.findall(answer)) >= 5 or given == "zh"):
        return "other_language"
    return None


@F.pandas_udf(T.StringType())
def _defects(question: pd.Series, answer: pd.Series, shortened: pd.Series, at_limit: pd.Series) -> pd.Series:
    memo: dict[tuple, str | None] = {}
    out = []
    for key in zip(question, answer, shortened, at_limit):
        if key not in memo:
            memo[key] = defect(*key)
        out.append(memo[key])
    return pd.Series(out, dtype=object)


#: Marks that may stand at the end of an answer, whole or shortened; they do not count when prefixes are compared.
_END_MARKS = " \t\r\n.…-–—\"'”’»"


def _core(answer: str) -> Column:
    return F.rtrim(F.col(answer), F.lit(_END_MARKS))


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [batch.column("core")[0].as_py()]}, schema=pa.schema([("part", pa.int32()), ("first", pa.string())]))
            return


def shortened_answers(answers: DataFrame, partitions: int | None = None) -> DataFrame:
    """(core): distinct answers, without end marks, that are a proper prefix of another one. In sorted order every text between
    an answer and an extension of it starts with it too, so the common prefix with the successor decides; across
    partitions, that with the next one's first text."""
    n = partitions or int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = answers.select(_core("answer").alias("core")).where("core <> ''").distinct()
    ordered = cut(distinct.repartitionByRange(n, "core").sortWithinPartitions("core"))
    # one row a partition
    edges = sorted((r["part"], r["first"]) for r in ordered.mapInArrow(_first_texts, "part int, first string").collect())
    after = {p: q for (p, _), (_, q) in zip(edges, edges[1:])}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for text in batch.column("core").to_pylist():
                if held and text.startswith(held):
                    out.append(held)
                held = text
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["core"])
        beyond = after.get(TaskContext.get().partitionId())
        if held and beyond and beyond.startswith(held):
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.string())], names=["core"])

    return ordered.mapInArrow(scan, "core string")


def limit_lengths(answers: DataFrame, *, least: int = 40, times: float = 5.0) -> DataFrame:
    """Lengths at which far more distinct answers end than at the neighbouring ones: (n_chars)."""
    hist = answers.where(F.length("answer") >= least).select(F.length("answer").alias("n_chars"), F.xxhash64("answer").alias("h")).distinct().groupBy("n_chars").agg(F.count("*").alias("n"))
    around = hist.select(F.explode(F.array(*(F.col("n_chars") + k for k in (-3, -2, -1, 1, 2, 3)))).alias("n_chars"), "n").groupBy("n_chars").agg(F.sum("n").alias("near"))
    return hist.join(around, "n_chars", "left").where(F.col("n") > times * (F.coalesce("near", F.lit(0)) / 6 + 2)).select("n_chars")


def defects(answers: DataFrame) -> DataFrame:
    """(answer_id, defect) of the defective pairs among rows with ``error`` null.

    The prefix search and the length peaks run over distinct answers; their findings come back by a join on a hash of the answer, so that only the few shortened answers are shuffled against the table. Repeated rows count each; an empty table gives
    no rows.
    """
    valid = answers.where("error is null").select("answer_id", "question", "answer")
    short = shortened_answers(valid).select(F.xxhash64("core").alias("h"), F.lit(True).alias("shortened")).distinct()
    limits = limit_lengths(valid).withColumn("at_limit", F.lit(True))
    marked = valid.withColumn("h", F.xxhash64(_core("answer"))).withColumn("n_chars", F.length("answer")).join(short, "h", "left").join(limits, "n_chars", "left")
    false = F.lit(False)
    return marked.select("answer_id", _defects("question", "answer", F.coalesce("shortened", false), F.coalesce("at_limit", false)).alias("defect")).where("defect is not null")
