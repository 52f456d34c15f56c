"""Problem 10: personal information in free text, replaced by typed placeholders.

Method: information-theoretic sanitisation. Structured identifiers (addresses, numbers) are read by recognisers. How
strongly a term reveals a protected person is estimated from corpus co-occurrence: the pointwise mutual information of
the term with identity contexts (a title or phrase that introduces a person, or an identifier beside it). Given names are
the terms above the disclosure threshold that open a name; the sanitised text also generalises other capitalised terms, towns
say, that are seen almost only in sentences which hold an identity context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.runtime import cut

#: Disclosure threshold in bits, least number of identity contexts a term must be seen in, and largest lexicon sent out whole.
MIN_BITS, MIN_SUPPORT, MAX_TERMS = 2.0, 3, 200_000

# Words and marks that introduce a person, and particles inside names.
TITLES = r"Dr|Prof|Mr|Mrs|Ms|Mx|Miss|Sir|Herrn?|Frau|M|MM|Mme|Mlle|Monsieur|Madame|Sra?|Dra?|Don|Doña|Señora?"
CUES = (
    rf"(?:(?<![\w.])(?:{TITLES})(?:\. ?| )"
    r"|(?<!\w)(?:[Cc]onta(?:ct|cto)|Kontakt|Ansprechpartner(?:in)?|[Nn]ame|Signed|Firmado|Signé|Gezeichnet|attn\.?|Attention|Author|Maintainers?|Reprints|Interviewee|Speaker|Patient|Employee) ?[:=] ?"
    r"|(?<!\w)(?:[Nn]ame is|Signed by|attn\.?|Participant|Annotator|[Rr]eviewer|[Rr]eviewer,|Parcel for|[Ww]e thank|[Tt]hanks to|[Pp]lease (?:call|contact|ask)|[Cc]orrespondence should go to|(?:passport|license|badge) of|opens with|au nom de|remercions|Joindre|danken|ausgestellt für|Agradecemos a|a nombre de) "
    r"|, by |\[)"
)
PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|el|ter|ten|zu|y|[A-ZÀ-ÞĀ-Ž]\.)"
CAPITALISED = r"[A-ZÀ-ÖØ-ÞĀ-Ž](?:[a-zß-öø-ÿā-ž]+|[A-ZÀ-ÖØ-ÞĀ-Ž]+)(?:['’-][A-ZÀ-ÖØ-ÞĀ-Ž][A-Za-zÀ-ÖØ-öø-ÿĀ-ž]*)*"
#: A superset of what may be a term: every capitalised piece of a word.
_CAPITALISED_PIECE = r"[A-ZÀ-ÖØ-ÞĀ-Ž][A-Za-zÀ-ÖØ-öø-ÿĀ-ž]+"
CUE_WORDS = rf"(?:{TITLES}|Contact|Contacto|Kontakt|Name|Participant|Annotator|Reviewer|Joindre|Agradecemos|Parcel|Signed|Attention|Please)"
PERSON = rf"(?!{CUE_WORDS}[ .:]){CAPITALISED}(?: {PARTICLE})* {CAPITALISED}(?![\w-])"
NEVER = {"The", "This", "That", "These", "Those", "A", "An", "In", "On", "At", "By", "For", "With", "We", "Our", "It", "Most", "Each", "Both", "No", "When", "While", "After", "Before", "Between", "Unlike", "Table", "Figure", "Section", "Nous", "Les", "Le", "La", "Los", "El", "Las", "Die", "Der", "Das", "Wir", "Sans", "Sin", "Ohne", "Monte", "Markov"}

# --- structured identifiers -------------------------------------------------------------------------------------------
_DOT, _AT = r"(?:\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\s(?:dot|DOT)\s|\.)", r"(?:@|\s?[\[(]\s?(?:at|AT|@)\s?[\])]\s?|\s(?:at|AT)\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9@])")
PHONE = re.compile(
    r"""(?<![\w+(.,:/-])(?<!\d\ )(?<!No\.\ )(?:
      (?:\+|00)\d{1,3}[ .-]?(?:\(0\)\ ?)?(?:\(?\d{1,4}\)?[ ./-]?){1,4}\d{2,8}        # international
    | (?:1[ .-]?)?\(\d{3}\)\ ?\d{3}[ .-]?\d{4} | (?:1[ .-])?\d{3}[.\ -]\d{3}[.\ -]\d{4}   # three, three, four
    | 0\d([ .-]?)\d{2}(?:\1\d{2}){3}                                                   # ten digits in twos
    | \(0\d{2,4}\)[ -]?\d{3,4}[ -]?\d{3,4} | 0\d{1,4}[/ -]\d{3,4}[ -]\d{3,4} | 0\d{2,4}[/ -]\d{5,9}(?:-\d{1,4})?
    | 1[3-9]\d[ -]?\d{4}[ -]?\d{4}
    )(?![\w]|[.,/-]\d)""",
    re.X,
)
ID_NUMBER = re.compile(r"(?<![\w.+/-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{6}-\d{4}|[A-Z]\d{8}|\d{8}[A-Z]|[A-Z]\d{2} \d{4} \d{3}|\d{17}[\dXx])(?![\w]|[./-]\d)")
NOT_PERSONAL = re.compile(r"(?:[Gg]rant|ISBN|ISSN|DOI|doi|arXiv|[Cc]ommit|[Bb]uild|[Vv]ersion|[Oo]rder|[Ii]nvoice)(?: (?:[Nn]o|[Nn]r|[Nn]umber)\.?)?:? ?$")
_STREET_EN = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Row|Close|Crescent|Highway|Hwy|Parkway|Pkwy|Alley|Walk|Quay)"
ADDRESS = re.compile(
    rf"""(?<![\w-])(?:
      \d+[A-Za-z]?(?:\ ?[-–/]\ ?\d+[A-Za-z]?)?\ (?:(?:North|South|East|West|N\.|S\.|E\.|W\.)\ )?(?:[A-ZÀ-Þ][\w'’-]*\ ){{1,3}}{_STREET_EN}(?![\w])(?:\.(?=\.|,|\ in\b|\ [a-z]|\n|;|\)))?
    | \d+(?:\ ?[-–/]\ ?\d+)?(?:\ ?(?:bis|ter|quater|[A-Da-d]))?,?\ (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|square)\ (?:(?:de|du|des|la|le|les|d['’]|l['’])\ ?)*[A-ZÀ-Þ][\w'’-]+(?:\ [A-ZÀ-Þ][\w'’-]+)*
    | [A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|allee|gasse|weg|platz|ring|ufer|damm|steig)\ \d+(?:\ ?[a-z](?![\w]))?(?:\ ?[-–]\ ?\d+)?
    | [A-ZÄÖÜ][\wäöüß-]+\ (?:Straße|Allee|Gasse|Weg|Platz|Ring)\ \d+(?:\ ?[a-z](?![\w]))?
    | (?:C/|Calle|Avenida|Avda\.?|Av\.|Paseo|Plaza|Camino|Carrera|Ronda|Travesía)\ ?(?:(?:de|del|la|las|los|el)\ )*[A-ZÁÉÍÓÚÑ][\wáéíóúñ'’-]+(?:\ (?:(?:de|del|la|las|los|y)\ )*[A-ZÁÉÍÓÚÑ][\wáéíóúñ'’-]+)*,?\ (?:n\.?[º°o]\.?\ ?)?\d+(?:\ ?[A-Za-z](?![\w]))?
    )""",
    re.X,
)
ADDRESS_ZH = re.compile(r"(?:(?<=[：:，,。；;\s])|^)[㐀-鿿]{1,8}?(?:大道|街道|大街|街|路|巷|弄|胡同)\d+(?:号|號)")
NAME_ZH = re.compile(r"(?:联系人|姓名|负责人|作者|经办人|收件人|申请人|患者|受访者)[：:]\s?([㐀-鿿]{2,4})(?![㐀-鿿])|(?:感谢|致谢)([㐀-鿿]{2,4}?)(?=老师|先生|女士|教授|博士|同学)")
_CUE_END, _PERSON = re.compile(rf"{CUES}$"), re.compile(PERSON)
_FOLLOW = re.compile(r"\s*,?\s*(?:and|und|et|y|&|,)\s+(?:(?:" + TITLES + r")\.? )?$")

#: Capitalised pairs as the JVM counts them: all, and those right after a cue (looked for behind a capital only).
_PAIR_JVM = rf"(?<![\w.@'’-]){PERSON}"
_CUED_JVM = rf"(?=[A-ZÀ-ÞĀ-Ž])(?<={CUES}){PERSON}"


def opening(term: str) -> str:
    """Given names compare without case and without what a hyphen adds."""
    return re.split(r"[-'’]", term)[0].lower()


def disclosure(documents: DataFrame) -> DataFrame:
    """(place, term, seen, cued, bits): PMI in bits between a term at one place of a capitalised pair and identity contexts.

    ``place`` is 'opening' or 'closing'. Counted over all documents in one scan with map-side aggregation; no text is
    shuffled, and the counts are written once, as two results are drawn from them.
    """
    # each pattern runs once a text; the pairs become rows before anything else is computed from them
    found = F.explode(F.array(*(F.struct(F.lit(cued).alias("cued"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("pairs")) for cued, p in enumerate((_PAIR_JVM, _CUED_JVM)))))
    pairs = documents.select(found.alias("f")).select("f.cued", F.explode("f.pairs").alias("pair"))
    terms = F.explode(F.array(
        F.struct(F.lit("opening").alias("place"), F.lower(F.regexp_extract("pair", r"^[^-'’ ]+", 0)).alias("term")),
        F.struct(F.lit("closing").alias("place"), F.lower(F.regexp_extract(F.substring_index("pair", " ", -1), r"^[^-'’]+", 0)).alias("term")),
    ))
    counts = pairs.select("cued", terms.alias("x")).groupBy("x.place", "x.term").agg(F.sum(1 - F.col("cued")).alias("seen"), F.sum("cued").alias("cued"))
    counts = cut(counts.withColumn("seen", F.greatest("seen", "cued")))
    totals = counts.where("place = 'opening'").agg(F.sum("seen").alias("all_seen"), F.sum("cued").alias("all_cued"))
    bits = F.log2((F.col("cued") / F.col("seen")) / (F.col("all_cued") / F.col("all_seen")))
    return counts.join(F.broadcast(totals)).select("place", "term", "seen", "cued", F.when(F.col("cued") > 0, bits).alias("bits"))


def lexicon(documents: DataFrame, *, min_bits: float = MIN_BITS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(list, term): given names (openings that reveal a person), and closings that do not belong to names (common in pairs,
    rarely cued)."""
    scored = disclosure(documents)
    names = scored.where((F.col("place") == "opening") & (F.col("cued") >= min_support) & (F.col("bits") >= min_bits) & (F.col("cued") >= 0.3 * F.col("seen")))
    common = scored.where((F.col("place") == "closing") & (F.col("seen") >= 20) & (F.col("cued") < 0.2 * F.col("seen")))
    return names.select(F.lit("name").alias("list"), "term").unionByName(common.select(F.lit("common").alias("list"), "term"))


_IDENTITY_JVM = rf"(?=[A-ZÀ-ÞĀ-Ž])(?<={CUES})[A-ZÀ-ÞĀ-Ž]|@[A-Za-z]|\d{{3}}[-. ]\d{{2,4}}[-. ]\d{{3,4}}"
_INNER_JVM = r"(?<=[a-zà-ÿ,;] )[A-ZÀ-ÞĀ-Ž][a-zß-öø-ÿ]{3,}(?![\w-])"


def disclosing_terms(documents: DataFrame, *, min_bits: float = 3.0, min_support: int = 5) -> DataFrame:
    """(list, term): capitalised terms inside sentences whose PMI with sentences of identity context is at least ``min_bits`` and that
    are rarely seen elsewhere; the words that introduce persons are not terms."""
    sentence = documents.where("text is not null").select(F.explode(F.split("text", r"(?<=[.!?。！？])\s+|\n")).alias("s"))
    # the empty term stands for the sentence itself, so that one pass gives the totals too
    each = sentence.select(F.col("s").rlike(_IDENTITY_JVM).cast("int").alias("cued"), F.explode(F.array_union(F.array(F.lit("")), F.regexp_extract_all("s", F.lit(_INNER_JVM), F.lit(0)))).alias("term"))
    counts = cut(each.groupBy("term").agg(F.count("*").alias("seen"), F.sum("cued").alias("cued")))
    share = counts.where("term = ''").select((F.col("cued") / F.col("seen")).alias("share"))
    bits = F.log2(F.col("cued") / F.col("seen") / F.col("share"))
    kept = counts.where((F.col("term") != "") & (F.col("cued") >= min_support)).join(F.broadcast(share)).where((bits >= min_bits) & (F.col("cued") >= 0.8 * F.col("seen")))
    return kept.where(~F.col("term").rlike(rf"^{CUE_WORDS}$")).select(F.lit("term").alias("list"), "term")


# What a text must hold before the recognisers of a kind are worth running; one automaton looks for all of it at once.
_EMAIL, _ADDRESS, _CUE, _SPACED = 1, 2, 4, 8
_SPACES = [chr(c) for c in range(0x3001) if re.match(r"\s", chr(c))]
_SPACED_AT = re.compile(rf"\s(?:at|AT)\s[A-Za-z0-9][A-Za-z0-9-]*{_DOT}")
_SIGNS = {
    # every way of _AT; between blanks it is common in prose, so there the label and dot that follow are looked for first
    _EMAIL: ("@", *(f"{b}{space}{at}" for b in "([" for space in ("", *_SPACES) for at in ("at", "AT"))),
    _SPACED: tuple(f"{a}{at}{b}" for a in _SPACES for b in _SPACES for at in ("at", "AT")),
    _ADDRESS: (
        *(f" {x}" for x in "Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Dr Court Ct Place Pl Square Sq Terrace Way Row Close Crescent Highway Hwy Parkway Pkwy Alley Walk Quay".split()),
        *(f" {x} " for x in "rue avenue boulevard place chemin impasse allée quai route cours square".split()),
        *(f"{x} {n}" for x in "straße strasse str. allee gasse weg platz ring ufer damm steig Straße Allee Gasse Weg Platz Ring".split() for n in range(10)),
        "C/", "Calle ", "Avenida ", "Avda", "Av.", "Paseo ", "Plaza ", "Camino ", "Carrera ", "Ronda ", "Travesía ",
        *(f"{x}{n}" for x in ("道", "街", "路", "巷", "弄", "胡同") for n in range(10)),
    ),
    _CUE: (
        *(f"{x}{end}" for x in TITLES.replace("Herrn?", "Herr|Herrn").replace("Sra?", "Sr|Sra").replace("Dra?", "Dr|Dra").replace("Señora?", "Señor|Señora").split("|") for end in (". ", " ", ".")),
        "ontact", "ontakt", "nsprechpartner", "ame is ", *(f"{x}{end}" for x in ("ame", "Signed", "Firmado", "Signé", "Gezeichnet", "Attention", "Author", "Interviewee", "Speaker", "Patient", "Employee") for end in (":", " :", "=", " =")),
        "Signed by", "attn", "Maintainer", "Reprints", "Participant", "Annotator", "eviewer", "Parcel for", "e thank", "hanks to", "lease call", "lease contact", "lease ask", "orrespondence", "passport of", "license of", "badge of", "opens with", "au nom de", "remercions", "Joindre", "danken", "ausgestellt", "Agradecemos", "a nombre de", ", by ", "[",
        "联系人", "姓名", "负责人", "作者：", "作者:", "经办人", "收件人", "申请人", "患者", "受访者", "感谢", "致谢",
    ),
}
_DIGITS, _LETTERED = re.compile(r"[+(\d][\d ().\-/]{7,}"), re.compile(r"[A-Z]\d\d[\d ]\d{3}")


class Finder:
    """The recognisers with one lexicon: given names, and closings that do not belong to names."""

    def __init__(self, names: frozenset = frozenset(), common: frozenset = frozenset()):
        self.names, self.common = names, common
        signs: dict[str, int] = {}
        for bit, found in _SIGNS.items():
            for x in found:
                signs[x] = signs.get(x, 0) | bit
        for name in names:
            for x in (name.title(), name.upper(), name.capitalize()):
                signs[x] = signs.get(x, 0) | _CUE
        self.signs = ahocorasick.Automaton()
        for x, bits in signs.items():
            self.signs.add_word(x, bits)
        self.signs.make_automaton()

    def __call__(self, text: str, names: frozenset = frozenset(), common: frozenset = frozenset()) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the personal data in ``text``, without overlaps, in order; ``names`` and ``common`` are what the
        lexicon has for this text, where it is not sent out whole."""
        signs = _CUE if names else 0
        for _, bits in self.signs.iter(text):
            signs |= bits
        if signs & _SPACED:
            signs = signs & ~_SPACED | (_EMAIL if _SPACED_AT.search(text) else 0)
        numbers = _DIGITS.search(text) or _LETTERED.search(text)
        if not signs and not numbers:
            return []
        spans: list[tuple[str, int, int]] = []

        def add(kind: str, a: int, b: int) -> bool:
            if any(a < y and x < b for _, x, y in spans):
                return False
            spans.append((kind, a, b))
            return True

        if signs & _EMAIL:
            for m in EMAIL.finditer(text):
                plain_at = "@" not in m[0] and re.search(r"\s(?:at|AT)\s", m[0])
                if plain_at and " AT " not in m[0] and not re.search(r"(?i)[\[(]\s?dot\s?[\])]|\sdot\s", m[0]) and not re.search(r"[._+\d]", m[0].split(" ")[0]):
                    continue
                add("email", *m.span())
        if numbers:
            for m in ID_NUMBER.finditer(text):
                if not NOT_PERSONAL.search(text, max(0, m.start() - 24), m.start()):
                    add("id_number", *m.span())
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15 and not NOT_PERSONAL.search(text, max(0, m.start() - 24), m.start()):
                    add("phone", *m.span())
        if signs & _ADDRESS:
            for m in ADDRESS.finditer(text):
                add("address", *m.span())
            if not text.isascii():
                for m in ADDRESS_ZH.finditer(text):
                    add("address", *m.span())
        if signs & _CUE or spans:
            self._persons(text, spans, add, self.names | names, self.common | common)
        return sorted(spans, key=lambda s: s[1])

    def _persons(self, text: str, spans: list, add, names: frozenset, common: frozenset) -> None:
        if not text.isascii():
            for m in NAME_ZH.finditer(text):
                add("name", *m.span(1 if m[1] else 2))
        beside = {a for _, a, _ in spans}
        last_end = at = -1
        while m := _PERSON.search(text, at + 1):
            a, b = m.span()
            at = a
            if a and (text[a - 1].isalnum() or text[a - 1] in "_.@'’-") and not (text[a - 1] == "." and _CUE_END.search(text, max(0, a - 24), a)):
                continue
            first, last = m[0].split(" ")[0], m[0].split(" ")[-1]
            if first in NEVER or last in NEVER or last.lower() in common:
                continue
            # a cue before it, an identifier right after it, or another name joined by "and" or a comma is an identity context
            revealed = opening(first) in names or _CUE_END.search(text, max(0, a - 48), a)
            revealed = revealed or any(text[b : b + k].strip(" ,(<[\n") == "" and b + k in beside for k in range(1, 5))
            revealed = revealed or 0 <= last_end <= a and _FOLLOW.fullmatch(text[last_end:a])
            if revealed and add("name", a, b):
                last_end, at = b, b - 1


def find(text: str, names: frozenset = frozenset(), common: frozenset = frozenset()) -> list[tuple[str, int, int]]:
    return Finder(names, common)(text)


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


_TERM = re.compile(r"(?<![\w-])[A-ZÀ-ÞĀ-Ž][a-zß-öø-ÿ]{3,}(?![\w-])")


def redact(text: str, spans: list[tuple[str, int, int]], terms: frozenset = frozenset()) -> str:
    """Typed placeholders for the spans; ``terms`` elsewhere become ``[TERM]``."""
    out, at = [], 0
    soften = (lambda s: _TERM.sub(lambda m: "[TERM]" if m[0] in terms else m[0], s)) if terms else str
    for kind, a, b in spans:
        out += [soften(text[at:a]), PLACEHOLDER[kind]]
        at = b
    return "".join([*out, soften(text[at:])])


Known = dict[str, frozenset]
_NO_TERMS: Known = {"name": frozenset(), "common": frozenset(), "term": frozenset()}


def _apply(documents: DataFrame, terms: DataFrame | Known, make, schema: str, columns: list[str], max_terms: int = MAX_TERMS) -> DataFrame:
    """Each text through the recognisers with its part of ``terms`` (list, term).

    Up to ``max_terms`` terms go out whole. More are joined with the capitalised words of each document, whatever their number, and
    each text gets those it holds; the result is the same.
    """
    whole, given = _NO_TERMS, documents.select("doc_id", "text")
    if isinstance(terms, dict):
        whole = {**_NO_TERMS, **terms}
    else:
        terms = cut(terms)
        rows = terms.limit(max_terms + 1).collect()
        if len(rows) <= max_terms:
            whole = {k: frozenset(r["term"] for r in rows if r["list"] == k) for k in _NO_TERMS}
        else:
            held = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_CAPITALISED_PIECE), F.lit(0)), lambda w: F.lower(w))))
            # repeated ids have their texts told apart by a hash
            given = given.withColumn("h", F.xxhash64("text"))
            own = given.select("doc_id", "h", held.alias("low")).distinct().join(terms.withColumn("low", F.lower("term")), "low").groupBy("doc_id", "h").agg(F.collect_set(F.struct("list", "term")).alias("own"))
            given = given.join(own, ["doc_id", "h"], "left").select("doc_id", "text", "own")
    sent = documents.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = sent.value
        finder = Finder(every["name"], every["common"])
        for batch in batches:
            memo: dict[str, tuple] = {}
            out = []
            for id_, text, own in zip(batch["doc_id"], batch["text"], batch["own"] if "own" in batch else [None] * len(batch)):
                if text is not None and text not in memo:
                    mine = {k: frozenset(x["term"] for x in own if x["list"] == k) for k in _NO_TERMS} if own is not None else _NO_TERMS
                    memo[text] = finder(text, mine["name"], mine["common"]), mine["term"] | every["term"]
                out += make(id_, text, *memo.get(text, ([], frozenset())))
            yield pd.DataFrame(out, columns=columns)

    return given.mapInPandas(run, schema)


def personal_data(documents: DataFrame, known: Known | None = None, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, kind, found, start_char, end_char), one row per mention; null and blank texts have none."""
    given = documents.where("text is not null")
    mentions = lambda i, t, spans, _: [(i, k, t[a:b], a, b) for k, a, b in spans]
    return _apply(given, lexicon(given) if known is None else known, mentions, "doc_id long, kind string, found string, start_char int, end_char int", ["doc_id", "kind", "found", "start_char", "end_char"], max_terms)


def sanitised(documents: DataFrame, known: Known | None = None, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, text, n_found): the text with typed placeholders and generalised terms; a null text stays null."""
    terms = lexicon(documents).unionByName(disclosing_terms(documents)) if known is None else known
    rewritten = lambda i, t, spans, terms: [(i, None if t is None else redact(t, spans, terms), len(spans))]
    return _apply(documents, terms, rewritten, "doc_id long, text string, n_found int", ["doc_id", "text", "n_found"], max_terms)
