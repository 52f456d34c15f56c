"""What models reply, read back into columns: JSON out of free text, scores, kinds of questions and graph queries.

A reply that cannot be read gives null, an empty array or the given default, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.text import strip_think
from folioflow.operators.graph import first_of_each, valid_triples, vote

#: Shortest and longest passage that is sent for triples, in characters.
SHORTEST, LONGEST = 20, 2000


def bare(reply: Column | str) -> Column:
    """The reply without think blocks and code fences; null gives the empty text."""
    given = F.coalesce(F.col(reply) if isinstance(reply, str) else reply, F.lit(""))
    return F.trim(F.regexp_replace(strip_think(given), r"(?m)^\s*```[A-Za-z]*\s*$", ""))


def json_array(reply: Column | str, of: str) -> Column:
    """The outermost array of a reply, read as ``array<of>``; empty where there is none or it is broken."""
    found = F.regexp_extract(bare(reply), r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.when(found != "", found), f"array<{of}>"), F.from_json(F.lit("[]"), f"array<{of}>"))


def json_object(reply: Column | str, of: str) -> Column:
    """The outermost object of a reply as a struct of the fields ``of``; its fields are null where there is none."""
    found = F.regexp_extract(bare(reply), r"(?s)\{.*\}", 0)
    return F.from_json(F.when(found != "", found).otherwise(F.lit("{}")), of)


def scores(reply: Column | str) -> Column:
    """Array of (index, score): from a JSON array, else from every ``index: n ... score: x`` in the text."""
    read = F.filter(json_array(reply, "struct<index:int,score:double>"), lambda x: x["index"].isNotNull() & x["score"].isNotNull())
    pair = r"(?is)index\W{1,4}(\d+).{0,12}?score\W{1,4}(-?\d+(?:\.\d+)?)"
    loose = F.arrays_zip(F.regexp_extract_all(bare(reply), F.lit(pair), F.lit(1)).alias("index"), F.regexp_extract_all(bare(reply), F.lit(pair), F.lit(2)).alias("score"))
    return F.when(F.size(read) > 0, read).otherwise(F.transform(loose, lambda x: F.struct(x["index"].cast("int").alias("index"), x["score"].cast("double").alias("score"))))


def classified(reply: Column | str) -> Column:
    """Struct (type, confidence) of a model's word on the kind of a question: an unknown kind is a fact, the confidence lies in 0..1 and is 0.5
    where none is given; a reply without a kind is a fact at 0.3."""
    read = json_object(reply, "type string, confidence double")
    kind = F.lower(F.trim(read["type"]))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(read["confidence"], F.lit(0.5))))
    return F.struct(F.when(kind.isin("fact", "relation", "summary"), kind).otherwise("fact").alias("type"), F.when(kind.isNull(), 0.3).otherwise(sure).alias("confidence"))


def triples(passages: DataFrame, reply: str = "reply", text: str = "text") -> DataFrame:
    """``passages`` with the triples of each reply as rows (seq, subject, relation, object), checked against the passage.

    Passages under 20 characters were not asked for and give none; of a longer one the first 2,000 characters count. A triple without
    one of its parts is none.
    """
    found = F.filter(json_array(reply, "struct<subject:string,relation:string,object:string>"), lambda x: x["subject"].isNotNull() & x["relation"].isNotNull() & x["object"].isNotNull())
    each = passages.where(F.length(F.trim(text)) >= SHORTEST).withColumn("passage", F.substring(text, 1, LONGEST)).withColumn("found", found)
    rest = [c for c in passages.columns if c not in (reply, text, "subject", "relation", "object", "seq")]
    return valid_triples(each.select(*rest, "passage", F.posexplode("found").alias("seq", "x")).select(*rest, "passage", "seq", "x.*")).drop("passage")


def extracted(passages: DataFrame, order: list[str], reply: str = "reply", text: str = "text") -> DataFrame:
    """(subject, relation, object, ...) once each over all passages, with the place of the first."""
    return first_of_each(triples(passages, reply, text), [*order, "seq"], ["subject", "relation", "object"])


def voted(passes: list[DataFrame]) -> DataFrame:
    """Triples of several passes over the same passages with their number of votes, most first and then by subject."""
    return vote(passes).orderBy(F.desc("count"), "subject", "relation", "object")


def graph_query(reply: Column | str) -> Column:
    """The query a model wrote, from its first MATCH on; null where there is none."""
    found = F.regexp_extract(bare(reply), r"(?is)\b(?:optional\s+)?match\b.*", 0)
    return F.when(found != "", F.trim(F.regexp_replace(found, r"\s+", " ")))
