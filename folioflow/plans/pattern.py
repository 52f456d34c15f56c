"""A read-only graph pattern language (the small part of Cypher the graph needs), compiled to DataFrame plans.

    MATCH (a:Entity)-[r:RELATES_TO]->(b:Entity) WHERE <condition> RETURN ... LIMIT n
    MATCH p = (a:Entity)-[r:RELATES_TO*1..3]->(b:Entity) WHERE <condition> RETURN p LIMIT n

Conditions are comparisons of ``x.name`` or ``r.relation`` with literals, joined by AND, OR, NOT and brackets. Whatever is
returned, the plan yields subject, predicate and object, or the path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.operators import graph

FORBIDDEN = set("CREATE MERGE DELETE DETACH SET REMOVE DROP CALL YIELD LOAD CSV PERIODIC ITERATE SHORTEST ALLSHORTEST EXPLAIN PROFILE USE".split())
_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_HEAD = re.compile(r"(?is)^\s*(?:OPTIONAL\s+)?MATCH\s+(?:\w+\s*=\s*)?\(\s*(?P<n1>\w*)\s*(?::\s*Entity)?\s*\)\s*(?P<l><?)-\[\s*(?P<r>\w*)\s*:\s*RELATES_TO\s*(?P<var>\*\s*(?:(?P<lo>\d+)\s*\.\.\s*(?P<hi>\d+)|(?P<n>\d+))?)?\s*\]-(?P<g>>?)\s*\(\s*(?P<n2>\w*)\s*(?::\s*Entity)?\s*\)\s*(?:WHERE\s+(?P<where>.*?))?\s*RETURN\s+(?P<ret>.*)$")
_TOKEN = re.compile(r"\s*(?:(?P<lit>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>STARTS\s+WITH|ENDS\s+WITH|CONTAINS|IN\b|<>|=)|(?P<word>\w+\.\w+|\w+)|(?P<p>[()\[\],]))", re.I)


class PatternError(ValueError):
    pass


def guard(query: str | None) -> tuple[bool, str]:
    """Whether a query only reads: no writing word outside literals, one MATCH with a RETURN, no second statement."""
    if not query or not query.strip():
        return False, "empty query"
    bare = _LITERAL.sub("''", query).upper()
    for word in re.findall(r"\b[A-Z]+\b", bare):
        if word in FORBIDDEN:
            return False, f"forbidden word {word}"
    if not bare.strip().startswith(("MATCH", "OPTIONAL")):
        return False, "no MATCH"
    if not re.search(r"\bRETURN\b", bare):
        return False, "no RETURN"
    return (False, "several statements") if ";" in bare else (True, "")


@dataclass
class Pattern:
    subject: str
    object: str
    relation: str
    hops: tuple[int, int] | None
    where: tuple | None
    limit: int

    @property
    def anchors(self) -> set[str]:
        """Ends that a literal fixes."""
        found: set[str] = set()

        def walk(node: tuple | None) -> None:
            if node is None:
                return
            if node[0] == "cmp":
                found.update({node[1]} if node[2] == "name" else ())
            else:
                for x in node[1:]:
                    walk(x)

        walk(self.where)
        return found & {self.subject, self.object}


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"cannot read the condition at {text[at : at + 20]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, re.sub(r"\s+", " ", m[kind]).upper() if kind == "op" else m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def take(self, *wanted: str) -> str:
        kind, value = self.peek()
        if wanted and value.upper() not in wanted and kind not in wanted:
            raise PatternError(f"expected {' or '.join(wanted)}, found {value!r}")
        self.at += 1
        return value

    def expression(self) -> tuple:
        node = self.conjunction()
        while self.peek()[1].upper() == "OR":
            self.take()
            node = ("or", node, self.conjunction())
        return node

    def conjunction(self) -> tuple:
        node = self.factor()
        while self.peek()[1].upper() == "AND":
            self.take()
            node = ("and", node, self.factor())
        return node

    def factor(self) -> tuple:
        kind, value = self.peek()
        if value.upper() == "NOT":
            self.take()
            return ("not", self.factor())
        if value == "(":
            self.take()
            node = self.expression()
            self.take(")")
            return node
        left = self.operand()
        op = self.take("op")
        right = self.operand()
        if isinstance(left, (str, list)) and isinstance(right, tuple):
            left, right = right, left
        if not isinstance(left, tuple) or isinstance(right, tuple):
            raise PatternError("a property must be compared with a literal")
        return ("cmp", *left, op, right)

    def operand(self) -> tuple | str | list:
        kind, value = self.peek()
        if kind == "lit":
            self.take()
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if value == "[":
            self.take()
            items = []
            while self.peek()[1] != "]":
                items.append(self.operand())
                if self.peek()[1] == ",":
                    self.take()
            self.take("]")
            return items
        if value.lower() in ("tolower", "toupper"):
            self.take()
            self.take("(")
            inner = self.operand()
            self.take(")")
            return inner
        if "." in value:
            self.take()
            alias, _, name = value.partition(".")
            return alias, name.lower()
        raise PatternError(f"unexpected {value!r}")


def parse(query: str) -> Pattern:
    ok, why = guard(query)
    if not ok:
        raise PatternError(why)
    m = _HEAD.match(query)
    if not m:
        raise PatternError("not a pattern of two entities and one relation")
    n1, n2 = m["n1"] or "_a", m["n2"] or "_b"
    subject, object_ = (n2, n1) if m["l"] and not m["g"] else (n1, n2)
    hops = None
    if m["var"]:
        hops = (int(m["n"]),) * 2 if m["n"] else (int(m["lo"] or 1), int(m["hi"] or 2))
    where = None
    if m["where"] and m["where"].strip():
        parser = _Parser(m["where"])
        where = parser.expression()
        if parser.at < len(parser.tokens):
            raise PatternError(f"unexpected {parser.peek()[1]!r}")
    limit = re.search(r"(?i)\bLIMIT\s+(\d+)", m["ret"])
    return Pattern(subject, object_, m["r"] or "_r", hops, where, int(limit[1]) if limit else 10 if hops else 50)


def _condition(node: tuple, columns: dict[str, Column]) -> Column:
    if node[0] == "and":
        return _condition(node[1], columns) & _condition(node[2], columns)
    if node[0] == "or":
        return _condition(node[1], columns) | _condition(node[2], columns)
    if node[0] == "not":
        return ~_condition(node[1], columns)
    _, alias, name, op, value = node
    if f"{alias}.{name}" not in columns:
        raise PatternError(f"unknown {alias}.{name}")
    column = columns[f"{alias}.{name}"]
    if name == "relation":
        return column.isin(value) if op == "IN" else column != value if op == "<>" else column == value
    if op == "IN":
        return F.lower(column).isin([v.lower() for v in value])
    if op == "<>":
        return F.lower(column) != value.lower()
    return graph.name_condition(column, op.lower(), value)


def _single(node: tuple | None, alias: str) -> tuple[str, str] | None:
    """The condition on one end that holds for every result, where the expression is a plain conjunction."""
    if node is None:
        return None
    if node[0] == "and":
        return _single(node[1], alias) or _single(node[2], alias)
    return (node[3].lower(), node[4]) if node[0] == "cmp" and node[1] == alias and node[2] == "name" and node[3] in ("=", "CONTAINS", "STARTS WITH", "ENDS WITH") else None


def run(query: str, edges: DataFrame, every: bool = False) -> DataFrame:
    """Records of a query over (subject, relation, object, count): (subject, predicate, object, count), or for a path
    (entities, relations, hops). Filters reach the scan of the edges; results come in a fixed order, up to the LIMIT of the query, or 50
    (paths 10) where it has none; ``every`` lifts that default and gives all, unordered."""
    p = parse(query)
    all_rows = every and not re.search(r"(?i)\bLIMIT\s+\d", query)
    if p.hops is None:
        columns = {f"{p.subject}.name": F.col("subject"), f"{p.object}.name": F.col("object"), f"{p.relation}.relation": F.col("relation")}
        kept = edges.where(_condition(p.where, columns)) if p.where else edges
        found = kept.select("subject", F.col("relation").alias("predicate"), "object", "count")
        return found if all_rows else found.orderBy("subject", "predicate", "object").limit(p.limit)
    start = _single(p.where, p.subject)
    if start is None:
        raise PatternError("a path needs a condition on its first entity")
    return graph.paths(edges, start, p.hops, _single(p.where, p.object), None if all_rows else p.limit)


def answers(query: str, records: DataFrame) -> DataFrame:
    """Distinct answers: the free end where one end is fixed; both ends, and the relations where both are fixed; all
    entities of a path."""
    p = parse(query)
    if p.hops is not None:
        return records.select(F.explode("entities").alias("answer")).distinct().orderBy("answer")
    fixed = p.anchors
    if len(fixed) >= 2:
        parts = F.array("subject", "object", "predicate")
    elif fixed:
        parts = F.array("object" if p.subject in fixed else "subject")
    else:
        parts = F.array("subject", "object")
    return records.select(F.explode(parts).alias("answer")).where("answer <> ''").distinct().orderBy("answer")


def as_text(records: DataFrame) -> DataFrame:
    """Records as ``subject=..., predicate=..., object=...``."""
    return records.select(F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in records.columns if c in ("subject", "predicate", "object"))).alias("text"))
