"""Schemas of the working tables, applied wherever files are read."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BOX = _struct(x0=_D, y0=_D, x1=_D, y1=_D)
FIGURE = _struct(page=_I, type=_S, bbox=BOX, caption=_S, info=_S)
TABLE = _struct(page=_I, data=T.ArrayType(T.ArrayType(_S)))
HEADER = _struct(level=_S, title=_S, page=_I, line=_I)
FORMULA = _struct(page=_I, content=_S)
PARSED = _struct(source=_S, text=T.ArrayType(_S), tables=T.ArrayType(TABLE), figures=T.ArrayType(FIGURE), formulas=T.ArrayType(FORMULA), formula_counts=T.MapType(_I, _I), headers=T.ArrayType(HEADER))
CHUNK = _struct(text=_S, source=_S, page=_I, chunk_index=_I, content_type=_S, section=_S)
TRIPLE = _struct(subject=_S, relation=_S, object=_S, count=_L, source_page=_I, source_section=_S)
QA = _struct(id=_S, pdf=_S, type=_S, level=_S, question=_S, expect_source=_S, expect_keywords=T.ArrayType(_S), answer_keys=T.ArrayType(_S))
CASE = _struct(id=_S, pdf=_S, claim=_S, passage=_S, supported=T.BooleanType())
DATASET = _struct(qa=T.ArrayType(QA), reflection_cases=T.ArrayType(CASE))
ANSWER = _struct(id=_S, pdf=_S, type=_S, question=_S, answer=_S, contexts=T.ArrayType(_S), answer_keys=T.ArrayType(_S), error=_S)
