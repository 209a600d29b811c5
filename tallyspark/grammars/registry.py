"""Grammars of further issuers, registered by users as table functions.

A grammar is a Python UDTF over the lines of one document: it gets a document's
lines in order and yields movements and warnings.  ``register_grammar`` makes it a
function of the session, so SQL can call it too,

    SELECT * FROM my_bank(TABLE(lines) PARTITION BY doc_id ORDER BY line_no)

and ``read_registered`` gives its class the documents of its issuer, in batches of
lines that are sorted by document.  A task holds a batch and what the grammar keeps
of one document; it takes the partitions of the lines as they are.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, StringType, StructField, StructType

#: What a grammar yields for a line; ``warning`` alone makes a warning and no movement.
FIELDS = StructType([
    StructField("line_no", IntegerType()), StructField("date_raw", StringType()), StructField("date_op", DateType()), StructField("date_post", DateType()), StructField("description", StringType()),
    StructField("detail", StringType()), StructField("amount_minor", LongType()), StructField("balance_minor", LongType()), StructField("doubtful", BooleanType()), StructField("warning", StringType()),
])
#: The columns of all grammars' movements.
COLUMNS = ("doc_id", *FIELDS.names[:-1])
#: Registered classes by the names of their functions.
_CLASSES: dict[str, type[LineGrammar]] = {}


@dataclass
class Movement:
    """One line's movement, or its warning; dates and amounts that can't be read stay null."""

    line_no: int
    date_raw: str | None = None
    date_op: dt.date | None = None
    date_post: dt.date | None = None
    description: str | None = None
    detail: str | None = None
    amount_minor: int | None = None
    balance_minor: int | None = None
    doubtful: bool = False
    warning: str | None = None


class LineGrammar:
    """Base of registered grammars: override ``line``, and ``end`` for what only the whole document tells.

    The input is polymorphic: any table with ``doc_id``, ``line_no`` and ``line``; further
    columns come along in ``row``, and ``doc_id`` keeps its type.
    """

    def __init__(self) -> None:
        self.doc, self.state = None, {}  # of the present document

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("a grammar reads a table: TABLE(lines) PARTITION BY doc_id ORDER BY line_no")
        names = {f.name: f for f in lines.dataType.fields}
        if missing := {"doc_id", "line_no", "line"} - set(names):
            raise ValueError(f"the lines lack {', '.join(sorted(missing))}")
        return AnalyzeResult(StructType([names["doc_id"], *FIELDS.fields]))

    def eval(self, row: Row) -> Iterator[tuple]:
        self.doc = row["doc_id"]
        for m in self.line(row) or ():
            yield (self.doc, *vars(m).values())

    def terminate(self) -> Iterator[tuple]:
        for m in self.end() or ():
            yield (self.doc, *vars(m).values())

    def line(self, row: Row) -> Iterator[Movement] | None:
        raise NotImplementedError

    def end(self) -> Iterator[Movement] | None:
        return None


def register_grammar(spark: SparkSession, issuer: str, grammar: type[LineGrammar]) -> str:
    """Registers a grammar for an issuer under a name that SQL may call, ``grammar_<issuer>``, and returns that name."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", issuer):
        raise ValueError(f"{issuer!r} is no name of an issuer")
    name = f"grammar_{issuer}"
    _CLASSES[name] = grammar
    spark.udtf.register(name, F.udtf(grammar))
    return name


def _reader(grammar: type[LineGrammar], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the table function does, for sorted lines with their number ``_at`` in the document."""
    arrow = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for lines in batches:
            names = [n for n in lines.schema.names if n != "_at"]
            row, out = Row(*names), []
            for at, *values in zip(lines["_at"].to_pylist(), *[lines[n].to_pylist() for n in names]):
                if at == 1:
                    out.extend(one.terminate() if one else ())
                    one = grammar()
                out.extend(one.eval(row(*values)))
            yield batch(out)
        if one:
            yield batch(list(one.terminate()))

    return read


def read_registered(lines: DataFrame, docs: DataFrame, grammars: dict[str, str]) -> DataFrame:
    """``doc_id`` and what the registered grammars yield, for the documents of the issuers in ``grammars``, issuer to function; each line is read once."""
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    schema = StructType([lines.schema["doc_id"], *FIELDS.fields])
    told = []
    for issuer, name in sorted(grammars.items()):
        own = lines.join(docs.where(F.col("bank") == issuer).select("doc_id"), "doc_id", "left_semi")
        told.append(own.withColumn("_at", numbered).mapInArrow(_reader(_CLASSES[name], schema), schema))
    return reduce(DataFrame.unionByName, told)


#: Whether what a grammar yields is a movement; a warning may come along.
MOVES = "amount_minor IS NOT NULL OR date_raw IS NOT NULL OR warning IS NULL"


def parse_registered(lines: DataFrame, docs: DataFrame, grammars: dict[str, str]) -> tuple[DataFrame, DataFrame] | None:
    """Movements, with the columns of all grammars, and ``(doc_id, line_no, warning)`` of the issuers in ``grammars``, issuer to function."""
    if not grammars:
        return None
    out = read_registered(lines, docs, grammars)
    return out.where(MOVES).select(*COLUMNS), out.where("warning IS NOT NULL").select("doc_id", "line_no", "warning")
