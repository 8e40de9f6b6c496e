"""Secret scan: one byte pass of a combined deterministic automaton over every
whole text (``automaton.py``).

Inputs and outputs: ``find_secrets`` takes any table with an id and a text
column and returns (id, spans), one row per input row, in any order. A span is
(kind, start, end, text) with code point offsets, end exclusive; spans are
ordered by start, then by the order of the rules. ``redact`` returns the rows
with each span replaced by a mark.

Cases: a null or empty text has an empty list of spans; a null id stays null;
repeated rows give repeated results; other columns, whatever their names, are
left out of ``find_secrets`` and kept by ``redact``; an empty table gives an
empty result; a text of any length is scanned whole, in its own block. Spans of
different rules may overlap; spans of one rule never do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.automaton import END, Automaton, Rule
from evidentia.llm.words import blocks

# --- fixed values: the rules, in order ---------------------------------------------
_NAME = """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE_RULES = [
    Rule("assign", _NAME + _VALUE + "+", keep=_NAME + _VALUE + "{12,}", either_case=True),
    Rule("access", "AKIA[A-Z0-9]+", keep="AKIA[A-Z0-9]{14,}"),
    # the runs of [0-9a-f]+ that have 16 characters are the matches of {16,}
    Rule("hex", "[0-9a-f]{16,}"),
]
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
RULES = BASE_RULES + MORE_RULES
# -------------------------------------------------------------------------------------

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])


def _scan_block(auto: Automaton, texts: list[bytes]):
    """Spans of each text: lists of (kind, start, end, text) dicts."""
    out: list[list] = [[] for _ in texts]
    data = bytes([END]).join([*texts, b""])
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    found = auto.spans(data)
    which = np.searchsorted(at, [s for s, _, _ in found], side="right") - 1
    points: dict = {}
    for (start, end, rule), row in zip(found, which.tolist()):
        if row not in points:
            lead = (np.frombuffer(texts[row], dtype=np.uint8) & 0xC0) != 0x80
            points[row] = np.concatenate([[0], np.cumsum(lead)])
        a, b = start - int(at[row]), end - int(at[row])
        out[row].append({"kind": auto.kinds[rule], "start": int(points[row][a]), "end": int(points[row][b]),
                         "text": texts[row][a:b].decode()})
    return out


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; see the module for the cases. The rules are
    compiled once, here; tasks get the arrays."""
    auto = Automaton(rules)
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def scan(batches):
        for b in blocks(batches, "_text"):
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scan_block(auto, texts), type=arrow)], [id_col, "spans"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(scan, kind)


def span_key(span):
    """kind:start:end"""
    return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every part covered by a span replaced by ``mark``
    (overlapping spans by one mark). All columns stay; a null text stays null."""
    auto = Automaton(rules)
    place = docs.columns.index(text_col)

    def clean(text: bytes) -> str:
        parts, at = [], 0
        for a, b, _ in auto.spans(text + bytes([END])):
            if a >= at:
                parts += [text[at:a], mark.encode()]
            at = max(at, b)
        return b"".join([*parts, text[at:]]).decode()

    def run(batches):
        for b in batches:
            col = b.column(place)
            new = [None if t is None else clean(t) for t in col.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            arrays = [pa.array(new, type=col.type) if k == place else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
