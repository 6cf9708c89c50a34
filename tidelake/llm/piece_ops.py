"""SentencePiece encoding and decoding of whole tables."""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import map_texts
from tidelake.llm.piece_codec import codec


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): begin id, the text's ids, end id. Null and empty texts give just begin and end."""

    def rows():
        c = codec(path)

        def of(ids, texts):
            coded = c.encode_all([t.decode("utf-8", "replace") for t in texts])
            return {"id": ids, "ids": [[c.begin, *array("I", x), c.end] for x in coded]}

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, rows, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The frame with ``text_col`` decoded from the ids; null ids give a null text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode(list(x)))

    return frame.withColumn(text_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, decoded text) of every whole text, encoded and decoded."""

    def rows():
        c = codec(path)
        begin, end = c.begin.to_bytes(4, "little"), c.end.to_bytes(4, "little")

        def of(ids, texts):
            coded = [begin + x + end for x in c.encode_all([t.decode("utf-8", "replace") for t in texts])]
            back = [c.decode(array("I", x).tolist()).encode() for x in coded]
            return {
                "id": ids,
                "n_tokens": [len(x) // 4 for x in coded],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                "decoded": [x.decode() for x in back],
            }

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string"
    return map_texts(docs, id_col, text_col, rows, schema).withColumnRenamed("id", id_col)
