"""Token counts of whole texts with a public tokenizer, without keeping the tokens.

Texts are encoded in Arrow functions in batches of about equal bytes. A long
text is cut where no merge can cross: pieces of these vocabularies never hold a
space after another character, so before a space a cut changes nothing. The
space is left out, as the encoder puts one before every text by itself.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.llm import texts
from parcelmill.llm.common import field

PART_CHARS = 20_000
BATCH_BYTES = 1 << 20


@functools.cache
def tokenizer(path: str):
    """The encoder of a .model file, loaded once in each worker; its cuts are proved safe here."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    for k in range(encoder.get_piece_size()):
        if "▁" in encoder.id_to_piece(k).lstrip("▁"):
            raise ValueError(f"{path}: a piece holds a space after another character, so texts can't be cut at spaces")
    if encoder.encode("a") == encoder.encode(" a"):
        raise ValueError(f"{path}: leading spaces are dropped, so texts can't be cut at spaces")
    return encoder


#: A space after another character with text behind it; the encoder takes U+2581 for a space too.
_CUT = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)


def safe_parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """Parts of a text whose token counts add up to that of the text: each ends at the first cut after ``limit`` characters."""
    first = 0
    while len(text) - first > limit:
        cut = _CUT.search(text, first + limit)
        if not cut:
            break
        yield text[first : cut.start()]
        first = cut.end()
    yield text[first:]


def count_tokens(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    No begin, end or other special tokens are added; strings that look like them
    are ordinary text. A missing or empty text has no bytes and no tokens.
    Repeated rows are counted each, other columns are not read, and an empty
    table gives no rows. ``model_path`` must be readable on every executor.
    """
    rows = docs.select(field(key).alias("key"), field(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType)]).add("n_bytes", "long").add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(model_path)
        for batch in batches:
            column = batch.column("text")
            for first, end, raw, offsets in texts.text_slices(column, BATCH_BYTES):
                data, parts, owner = raw.tobytes(), [], []
                for row in range(end - first):
                    for part in safe_parts(data[offsets[row] : offsets[row + 1]].decode()):
                        parts.append(part)
                        owner.append(row)
                tokens = [0] * (end - first)
                for row, ids in zip(owner, encoder.encode(parts, num_threads=1), strict=True):
                    tokens[row] += len(ids)
                yield pa.record_batch(
                    [batch.column("key").slice(first, end - first), pa.array(offsets[1:] - offsets[:-1]), pa.array(tokens, pa.int64())],
                    names=schema.fieldNames(),
                )

    return rows.mapInArrow(count, schema).select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
