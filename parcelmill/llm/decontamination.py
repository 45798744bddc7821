"""Benchmark passages inside documents, by a prefix-filtered containment join.

An item gives windows of ``width`` consecutive words (one shorter window if it
has fewer). Containment asks that a stretch of a document equals a window. Every
window is a sequence of shingles; as all of them must be present, one is enough
to find it, and the rarest one makes the fewest candidates. So:

1. count in the documents the shingles that occur in items;
2. keep for each window only its rarest shingle and where in the window it stands;
3. look these up in the documents. A hit at word p for a shingle at offset o of
   the window fixes the only possible start p - o; it must lie inside the text
   (positional bound) with enough words after it (length bound);
4. compare the words themselves there.

Items are a query set: they are indexed in blocks of bounded size, each of which
is sent to the tasks, so documents are never shuffled. More items mean more
blocks, not a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.llm import texts
from parcelmill.llm.common import field, written

#: UTF-8 bytes of item texts in one block.
BLOCK_BYTES = 8 << 20


def _words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode().translate(texts.LOWER_TABLE), dtype=np.uint8)
    starts, ends, _ = texts.word_bounds(raw, np.array([0, len(raw)]), texts.LETTERS_DIGITS)
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class ItemIndex:
    """The windows of one block of items."""

    def __init__(self, items: list[tuple[str, str]], width: int, shingle: int):
        self.shingle = shingle
        self.windows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = _words(text)
            if words:
                size = min(width, len(words))
                for k in range(len(words) - size + 1):
                    self.windows.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.hashes = {window: self._hashes(window) for window in self.windows}

    def _hashes(self, window: tuple[bytes, ...]) -> np.ndarray:
        raw = b" ".join(window)
        ends = np.cumsum([len(w) + 1 for w in window]) - 1
        starts = ends - [len(w) for w in window]
        words = texts.span_hashes(np.frombuffer(raw, dtype=np.uint8), starts, ends)
        return texts.shingle_hashes(words, min(self.shingle, len(window)))

    def shingles(self) -> np.ndarray:
        """All shingles that occur in windows, sorted."""
        if not self.hashes:
            return np.zeros(0, dtype=np.uint64)
        return np.unique(np.concatenate(list(self.hashes.values())))

    def prefixes(self, count: dict[int, int]) -> dict[int, dict[int, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]]:
        """Shingle width -> rarest shingle -> (offset in the window, window, items)."""
        found: dict[int, dict[int, list]] = {}
        for window, hashes in self.hashes.items():
            rarity = [(count.get(int(h), 0), int(h), k) for k, h in enumerate(hashes)]
            times, rarest, offset = min(rarity)
            if times:  # else a shingle of this window is in no document
                per_width = found.setdefault(min(self.shingle, len(window)), {})
                per_width.setdefault(rarest, []).append((offset, window, tuple(sorted(self.windows[window]))))
        return found


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    shingle: int = 4,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: key, n_words, hits (merged word ranges [first, end)), n_hit, items.

    ``items`` lists the ids, as text and sorted, of items with a window in the document.

    A missing or empty text has no words and no hits; so does an item without
    words. Items with equal ids count as one; a missing item id is listed as
    empty text. Repeated documents are judged one by one. Without items, nothing
    is hit. Other columns are not read.
    """
    found = _find(docs, text, [key], items, item_key, item_text, width, shingle, block_bytes)
    return found.select(
        F.col("rest.c0").alias(key), "n_words", "hits", _hit_words(), F.array_sort("items").alias("items")
    )


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    shingle: int = 4,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, that are not contaminated; found row by row, so ids don't matter."""
    others = [c for c in docs.columns if c != text]
    found = _find(docs, text, others, items, item_key, item_text, width, shingle, block_bytes)
    place = {c: F.col(f"rest.c{k}").alias(c) for k, c in enumerate(others)}
    return found.where(~contaminated(_hit_words(), F.col("n_words"))).select(
        *[F.col("text").alias(text) if c == text else place[c] for c in docs.columns]
    )


def _hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, hit: n + hit["end"] - hit["first"]).alias("n_hit")


def _find(docs, text, others, items, item_key, item_text, width, shingle, block_bytes) -> DataFrame:
    """(rest: the columns ``others`` as c0, c1, ..; text, n_words, hits, items)."""
    found = docs.select(
        F.struct(F.lit(0).alias("row"), *[field(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("rest"),
        field(text).alias("text"),
        F.array().cast("array<struct<first:int,end:int>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(items, item_key, item_text, block_bytes)
    for nth, block in enumerate(blocks):
        found = _search(found, ItemIndex(block, width, shingle))
        if nth + 1 < len(blocks):
            found = written(found, "decontaminate")
    if not len(blocks):
        found = _search(found, ItemIndex([], width, shingle))
    return found


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """True where at least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


class _Blocks:
    """Blocks of items, fetched one at a time so that the driver holds one of them."""

    def __init__(self, items: DataFrame, count: int):
        self.items, self.count = items, count

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        for k in range(self.count):
            rows = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == k).collect()
            yield sorted((r["item"], r["text"]) for r in rows)


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> _Blocks:
    rows = items.select(
        F.coalesce(field(key).cast("string"), F.lit("")).alias("item"), field(text).alias("text")
    ).where("text is not null and text != ''")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return _Blocks(rows, -(-size // block_bytes))


def _hashed(batch: pa.RecordBatch):
    """(row, words' hashes, bytes, starts, ends) of each text of a batch."""
    for first, end, raw, offsets in texts.text_slices(batch.column("text")):
        raw = texts.LOWER[raw]
        starts, ends, word_of = texts.word_bounds(raw, offsets, texts.LETTERS_DIGITS)
        hashes = texts.span_hashes(raw, starts, ends)
        data = raw.tobytes()
        for row in range(first, end):
            low, high = int(word_of[row - first]), int(word_of[row - first + 1])
            yield row, hashes[low:high], data, starts[low:high], ends[low:high]


def _lookup(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions whose hash is in the sorted array ``wanted``."""
    if not len(wanted) or not len(hashes):
        return np.zeros(0, dtype=np.int64)
    place = np.searchsorted(wanted, hashes)
    place[place == len(wanted)] = 0
    return np.flatnonzero(wanted[place] == hashes)


def _count_shingles(docs: DataFrame, index: ItemIndex) -> dict[int, int]:
    """How often each shingle of the block occurs in the documents: at most one row per shingle of the block."""
    wanted = index.shingles()
    sizes = sorted({min(index.shingle, len(window)) for window in index.windows})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for _, words, *_ in _hashed(batch):
                for size in sizes:
                    hashes = texts.shingle_hashes(words, size)
                    np.add.at(times, np.searchsorted(wanted, hashes[_lookup(wanted, hashes)]), 1)
        seen = np.flatnonzero(times)
        yield pa.record_batch([pa.array(wanted[seen].view(np.int64)), pa.array(times[seen])], names=["shingle", "times"])

    if not len(wanted):
        return {}
    rows = (
        docs.select("text").mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    )
    return {r["shingle"] & ((1 << 64) - 1): r["times"] for r in rows.collect()}


_FOUND = T.StructType().add("n_words", "long").add(
    "hits", T.ArrayType(T.StructType().add("first", "integer").add("end", "integer"))
).add("items", T.ArrayType(T.StringType()))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _search(found: DataFrame, index: ItemIndex) -> DataFrame:
    prefixes = index.prefixes(_count_shingles(found, index))
    lookups = {size: np.array(sorted(by_shingle), dtype=np.uint64) for size, by_shingle in prefixes.items()}
    shared = found.sparkSession.sparkContext.broadcast((prefixes, lookups))
    out = T.StructType([f for f in found.schema.fields if f.name in ("rest", "text")] + _FOUND.fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, lookups = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for row, words, data, starts, ends in _hashed(batch):
                n_words[row] = len(words)
                ranges: list[tuple[int, int]] = []
                names: set[str] = set()
                for size, wanted in lookups.items():
                    hashes = texts.shingle_hashes(words, size)
                    for at in _lookup(wanted, hashes).tolist():
                        for offset, window, of_items in prefixes[size][int(hashes[at])]:
                            first, end = at - offset, at - offset + len(window)
                            if first < 0 or end > len(words):
                                continue
                            if all(data[starts[k] : ends[k]] == w for k, w in enumerate(window, first)):
                                ranges.append((first, end))
                                names.update(of_items)
                if ranges:
                    before = [(h["first"], h["end"]) for h in hits[row]]
                    hits[row] = [{"first": a, "end": b} for a, b in _merged(before + ranges)]
                    items[row] = sorted(names.union(items[row]))
            yield pa.record_batch(
                [batch.column("rest"), batch.column("text"), pa.array(n_words), pa.array(hits, batch.schema.field("hits").type),
                 pa.array(items, batch.schema.field("items").type)],
                names=["rest", "text", "n_words", "hits", "items"],
            )

    return found.select("rest", "text", "hits", "items").mapInArrow(search, out)


def digest(items: Column) -> Column:
    """sha256 of the sorted ids joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)

