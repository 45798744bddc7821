"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so a word becomes a reduced word over a small alphabet. Words one edit
apart have reduced words at most one edit apart; the full one-edit neighbourhood of a reduced word is small
enough to be written out. The neighbourhoods are joined with the reduced vocabulary, and each pair that meets
is verified on the original strings.

Reduced words travel as 64-bit hashes that an edit changes by arithmetic, so a neighbourhood is made
without building strings; a collision only adds a pair to verify. Most of a neighbourhood is in no vocabulary:
a table of bits (of fixed size) that marks the hashes which occur drops it before the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.llm import texts
from parcelmill.llm.common import field, written

SYMBOLS = 8
#: The table of bits that marks reduced words: 2^27 bits, 16 MB.
MARK_BITS = 27
#: Hashes made at once: 2^20 of 8 bytes, times a few temporaries.
MADE_AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def runs(docs: DataFrame, letters: str, least: int, *, key: str = "doc_id", text: str = "text", piece: int = 1 << 20) -> DataFrame:
    """(key, run): the maximal runs of at least ``least`` ``letters`` (the inside of a character class), A-Z as a-z.

    One row for each place. Missing texts have none. Texts of more than ``piece`` characters are cut between
    runs first, so that no row holds all runs of a very long text.
    """
    whole = F.coalesce(field(text), F.lit(""))
    cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{piece}}}[{letters}]*"), F.lit(0))
    pieces = docs.select(field(key).alias("key"), F.explode(F.when(F.length(whole) > piece, cut).otherwise(F.array(whole))).alias("text"))
    found = pieces.select("key", F.explode(F.regexp_extract_all("text", F.lit(f"[{letters}]{{{least},}}"), F.lit(0))).alias("run"))
    return found.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def misspelt(key: Column, run: Column, one_in: int) -> Column:
    """The run, in one of ``one_in`` places (by crc32 of key and run) without one of its code points; a missing key counts as empty."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def _symbols(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: (their places, symbol values as words x places)."""
    raw = pc.cast(words, pa.large_string())
    points = np.frombuffer("".join(raw.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    lengths = pc.utf8_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    values = points.astype(np.uint64) % np.uint64(symbols) + np.uint64(1)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(MADE_AT_ONCE // (symbols * max(length, 1)), 1)
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            yield some, values[starts[some][:, None] + np.arange(length)]


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _BASE)
    out[:1] = 1
    return np.multiply.accumulate(out)


def reduced_hashes(words: pa.Array, symbols: int) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    for rows, values in _symbols(words, symbols):
        out[rows] = (values * _powers(values.shape[1])).sum(axis=1, dtype=np.uint64)
    return out


def neighbourhoods(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes): the reduced words themselves and all that are one edit from them, repeats included."""
    for rows, values in _symbols(words, symbols):
        length = values.shape[1]
        power = _powers(length + 1)
        before = np.zeros((len(rows), length + 1), dtype=np.uint64)
        np.cumsum(values * power[:length], axis=1, out=before[:, 1:])
        whole = before[:, -1:]
        yield rows, whole[:, 0]
        at_once = max(MADE_AT_ONCE // (symbols * len(rows)), 1)
        for first in range(0, length + 1, at_once):
            places = np.arange(first, min(first + at_once, length + 1))
            left, inside = before[:, places], places[places < length]
            shorter = before[:, inside] + (whole - before[:, inside + 1]) * _INVERSE
            yield np.repeat(rows, len(inside)), shorter.ravel()
            pushed = left + (whole - left) * _BASE
            for symbol in range(1, symbols + 1):
                added = np.uint64(symbol) * power[places]
                yield np.repeat(rows, len(places)), (pushed + added).ravel()
                kept = whole - values[:, inside] * power[inside] + added[: len(inside)]
                yield np.repeat(rows, len(inside)), kept.ravel()


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (texts.mix(hashes * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def vocabulary(counts: DataFrame, *, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, reduced), written: ``counts`` (word, n) with the hash of each reduced word."""

    def run(batches):
        for batch in batches:
            hashes = reduced_hashes(batch.column(0), symbols)
            yield pa.record_batch([*batch.columns, pa.array(hashes.view(np.int64))], names=["word", "n", "reduced"])

    return written(counts.select("word", "n").mapInArrow(run, "word string, n long, reduced long"), "vocabulary")


def _marks(words: DataFrame, bits: int) -> np.ndarray:
    """The table of bits: which slots the reduced words of the vocabulary take."""

    def run(batches):
        for batch in batches:
            slots = np.unique(_slot(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.record_batch([pa.array(slots + 1)], names=["slot"])  # Spark's bitmaps count from 1

    slots = words.select("reduced").mapInArrow(run, "slot long")
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    table = np.zeros(max((1 << bits) // 8, 4096), dtype=np.uint8)
    for row in parts:
        table[(row["part"] - 1) * 4096 : row["part"] * 4096] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return table


def near_words(words: DataFrame, *, symbols: int = SYMBOLS, bits: int = MARK_BITS) -> DataFrame:
    """(word, n, near, near_n): all pairs of words of a ``vocabulary`` that one inserted, deleted or replaced code point sets apart.

    Each pair comes both ways, once.
    """
    shared = words.sparkSession.sparkContext.broadcast(_marks(words, bits))

    def run(batches):
        marks = shared.value
        for batch in batches:
            places, hashes = [], []
            for rows, made in neighbourhoods(batch.column(0), symbols):
                slots = _slot(made, bits)
                there = np.flatnonzero(marks[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
                places.append(rows[there])
                hashes.append(made[there])
            if not places:
                continue
            places, hashes = np.concatenate(places), np.concatenate(hashes)
            order = np.lexsort((hashes, places))
            places, hashes = places[order], hashes[order]
            new = np.ones(len(places), dtype=bool)
            new[1:] = (places[1:] != places[:-1]) | (hashes[1:] != hashes[:-1])
            at = pa.array(places[new])
            yield pa.record_batch(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[new].view(np.int64))], names=["word", "n", "reduced"]
            )

    made = words.select("word", "n").mapInArrow(run, "word string, n long, reduced long")
    others = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "reduced")
    return made.join(others, "reduced").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): where following forms ends. Links must not form rings; each word has one."""
    current = written(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while current.where("moved").limit(1).count():
        on = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        current = written(
            current.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
    return current.select("word", "root")


def spelling_variants(counts: DataFrame, *, least: int = 2, ratio: int = 10, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``counts`` (word, n) that occurs ``least`` times.

    Rows of one word are added up; rows without a word are left out, a missing n counts as 0. ``n_near`` counts the words one
    edit away. ``form`` is the most frequent of them (ties: first in code-point order) if it occurs at least ``ratio``
    times as often as the word; ``root`` is where the forms lead. ``ratio`` must exceed 1, so that they lead somewhere.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1")
    summed = counts.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    words = vocabulary(summed.where(F.col("n") >= least), symbols=symbols)
    of_word = near_words(words, symbols=symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("below"), F.col("near").alias("form"))).alias("top")
    )
    form_n = -F.col("top.below")
    well = F.col("top").isNotNull() & (form_n.cast("decimal(38,0)") >= F.col("n").cast("decimal(20,0)") * ratio)
    found = written(
        words.select("word", "n").join(of_word, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(well, F.col("top.form")).alias("form"), F.when(well, form_n).alias("form_n")
        ),
        "forms",
    )
    roots = followed(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
