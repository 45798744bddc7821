"""License phrases in documents: exact places, and short notices with a few errors.

A text is reduced to its lower-cased words with single blanks between them. A
notice of n characters may have k = n // 14 edits. Cut into k + 1 pieces, at least one
piece must occur unchanged (pigeonhole), so pieces are found first by exact
search; only around such a seed the ``regex`` library matches the whole notice
with at most k errors, which gives the place and the number of edits.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelmill.llm import texts
from parcelmill.llm.common import field

# Phrases that count exactly, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Short notices that are searched with errors, as words.
NOTICES = [
    ("apache license", "apache"),
    ("general public license", "gpl"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("distributed under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under cc by", "cc"),
    ("all rights reserved", "reserved"),
]
CHARS_PER_EDIT = 14


def edits(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def seeds(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than it may have edits, with their offsets."""
    pieces = edits(notice) + 1
    cuts = [len(notice) * k // pieces for k in range(pieces + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.cache
def _pattern(notice: str) -> regex.Pattern:
    return regex.compile(r"(?<![^ ])(?:" + regex.escape(notice, literal_spaces=True) + "){e<=" + str(edits(notice)) + r"}(?![^ ])", regex.BESTMATCH)


def _places(data: bytes, piece: bytes) -> Iterator[int]:
    at = data.find(piece)
    while at >= 0:
        yield at
        at = data.find(piece, at + 1)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with a blank after each, or a line feed after the last one of a text; and where each begins."""
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
    inner = np.arange(len(flat)) - np.repeat(begin, sizes)
    in_word = inner < np.repeat(sizes - 1, sizes)
    flat[in_word] = raw[(np.repeat(starts, sizes) + inner)[in_word]]
    last = first[1:][first[1:] > first[:-1]] - 1
    flat[begin[last] + sizes[last] - 1] = 0x0A
    return flat, begin


def _fuzzy(data: bytes, low: int, high: int, notice: str, at: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice near the seeds ``at`` (where it would begin), inside one text [low, high)."""
    slack = edits(notice)
    found: list[tuple[int, int, int]] = []
    reach = None
    windows: list[list[int]] = []
    for begin in sorted(at):
        a, b = max(begin - slack, low), min(begin + len(notice) + slack, high)
        if reach is not None and a <= reach:
            windows[-1][1] = reach = max(reach, b)
        else:
            windows.append([a, b])
            reach = b
    for a, b in windows:
        # Whole words, and with them whole characters.
        a = max(data.rfind(b" ", low, a) + 1, low) if a > low and data[a - 1] != 0x20 else a
        stop = data.find(b" ", b, high)
        b = high if stop < 0 else stop
        window = data[a:b].decode()
        for m in _matches(notice, window):
            start = a + len(window[: m.start()].encode())
            found.append((start, start + len(m.group().encode()), sum(m.fuzzy_counts)))
    return found


def _matches(notice: str, window: str) -> Iterator[regex.Match]:
    """All matches that don't overlap: the best ones around the seeds first, then those left in the gaps."""
    pattern, slack = _pattern(notice), edits(notice)
    near = {}
    for offset, piece in seeds(notice):
        at = window.find(piece)
        while at >= 0:
            low = window.rfind(" ", 0, max(at - offset - slack, 0) + 1) + 1
            stop = window.find(" ", at - offset + len(notice) + slack) if at - offset + len(notice) + slack < len(window) else -1
            m = pattern.search(window, low, len(window) if stop < 0 else stop)
            if m:
                near[m.span()] = m
            at = window.find(piece, at + 1)
    starts: list[int] = []
    ends: list[int] = []
    for m in sorted(near.values(), key=lambda m: (sum(m.fuzzy_counts), m.start())):
        k = bisect.bisect(starts, m.start())
        if (k == 0 or ends[k - 1] <= m.start()) and (k == len(starts) or starts[k] >= m.end()):
            starts.insert(k, m.start())
            ends.insert(k, m.end())
            yield m
    # Words on both sides stay whole: a match begins and ends at a blank.
    gaps = list(zip([0, *(x + 1 for x in ends)], [*(x - 1 for x in starts), len(window)], strict=True))
    while gaps:
        low, high = gaps.pop()
        m = pattern.search(window, low, high) if low < high else None
        if m:
            yield m
            gaps += [(low, m.start() - 1), (m.end() + 1, high)]


_RESULT = (
    T.StructType()
    .add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
    .add("base_labels", T.ArrayType(T.StringType())).add("labels", T.ArrayType(T.StringType()))
    .add("score", "double")
    .add("spans", T.ArrayType(T.StructType().add("label", "string").add("first", "integer").add("end", "integer").add("edits", "integer")))
)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are the notices found with errors as word ranges [first, end) and
    their edits. ``score`` is 1 with an exact phrase, else 1 less the share of
    edited characters of the best notice, else 0. Missing and empty texts have
    no words and score 0. Repeated rows are scanned each; other columns are not
    read; an empty table gives no rows. Nothing is limited by the length of a text.
    """
    rows = docs.select(field(key).alias("key"), field(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *_RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in texts.text_slices(batch.column("text")):
                found = _scan_slice(raw, offsets)
                columns = [pa.array([row[k] for row in found], _ARROW[k]) for k in range(len(_ARROW))]
                yield pa.record_batch([batch.column("key").slice(start, end - start), *columns], names=schema.fieldNames())

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


_ARROW = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])),
]


def _scan_slice(raw: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    raw = texts.LOWER[raw]
    starts, ends, first = texts.word_bounds(raw, offsets, texts.LETTERS_DIGITS)
    n_words = np.diff(first)
    out = [(int(n), 0, None, None, [], [], 0.0, []) for n in n_words]
    if not len(starts):
        return out
    flat, begin = _joined(raw, starts, ends, first)
    data = flat.tobytes()

    def text_of(place: int) -> int:
        return int(np.searchsorted(first, np.searchsorted(begin, place, side="right") - 1, side="right")) - 1

    def bounds(k: int) -> tuple[int, int]:
        low = int(begin[first[k]])
        return low, (int(begin[first[k + 1]]) if first[k + 1] < len(begin) else len(data)) - 1

    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in PHRASES:
        piece = phrase.encode()
        for at in _places(data, piece):
            if (at == 0 or data[at - 1] in b" \n") and data[at + len(piece)] in b" \n":
                k = text_of(at)
                base.setdefault(k, []).append((int(np.searchsorted(begin, at)) - int(first[k]), label))
    near: dict[int, dict[int, list[int]]] = {}
    for nth, (notice, _) in enumerate(NOTICES):
        for offset, piece in seeds(notice):
            for at in _places(data, piece.encode()):
                near.setdefault(text_of(at), {}).setdefault(nth, []).append(at - offset)
    for k in base.keys() | near.keys():
        exact = base.get(k, [])
        spans, best = [], 1.0 if exact else 0.0
        low, high = bounds(k)
        for nth, at in near.get(k, {}).items():
            notice, label = NOTICES[nth]
            for a, b, n in _fuzzy(data, low, high, notice, at):
                word = int(np.searchsorted(begin, a, side="right")) - 1 - int(first[k])
                stop = int(np.searchsorted(begin, b)) - int(first[k])
                spans.append({"label": label, "first": word, "end": stop, "edits": n})
                best = max(best, 1 - n / len(notice))
        places = [p for p, _ in exact]
        labels = sorted({x for _, x in exact})
        out[k] = (
            int(n_words[k]), len(places), min(places, default=None), max(places, default=None), labels,
            sorted({*labels, *(s["label"] for s in spans)}), best, sorted(spans, key=lambda s: (s["first"], s["end"], s["label"])),
        )
    return out
