"""Languages of whole texts, and the spans of each in mixed ones.

A word is a run of letters of one script. The script narrows the languages that
may be meant: those that were seen to use it. Each word gets a log score for
every language from hashed character n-grams (word ends included), and the best
sequence of languages under a penalty for each switch (Viterbi) labels spans.

Most texts have one language. That is settled without the word-by-word pass:
if no run of words gains as much for another language as a switch costs, nor a
beginning and an end together, staying with one language is the best path. The
other texts get the full pass.

The n-gram counts come from a hash-drawn sample of about ``train_rows``
documents a language; the model's size is fixed by ``bits`` and the number of
languages.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.llm import texts
from parcelmill.llm.common import crc_fold, field, widened

BITS = 17
TRAIN_ROWS = 1_000
SWITCH = 14.0
WORD_LIMIT = 12.0
#: Share of the letters from which the language at both ends is that of the text.
LEAST_OUTER = 0.05
#: A word is known to a language that was seen with its script and with so many of its n-grams.
WORD_SEEN = 0.8
SEED = 42

# Where the blocks of letters of the larger scripts begin, and their names.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x2FA1F, "Han"), (0x30000, 0x323AF, "Han"),
]
SCRIPTS = ["Other", *sorted({name for *_, name in SCRIPT_RANGES})]
#: No code point from here on is a letter, nor is the one before.
_PLANES = 0x32400
#: Bytes of training text counted at once; the n-grams of a slice take some 50 times as much memory.
COUNT_BYTES = 256 << 10


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its script + 1 if it is a letter, else 0; its lower case."""
    script = np.ones(_PLANES, dtype=np.uint8)
    for low, high, name in SCRIPT_RANGES:
        script[low : high + 1] = SCRIPTS.index(name) + 1
    lower = np.arange(_PLANES, dtype=np.uint32)
    for k in range(_PLANES):
        c = chr(k)
        if not c.isalpha():
            script[k] = 0
        elif len(c.lower()) == 1:
            lower[k] = ord(c.lower())
    return script, lower


@dataclass
class Words:
    """The words of a slice of texts."""

    points: np.ndarray  # code points, lower-cased
    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    first: np.ndarray  # index of the first word of each text, one more at the end
    chars: np.ndarray  # where each text begins among the code points


def find_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    script_of, lower = _tables()
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = heads[offsets]
    known = np.minimum(points, _PLANES - 1)
    scripts = script_of[known]
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[chars] = True
    edge[1:-1] |= scripts[1:] != scripts[:-1]
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    real = scripts[starts] > 0 if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[real], ends[real]
    return Words(lower[known], starts, ends, scripts[starts].astype(np.int64) - 1, np.searchsorted(starts, chars), chars)


def _ngrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int):
    """For n from 1 to 4: slots of all n-grams of the words with a mark at both ends, and the word of each."""
    sizes = ends - starts + 2
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    flat = np.zeros(total, dtype=np.uint64)  # 0 is the mark
    inner = np.arange(total) - np.repeat(begin, sizes)
    real = (inner > 0) & (inner < np.repeat(sizes, sizes) - 1)
    flat[real] = points[(np.repeat(starts, sizes) + inner - 1)[real]]
    left = np.repeat(sizes, sizes) - inner  # characters from here to the end of the word
    mask = np.uint64((1 << bits) - 1)
    owner = np.repeat(np.arange(len(starts)), sizes)
    for n in (1, 2, 3, 4):
        if total < n:
            break
        grams = texts.shingle_hashes(flat, n)
        inside = left[: len(grams)] >= n
        yield (texts.mix(grams + np.uint64(n)) & mask).astype(np.int64)[inside], owner[: len(grams)][inside]


def _different(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different word, and which of these each word is."""
    points = np.ascontiguousarray(words.points).view(np.uint8)
    _, at, back = np.unique(texts.span_hashes(points, words.starts * 4, words.ends * 4), return_index=True, return_inverse=True)
    return at, back


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # slots x languages, 0 where nothing was learned
    seen: np.ndarray  # slots x languages
    candidates: np.ndarray  # scripts x languages
    prior: int
    bits: int


def _counts(texts_: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    grams, scripts = np.zeros(1 << bits), np.zeros(len(SCRIPTS))
    column = pa.array(texts_, pa.large_string())
    for _, _, raw, offsets in texts.text_slices(column, COUNT_BYTES):
        words = find_words(raw, offsets)
        if len(words.starts):
            at, back = _different(words)
            times = np.bincount(back)
            for slots, owner in _ngrams(words.points, words.starts[at], words.ends[at], bits):
                grams += np.bincount(slots, times[owner], minlength=1 << bits)
            scripts += np.bincount(words.scripts, words.ends - words.starts, minlength=len(SCRIPTS))
    return grams, scripts


def build(languages: list[str], grams: np.ndarray, scripts: np.ndarray, rows: list[int], bits: int) -> LanguageModel:
    """The model from counts per language (rows) and slot or script (columns)."""
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros((1 << bits, 0), dtype=bool), np.zeros((len(SCRIPTS), 0), dtype=bool), 0, bits)
    smooth = 0.5
    share = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * grams.shape[1]))
    share -= share.mean(axis=0)
    share[:, grams.sum(axis=0) == 0] = 0
    use = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, share.T.copy(), (grams > 0).T.copy(), (use >= 0.005).T.copy(), int(np.argmax(rows)), bits)


def fit(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 4,
    held_out: int = 2,
    train_rows: int = TRAIN_ROWS,
    bits: int = BITS,
) -> LanguageModel:
    """Learn from documents with a language whose crc32(id) mod ``folds`` is not ``held_out``.

    About ``train_rows`` documents of each language are drawn by a hash of id and text.
    """
    rows = docs.select(
        field(key).alias("key"), field(text).alias("text"), field(lang).cast("string").alias("lang")
    ).where("lang is not null and text is not null").where(crc_fold(F.col("key"), folds) != held_out)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "key", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(sizes), "lang").where(draw < F.lit(float(train_rows)) / F.col("rows"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        grams, scripts = _counts(group["text"].tolist(), bits)
        used = np.flatnonzero(grams)
        return pd.DataFrame(
            {"lang": [group["lang"].iloc[0]], "rows": [int(group["rows"].iloc[0])], "slots": [used], "times": [grams[used]], "scripts": [scripts]}
        )

    found = chosen.select("lang", "rows", "text").groupBy("lang").applyInPandas(
        count, "lang string, rows long, slots array<long>, times array<double>, scripts array<double>"
    ).collect()
    found.sort(key=lambda r: r["lang"])
    grams = np.zeros((len(found), 1 << bits))
    for k, r in enumerate(found):
        grams[k, np.array(r["slots"], dtype=np.int64)] = r["times"]
    scripts = np.array([r["scripts"] for r in found]).reshape(len(found), len(SCRIPTS))
    return build([r["lang"] for r in found], grams, scripts, [r["rows"] for r in found], bits)


def word_scores(words: Words, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and whether the word is known, as words x languages; equal words of the slice are scored once."""
    at, back = _different(words)
    slots, owner = (np.concatenate(x) for x in zip(*_ngrams(words.points, words.starts[at], words.ends[at], model.bits), strict=True))
    out = np.empty((len(at), len(model.languages)))
    known = np.empty(out.shape, dtype=bool)
    least = WORD_SEEN * np.bincount(owner, minlength=len(at))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(owner, model.scores[slots, k], minlength=len(at))
        known[:, k] = np.bincount(owner, model.seen[slots, k], minlength=len(at)) >= least
    out = np.clip(out / 2, -WORD_LIMIT, WORD_LIMIT)
    allowed = model.candidates[words.scripts[at]]
    out[~allowed & allowed.any(axis=1, keepdims=True)] = -WORD_LIMIT
    out[~allowed.any(axis=1)] = 0
    return out[back], (known & allowed)[back]


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path; ties go to staying, then to the first language."""
    whole = scores.sum(axis=0)
    stay = int(np.argmax(whole))
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, [stay]], axis=0, out=gain[1:])
    # A detour through other languages costs a switch for each of its parts and gains less.
    # A path without the language at all saves one switch; beyond its first and last part it gains less too.
    detour = (gain - np.minimum.accumulate(gain, axis=0)).max()
    if detour < switch and gain[1:].max() + (gain[-1] - gain[:-1]).max() <= switch:
        return np.full(len(scores), stay)
    rows = scores.tolist()
    languages = range(scores.shape[1])
    value, steps = rows[0], []
    for row in rows[1:]:
        best = max(value)
        top = value.index(best)
        jump = best - switch
        steps.append((top, [v < jump for v in value]))
        value = [(v if v >= jump else jump) + s for v, s in zip(value, row, strict=True)]
    path = [max(languages, key=lambda k: (value[k], -k))]
    for top, jumped in reversed(steps):
        path.append(top if jumped[path[-1]] else path[-1])
    return np.array(path[::-1])


_SPANS = T.ArrayType(T.StructType().add("lang", "string").add("first", "integer").add("end", "integer").add("letters", "integer").add("known", "integer"))


def identify(
    docs: DataFrame, model: LanguageModel, *, text: str = "text", switch: float = SWITCH, into: str = "lang"
) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, lang_score and lang_spans.

    ``lang_spans`` covers the text from its first to its last letter by ranges
    of characters [first, end), with the number of letters and how many of them are in words known to the
    language (``WORD_SEEN``). ``lang_pred`` is the language that both opens and
    closes the text with at least a twentieth of its letters, else the one with the most; ``lang_score`` is the
    share of its known words in all letters, near 0 for a text in none of the learned languages. Texts that are missing or
    without letters are ``und`` with score 0 and no spans; so is every text if
    nothing was learned. Words in a script of no learned language decide
    nothing. ``into`` begins the names of the new columns; they must not exist.
    """
    result = T.StructType().add(f"{into}_pred", "string").add(f"{into}_score", "double").add(f"{into}_spans", _SPANS)
    clash = {name.lower() for name in result.names} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("letters", pa.int32()), ("known", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, shares, spans = [], [], []
            for first, end, raw, offsets in texts.text_slices(batch.column(at), 1 << 20):
                words = find_words(raw, offsets)
                scores, known = word_scores(words, model) if model.languages and len(words.starts) else (None, None)
                for k in range(end - first):
                    low, high = int(words.first[k]), int(words.first[k + 1])
                    if low == high or scores is None:
                        names.append("und")
                        shares.append(0.0)
                        spans.append([])
                        continue
                    of_text = scores[low:high]
                    path = best_path(of_text, switch) if of_text.any() else np.full(high - low, model.prior)
                    sizes = words.ends[low:high] - words.starts[low:high]
                    known_sizes = sizes * known[low:high][np.arange(high - low), path]
                    letters = np.bincount(path, sizes, minlength=len(model.languages))
                    # What opens and closes a text holds passages of other languages as insertions.
                    outer = int(path[0])
                    holds = outer == path[-1] and letters[outer] >= LEAST_OUTER * letters.sum()
                    top = outer if holds else int(np.argmax(letters))
                    names.append(model.languages[top])
                    shares.append(float(known_sizes[path == top].sum() / letters.sum()))
                    turns = np.flatnonzero(np.diff(path)) + 1
                    cuts = [0, *turns.tolist(), len(path)]
                    of_span, known_of_span = (np.add.reduceat(x, cuts[:-1]).tolist() for x in (sizes, known_sizes))
                    base = int(words.chars[k])
                    spans.append(
                        [
                            {
                                "lang": model.languages[path[a]], "first": int(words.starts[low + a]) - base,
                                "end": int(words.ends[low + b - 1]) - base, "letters": n, "known": m,
                            }
                            for a, b, n, m in zip(cuts, cuts[1:], of_span, known_of_span, strict=False)
                        ]
                    )
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span_type)]
            yield pa.record_batch(columns, names=[f"c{k}" for k in range(len(columns))])

    return widened(docs, run, result)
