"""Audit of how the sources of a language differ in their terms.

Each (language, source) group is a sparse row of term counts. A term's share is a smoothed, scaled integer, also
for a term the group doesn't have: its baseline. Two groups differ by the sum, over all terms that the language
keeps, of (p - q)^2 / (p + q), rounded down for each term.

All pairs of groups come from Gustavson's row accumulation. Terms are dealt into slices; a task holds the
term-major index of one slice. For each group it fills a dense accumulator with one cell for each peer: first what its own
terms, the peer's terms and the slice's other terms would give if the two had no term in common (baselines only), then the group's
terms are scattered through the index, and each posting corrects its peer's cell. Pairs of postings are never written
out; a task returns one sum for each pair of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.llm import texts
from parcelmill.llm.common import field, written

#: a-z and everything outside ASCII, after lower-casing.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True
SCALE = 1_000_000_000
MIN_DOCS, TOP_TERMS = 10, 10
#: Postings of a slice of terms, on average, at least; a slice has as many as it returns sums, up to the pairs of groups of a task.
SLICE_POSTINGS, TASK_PAIRS = 1 << 16, 1 << 20
#: Postings scattered at once: their sum stays below 2^53, so adding doubles is exact.
SCATTERED = 1 << 20
TEXT_BYTES = 4 << 20


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow text column."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _blocks(raw: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Parts of one text of about ``limit`` bytes, cut where no term goes on."""
    first = 0
    while first < len(raw):
        end = min(first + limit, len(raw))
        while end < len(raw) and LETTERS[raw[end]]:
            more = LETTERS[raw[end : end + limit]]
            end += len(more) if more.all() else int(np.argmin(more))
        yield raw[first:end]
        first = end


def _counted(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
    """(group, term, n, docs) of a slice of texts with their group numbers; and the hashes of the terms."""
    starts, ends, first = texts.word_bounds(raw, offsets, LETTERS)
    hashes, at, codes = np.unique(texts.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    width = max(len(hashes), 1)
    doc = np.repeat(np.arange(len(groups)), np.diff(first))
    of_doc, n = np.unique(doc * width + codes, return_counts=True)
    of_group, back = np.unique(groups[of_doc // width] * width + of_doc % width, return_inverse=True)
    sums = np.bincount(back, n, minlength=len(of_group)).astype(np.int64)
    docs = np.bincount(back, minlength=len(of_group))
    term = of_group % width
    return of_group // width, _strings(raw, starts[at], ends[at]).take(pa.array(term)), sums, docs, hashes[term]


def term_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", slice_bytes: int = TEXT_BYTES
) -> DataFrame:
    """(lang, source, term, n, docs): how often each term stands in the texts of a group, and in how many of its rows.

    Missing texts, languages and sources are empty text. Terms are runs of letters A-Z (as a-z) and characters outside ASCII.
    Counted in slices of about ``slice_bytes`` bytes; a longer text in blocks, in which a term counts its row once.
    Within a slice, terms are told apart by 64-bit hashes.
    """
    empty = lambda name: F.coalesce(field(name).cast("string"), F.lit(""))
    given = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))

    def run(batches):
        for batch in batches:
            of_row = [batch.column(k).dictionary_encode() for k in (0, 1)]
            wide = max(len(of_row[1].dictionary), 1)
            numbers = of_row[0].indices.to_numpy().astype(np.int64) * wide + of_row[1].indices.to_numpy()
            for first, end, raw, offsets in texts.text_slices(batch.column(2), slice_bytes):
                raw, groups = texts.LOWER[raw], numbers[first:end]
                seen = np.zeros(0, dtype=np.uint64)
                parts = [raw] if len(raw) <= 2 * slice_bytes or end - first > 1 else _blocks(raw, slice_bytes)
                for part in parts:
                    inside = offsets if end - first > 1 else np.array([0, len(part)])
                    group, term, n, of_docs, hashes = _counted(part, inside, groups)
                    if part is not raw:
                        of_docs = np.where(np.isin(hashes, seen), 0, of_docs)
                        seen = np.union1d(seen, hashes)
                    named = [of_row[k].dictionary.take(pa.array(x)) for k, x in ((0, group // wide), (1, group % wide))]
                    yield pa.record_batch([*named, term, pa.array(n), pa.array(of_docs)], names=["lang", "source", "term", "n", "docs"])

    rows = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; missing without terms."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)")) + 1)


def distance(p, q):
    """floor((p - q)^2 / (p + q)) of numpy integers, p and q up to 10^9 + 1."""
    return (p - q) * (p - q) // (p + q)


def _accumulate(row: int, p: np.ndarray, postings: "_Slice", base: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What the slice adds to the group ``row``'s distance to each peer."""
    own = base[row]
    # As if no term were in common: own terms against the peers' baselines, theirs against this one, the rest both.
    values, times = np.unique(p, return_counts=True)
    cells = (postings.terms - len(p) - postings.sizes) * distance(own, base)
    step = max(SCATTERED // len(base), 1)
    for k in range(0, len(values), step):
        cells += (distance(values[k : k + step, None], base[None, :]) * times[k : k + step, None]).sum(axis=0)
    theirs = np.concatenate([[0], np.cumsum(distance(own, postings.values) * postings.times)])
    cells += theirs[postings.value_ends] - theirs[postings.value_starts]
    # Then the terms in common, through their postings.
    lengths = postings.ends[codes] - postings.starts[codes]
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(SCATTERED, int(lengths.sum()) + 1, SCATTERED), side="right")
    for some in np.split(np.arange(len(codes)), np.unique(cuts)):
        n = lengths[some]
        at = np.arange(int(n.sum())) + np.repeat(postings.starts[codes[some]] - (np.cumsum(n) - n), n)
        peer, q, mine = postings.peers[at], postings.p[at], np.repeat(p[some], n)
        other = base[peer]
        change = distance(mine, q) - distance(mine, other) - distance(own, q) + distance(own, other)
        cells += np.bincount(peer, change, minlength=len(base)).astype(np.int64)
    return cells


class _Slice:
    """The postings of a slice of terms, in order of terms, and the distinct shares of each peer in it."""

    def __init__(self, codes: np.ndarray, peers: np.ndarray, p: np.ndarray, n_peers: int):
        self.terms = int(codes.max(initial=-1)) + 1
        order = np.argsort(codes, kind="stable")
        self.peers, self.p = peers[order], p[order]
        self.starts = np.searchsorted(codes[order], np.arange(self.terms))
        self.ends = np.searchsorted(codes[order], np.arange(self.terms), side="right")
        self.sizes = np.bincount(peers, minlength=n_peers)
        pairs, self.times = np.unique(np.stack([peers, p]), axis=1, return_counts=True)
        self.values = pairs[1]
        self.value_starts = np.searchsorted(pairs[0], np.arange(n_peers))
        self.value_ends = np.searchsorted(pairs[0], np.arange(n_peers), side="right")


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pairs_of_slice(postings: pa.Table, groups: pa.Table) -> pa.Table:
    names = groups["source"].combine_chunks()
    mine = np.flatnonzero(groups["mine"].to_numpy())
    base = groups["base"].fill_null(1).to_numpy()
    peers = pc.index_in(postings["source"], names).to_numpy().astype(np.int64)
    codes = postings["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    p = postings["p"].to_numpy()
    index = _Slice(codes, peers, p, len(names))
    by_peer = np.argsort(peers, kind="stable")
    bounds = np.searchsorted(peers[by_peer], np.arange(len(names) + 1))
    out = []
    for row in mine.tolist():
        terms = by_peer[bounds[row] : bounds[row + 1]]
        cells = _accumulate(row, p[terms], index, base, codes[terms])
        others = np.delete(np.arange(len(names)), row)
        named = [names.take(pa.array(x)) for x in (np.full(len(others), row), others)]
        lang = groups["lang"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(others), dtype=np.int64)))
        out.append(pa.table([lang, *named, pa.array(cells[others])], schema=_PAIRS))
    return pa.concat_tables(out) if out else _PAIRS.empty_table()


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of ``term_counts`` whose term is in ``min_docs`` rows of its language, with the language's ``total`` of the term."""
    of_term = Window.partitionBy("lang", "term")
    return counts.withColumns({"lang_docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term)}).where(
        F.col("lang_docs") >= min_docs
    ).drop("docs", "lang_docs")


def audit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs, even without a text.

    Part ``pair``: every other source of the language by its distance; part ``term``: of the terms that the group has and uses more than
    its language does, the ``top`` that differ most. Terms in under ``min_docs`` rows of a language are left out. Ranks go from the largest value, ties by item.
    Missing texts, languages and sources are empty text; rows that repeat count as often as they occur. A language
    without kept terms has pairs of value 0 and no terms. A language with one source has no pairs.
    """
    empty = lambda name: F.coalesce(field(name).cast("string"), F.lit(""))
    counts = written(kept_terms(term_counts(docs, text=text, lang=lang, source=source), min_docs), "term-counts")
    occurring = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = counts.groupBy("lang").agg(
        F.sum("n").alias("lang_size"), F.count(F.lit(1)).alias("postings"), F.count_distinct("term").alias("terms")
    )
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    pairs = F.pow(F.count(F.lit(1)).over(Window.partitionBy("lang")), 2)
    in_slice = F.greatest(F.lit(SLICE_POSTINGS), F.least(pairs, F.lit(TASK_PAIRS)))
    groups = written(
        groups.withColumns(
            {
                "base": _share(F.lit(0).cast("long"), F.col("size"), F.col("terms")),
                "slices": F.greatest(F.ceil(F.col("postings") / in_slice), F.lit(1)).cast("int"),
                "tiles": F.ceil(pairs / TASK_PAIRS).cast("int"),
            }
        ),
        "groups",
    )
    shares = counts.join(groups.drop("base", "postings"), ["lang", "source"]).withColumns(
        {"p": _share(F.col("n"), F.col("size"), F.col("terms")), "q": _share(F.col("total"), F.col("lang_size"), F.col("terms"))}
    )
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    apart = F.col("p") - F.col("q")
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", apart * apart, F.col("p") + F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    dealt = shares.withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")).select(
        "lang", "slice", every("tiles").alias("tile"), "source", "term", "p"
    )
    peers = groups.withColumn("slice", every("slices")).withColumn("tile", every("tiles")).select(
        "lang", "slice", "tile", "source", "base", (F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile")).alias("mine")
    )
    key = ["lang", "slice", "tile"]
    sums = dealt.groupBy(*key).cogroup(peers.groupBy(*key)).applyInArrow(_pairs_of_slice, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"
    ).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
