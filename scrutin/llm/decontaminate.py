"""Benchmark passages in training texts, by a distributed positional inverted
index.

The index holds the postings of every word of every text. It is cut by
document: a segment covers a few megabytes of whole texts (one longer text is
a segment of its own) and is one row of a Parquet table: its documents, its
dictionary, and for each term the rising positions of its occurrences, stored
as gaps. Items are cut to windows of ``n`` words. Every segment is searched
for all windows at once: the lists of a window's terms, taken from the rarest
of the segment, are shifted by the term's place in the window and intersected,
until the starts of exact occurrences are left. With ``slop`` a window matches
where its words stand in any order inside a run of at most ``n + slop`` words.

A text never leaves the task that reads it and nothing is shuffled but the
windows, so a source, passage or word that fills a third of the corpus weighs
on no task more than its texts do. The windows are broadcast in blocks of at
most ``WINDOWS``; more windows mean more passes over the index, each written
to the shared folder. A segment is a row group of its file, so what a task
holds is a few segments however large its share of the files is.

Edge cases: null and empty texts have no words and no hits; items that are
null or without a word have no window; an item without an id hits words but is
not named among the items; repeated items count once by their id, repeated
rows of a document each give a row; a very long text is cut into words by
parts and is bounded by the size of a row only; empty tables give no rows or
no hits; further columns are not carried and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Bytes of text in a segment; bytes of a text that are cut into words at once.
SEGMENT, PART = 4 << 20, 8 << 20
#: Windows that are broadcast at once (some 20 MB), candidates held at once.
WINDOWS, CANDIDATES = 100_000, 1 << 20
#: How the index is written: writers hold, and readers open, a row group at once.
BY_SEGMENT = {"parquet.block.row.count.limit": 1}
#: A word after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of words as they are, A-Z lower-cased, all others a space.
_BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
               for b in range(256))


def words(text: bytes) -> pa.ChunkedArray:
    """The words of a text in order."""
    text, parts, at = text.translate(_BYTES), [], 0
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        parts.append(pa.array(text[at:end].split(), pa.binary()))
        at = end
    return pa.chunked_array(parts, pa.binary())


def postings(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``(n_words, terms, counts, gaps)`` of a segment: words per text, the
    dictionary, occurrences per term, and the occurrences of each term as
    position less the one before (the first one as it is)."""
    found = [words(t or b"") for t in texts]
    n_words = np.array([len(w) for w in found], dtype=np.int32)
    coded = pa.chunked_array([c for w in found for c in w.chunks], pa.binary()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
    gaps = np.argsort(codes, kind="stable").astype(np.int32)
    firsts = np.cumsum(counts) - counts
    gaps[1:] -= gaps[:-1].copy()
    if len(firsts):
        last = np.zeros(len(firsts), dtype=np.int32)
        positions = np.cumsum(gaps, dtype=np.int64)
        last[1:] = positions[firsts[1:] - 1]
        gaps[firsts] += last
    return n_words, coded.dictionary, counts, gaps


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of ``docs``, written to the shared folder: one row
    per segment."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("docs", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.IntegerType())),
                           T.StructField("terms", T.ArrayType(T.BinaryType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType())),
                           T.StructField("gaps", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            start, step = 0, max(1, int(batch.num_rows * SEGMENT / max(batch.nbytes, 1)))
            while start < batch.num_rows:
                part = batch.slice(start, step)
                start += part.num_rows
                n_words, terms, counts, gaps = postings(part.column(1).cast(pa.binary()).to_pylist())
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [one(part.column(0)), one(pa.array(n_words)), one(terms), one(pa.array(counts)), one(pa.array(gaps))],
                    names=schema.names)

    return written(docs.select(F.col(f"`{key}`").alias("d"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema),
                   **BY_SEGMENT)


def windows(items: DataFrame, key: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """``(item, window)``: the distinct runs of ``n`` words of each item, or all
    its words if they are fewer. Ids are written as strings."""
    found = F.expr(rf"regexp_extract_all(translate(`{text}`, '{_UPPER}', '{_LOWER}'), r'{WORD}', 0)")
    w = items.select(F.col(f"`{key}`").cast("string").alias("item"), found.alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    runs = F.transform(at, lambda i: F.slice("w", i + 1, n))
    return w.select("item", F.explode(runs).alias("window")).distinct()


class Windows:
    """A block of windows: their terms, each window as a row of term numbers
    (-1 behind its end), and the items of each window."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("window").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.terms = coded.dictionary.cast(pa.binary())
        wide = np.full((len(sizes), int(sizes.max(initial=1))), -1, dtype=np.int32)
        wide[np.arange(wide.shape[1]) < sizes[:, None]] = coded.indices.to_numpy(zero_copy_only=False)
        self.rows, same = np.unique(wide, axis=0, return_inverse=True)
        self.sizes = (self.rows >= 0).sum(axis=1)
        items = rows.column("item").combine_chunks().dictionary_encode()
        self.items = items.dictionary
        number = items.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(same.ravel(), kind="stable")
        self.of, self.first = number[order], np.searchsorted(same.ravel()[order], np.arange(len(self.rows) + 1))


class Segment:
    """One segment opened for search."""

    def __init__(self, n_words: np.ndarray, terms: pa.Array, counts: np.ndarray, gaps: np.ndarray):
        self.terms, self.counts = terms, counts.astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.starts = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
        self.n = int(self.starts[-1])
        sums = np.cumsum(gaps, dtype=np.int64)
        before = np.concatenate([[0], sums])[self.first]
        self.positions = sums - np.repeat(before, self.counts)
        #: term number and position as one rising number
        self.keys = np.repeat(np.arange(len(counts)), self.counts) * max(self.n, 1) + self.positions

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def find(self, block: Windows, slop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(window, begin, end)`` of all matches, positions in the segment."""
        number = pc.index_in(block.terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        inside = block.rows >= 0
        codes = np.where(inside, number[block.rows], -1)
        alive = np.flatnonzero((codes >= 0).sum(axis=1) == block.sizes)
        none = np.empty(0, dtype=np.int64)
        if not len(alive) or not self.n:
            return none, none, none
        codes, inside = codes[alive], inside[alive]
        length = np.where(inside, self.counts[codes], np.iinfo(np.int64).max)
        rarest = np.argsort(length, axis=1, kind="stable")  # places of the terms, rarest first
        codes = np.take_along_axis(codes, rarest, axis=1)
        work = np.take_along_axis(length, rarest, axis=1)[:, 0]
        found, at = [], 0
        load = np.cumsum(work)
        while at < len(alive):
            end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + CANDIDATES, side="right")))
            part = slice(at, end)
            hit = self._exact if slop is None else self._near
            found.append(hit(np.arange(at, end), codes, rarest, block.sizes[alive], work[part], slop))
            at = end
        row, begin, stop = (np.concatenate(x) for x in zip(*found))
        there = (begin >= 0) & (stop <= self.starts[np.minimum(self.doc(np.maximum(begin, 0)) + 1, len(self.starts) - 1)])
        return alive[row[there]], begin[there], stop[there]

    def _occurrences(self, rows, codes, work):
        row = np.repeat(rows, work)
        within = np.arange(len(row)) - np.repeat(np.cumsum(work) - work, work)
        return row, self.positions[self.first[codes[row, 0]] + within]

    def _exact(self, rows, codes, places, sizes, work, _):
        row, position = self._occurrences(rows, codes, work)
        begin = position - places[row, 0]
        for j in range(1, codes.shape[1]):  # the next list, shifted to the start of the window
            key = codes[row, j].astype(np.int64) * self.n + begin + places[row, j]
            ix = np.searchsorted(self.keys, key)
            short = j >= sizes[row]
            keep = short | (self.keys[np.minimum(ix, len(self.keys) - 1)] == key)
            row, begin = row[keep], begin[keep]
        # a key outside its document's positions can be that of another term
        keep = (begin >= 0) & (begin + sizes[row] <= self.n)
        return row[keep], begin[keep], begin[keep] + sizes[row[keep]]

    def _near(self, rows, codes, places, sizes, work, slop):
        row, position = self._occurrences(rows, codes, work)
        # the runs that may hold this occurrence of the rarest term
        span = sizes[row] + slop
        back = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
        row, begin = np.repeat(row, span), np.repeat(position, span) - back
        keep = begin >= 0
        row, begin = row[keep], begin[keep]
        end, least = begin.copy(), np.full(len(begin), np.iinfo(np.int64).max)
        times = (codes[:, :, None] == codes[:, None, :]).sum(axis=2)  # how often the window holds the term
        for j in range(codes.shape[1]):
            code = codes[row, j].astype(np.int64)
            short = j >= sizes[row]
            ix = np.searchsorted(self.keys, np.where(short, 0, code) * self.n + begin)
            last = ix + times[row, j] - 1
            stop = self.first[code] + self.counts[code]
            there = ~short & (last < stop)
            least = np.where(there, np.minimum(least, self.positions[np.minimum(ix, len(self.keys) - 1)]), least)
            end = np.where(there, np.maximum(end, self.positions[np.minimum(last, len(self.keys) - 1)] + 1), end)
            keep = (short | there) & (end - begin <= sizes[row] + slop)
            row, begin, end, least = row[keep], begin[keep], end[keep], least[keep]
        keep = least == begin  # a run starts with a word of the window
        row, begin, end = row[keep], begin[keep], end[keep]
        same = np.unique(np.stack([row, begin, end], axis=1), axis=0) if len(row) else np.empty((0, 3), dtype=np.int64)
        return same[:, 0], same[:, 1], same[:, 2]


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate([[True], begin[1:] > reach[:-1]]) if len(begin) else np.empty(0, dtype=bool)
    return begin[new], reach[np.concatenate([new[1:], [True]])] if len(begin) else reach


_STATE = [T.StructField("begins", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
          T.StructField("found_doc", T.ArrayType(T.LongType())), T.StructField("found_item", T.ArrayType(T.StringType()))]


def _values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).flatten()


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _values(batch, name).to_numpy(zero_copy_only=False)


def _list(values, kind: pa.DataType | None = None) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pass(index: DataFrame, block, slop: int | None) -> DataFrame:
    """``index`` with the spans and items of one more block of windows."""
    fields = [f for f in index.schema.fields if f.name not in {s.name for s in _STATE}]
    first, names = len(fields) == len(index.schema.fields), [f.name for f in fields]

    def run(batches):
        for many in batches:
            for i in range(many.num_rows):
                batch, windows_ = many.slice(i, 1), block.value
                segment = Segment(_numbers(batch, "n_words"), _values(batch, "terms"), _numbers(batch, "counts"),
                                  _numbers(batch, "gaps"))
                window, begin, end = segment.find(windows_, slop)
                pairs = np.unique(np.stack([segment.doc(begin), window], axis=1), axis=0) if len(window) \
                    else np.empty((0, 2), dtype=np.int64)
                many_items = windows_.first[pairs[:, 1] + 1] - windows_.first[pairs[:, 1]]
                doc = np.repeat(pairs[:, 0], many_items)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(many_items) - many_items, many_items)
                item = windows_.of[np.repeat(windows_.first[pairs[:, 1]], many_items) + at]
                known = np.unique(np.stack([doc[item >= 0], item[item >= 0]], axis=1), axis=0)
                names_ = windows_.items.take(pa.array(known[:, 1], pa.int64()))
                docs = known[:, 0]
                if not first:
                    begin = np.concatenate([_numbers(batch, "begins"), begin])
                    end = np.concatenate([_numbers(batch, "ends"), end])
                    docs = np.concatenate([_numbers(batch, "found_doc"), docs])
                    names_ = pa.concat_arrays([_values(batch, "found_item"), names_])
                begin, end = merged(begin, end)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(n)) for n in names], _list(begin, pa.int64()),
                     _list(end, pa.int64()), _list(docs, pa.int64()), _list(names_)],
                    names=[*names, *[s.name for s in _STATE]])

    return index.mapInArrow(run, T.StructType([*fields, *_STATE]))


def matches(index: DataFrame, items: DataFrame, slop: int | None = None, doc: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)`` of every document of the
    index: the words in any match of a window of ``items`` (from
    :func:`windows`), the spans of these words (numbers of the first word and
    of the word behind, from 0) and the ids of the items that match, sorted."""
    spark = index.sparkSession
    items = written(items)
    blocks = -(-items.count() // WINDOWS)
    dealt = items.withColumn("b", F.pmod(F.xxhash64("item", "window"), F.lit(max(blocks, 1))))
    for b in range(max(blocks, 1)):
        rows = dealt.filter(F.col("b") == b).select("item", "window").toArrow()  # about WINDOWS rows
        index = _pass(index, spark.sparkContext.broadcast(Windows(rows)), slop)
        index = written(index, **BY_SEGMENT) if b + 1 < blocks else index
    kind = index.schema["docs"].dataType.elementType
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(doc, kind), T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType()), T.StructField("spans", span),
                           T.StructField("items", T.ArrayType(T.StringType()))])
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for many in batches:
            for i in range(many.num_rows):
                batch = many.slice(i, 1)
                ids, n_words = _values(batch, "docs"), _numbers(batch, "n_words").astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(n_words)])
                begin, end = _numbers(batch, "begins"), _numbers(batch, "ends")
                # spans of neighbouring documents may have been joined: cut them at the borders
                here = np.unique(np.concatenate([begin, starts[:-1][np.isin(starts[:-1], _inside(begin, end, starts))]]))
                stop = np.minimum(end[np.searchsorted(begin, here, side="right") - 1] if len(here) else here,
                                  starts[np.minimum(np.searchsorted(starts, here, side="right"), len(starts) - 1)])
                of = np.searchsorted(starts, here, side="right") - 1
                hit = np.bincount(of, weights=stop - here, minlength=len(ids)).astype(np.int64)
                spans = [[] for _ in range(len(ids))]
                for d, x, y in zip(of.tolist(), (here - starts[of]).tolist(), (stop - starts[of]).tolist()):
                    spans[d].append({"begin": x, "end": y})
                named = [set() for _ in range(len(ids))]
                for d, item in zip(_numbers(batch, "found_doc").tolist(), _values(batch, "found_item").to_pylist()):
                    named[d].add(item)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words), pa.array(hit), pa.array(spans, pa.list_(pair)),
                     pa.array([sorted(s, key=str.encode) for s in named], pa.list_(pa.string()))], names=schema.names)

    return index.select("docs", "n_words", *[s.name for s in _STATE]).mapInArrow(run, schema)


def _inside(begin: np.ndarray, end: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Those of ``borders`` that lie inside a span, behind its begin."""
    if not len(begin):
        return borders[:0]
    at = np.searchsorted(begin, borders, side="left") - 1
    return borders[(at >= 0) & (borders < end[np.maximum(at, 0)])]


def item_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in a 10-word window of a benchmark item."""
    index = build_index(table(spark, sf_dir, "documents"))
    found = matches(index, windows(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark
    WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, p, dw.n, item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

QUERIES = {"op11_decontaminate": op11_decontaminate}
ORACLE_SQL = {"op11_decontaminate": ORACLE}
