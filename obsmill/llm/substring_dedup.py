"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are a text's lines, of any length. They are banded by MinHash over shingles of five words
(bands and rows are tuned from threshold and recall), paragraphs that collide are joined, verified by
exact Jaccard similarity and clustered by connected components. A cluster that meets two documents
or more is a repeat; its least place (document, position) keeps its copy.

Passages inside longer paragraphs, or across them, are an addition, counted apart (column ``by``):
windows of ``SIZE`` words begin at content-chosen words (of any ``STEP`` consecutive starts the one of
least hash is chosen, so equal text chooses equal starts), and equal windows meet. Two texts with
SIZE + STEP - 1 = 50 words in common always share a window. A window that a text repeats is one row with
all its places. Shared windows on one diagonal are a run;
a run is extended word by word, left and right, as far as the keeper's words are the same, which is
less than STEP words, as more would hold another window.

Removed stretches of a text that overlap or touch are one passage, which counts from ``min_words``
words on: a short line that many documents share is no passage, several such lines in a row are.

Words are runs without ASCII white space, A-Z lower-cased; a paragraph ends at a line feed.
Positions are code points. Null, empty and short texts have no spans. Rows of one id are one
document: what its rows share is no repetition across documents, and each row's spans are those of
its own text. Rows without an id are left alone. A passage that occurs twice in its keeper is kept
twice. Other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsmill.llm.common import U64, Scratch, checked_broadcast, hash_spans, hot_keys, join_split, mix, offsets_list, raw, signed, slices, spans, tidy, with_groups
from obsmill.llm.ngram_join import join_documents

SIZE, STEP = 26, 25
#: Least words of a passage.
MIN_WORDS = 50
#: Bytes of text at a time where each word brings STEP values.
SLICE = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_TOP = U64(2**64 - 1)


def windows(h: np.ndarray, first: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen starts (word numbers, rising) and hashes of the windows of ``size`` words."""
    n = len(h)
    count = np.diff(first)
    starts = np.maximum(count - size + 1, 0)  # of each row, how many windows fit
    if not starts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_BASE))]))
    back = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_INVERSE))]))
    total = np.concatenate([[U64(0)], np.cumsum(h * power[:-1])])
    run = lambda at, k: mix((total[at + k] - total[at]) * back[at])
    left = np.zeros(n, np.int64)  # of each word: starts from it to the end of its row's
    fits = np.flatnonzero(starts)
    at = np.repeat(first[:-1][fits], starts[fits]) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts[fits]) - starts[fits], starts[fits])
    left[at] = np.repeat(first[:-1][fits] + starts[fits], starts[fits]) - at
    anchor = np.full(n + step, _TOP)
    anchor[at] = run(at, 5)
    full = at[left[at] >= step]
    chosen = np.zeros(n, bool)
    if len(full):
        chosen[full + sliding_window_view(anchor, step)[full].argmin(axis=1)] = True
    few = fits[starts[fits] < step]
    chosen[first[:-1][few]] = True
    found = np.flatnonzero(chosen)
    return found, run(found, size)


def signature(text: np.ndarray) -> int:
    """Tells the rows of one id apart."""
    return xxhash.xxh32_intdigest(text.tobytes()) - 2**31


def paragraphs(b: pa.RecordBatch):
    """Batches of lines with words: their places (in words) and texts. b: ids, texts."""
    data, at = raw(b.column(1))
    for i, j in slices(at):
        low, start, _, first = spans(data, at, i, j)
        cut = at[i : j + 1] - at[i]
        edges = np.union1d(cut, np.flatnonzero(low[:-16] == 10) + 1)
        text = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(low.tobytes()))
        row = np.searchsorted(cut, edges[:-1], side="right") - 1
        word = np.searchsorted(start, edges)
        some = word[1:] > word[:-1]
        row, begin, end = row[some], word[:-1][some], word[1:][some]
        sig = np.array([signature(data[at[k] : at[k + 1]]) for k in range(i, j)], np.int64)
        place = [b.column(0).take(pa.array(row + i)), pa.array(sig[row], pa.int32()), pa.array(begin - first[row], pa.int32()), pa.array(end - first[row], pa.int32())]
        yield pa.StructArray.from_arrays(place, ["doc", "sig", "start", "end"]), text.filter(pa.array(some))


def _cut(batches):
    """The windows of each row: doc, sig, key, start words (at). What a text repeats is one row."""
    for b in batches:
        data, at = raw(b.column(1))
        for i, j in slices(at, SLICE):
            low, start, end, first = spans(data, at, i, j)
            found, key = windows(hash_spans(low, start, end - start), first, SIZE, STEP)
            row = np.searchsorted(first, found, side="right") - 1
            sig = np.array([signature(data[at[k] : at[k + 1]]) for k in range(i, j)], np.int64)
            order, begin = _runs(found, key, row)
            one = row[order][begin]
            starts = offsets_list((found - first[row])[order].astype(np.int32), np.append(begin, len(order)))
            yield pa.record_batch([b.column(0).take(pa.array(one + i)), pa.array(sig[one], pa.int32()), pa.array(signed(key[order][begin])), starts], ["doc", "sig", "key", "at"])


def _runs(last: np.ndarray, *keys: np.ndarray, gap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the last of them first, then by ``last``, and where in it other keys begin, or a step of more than gap."""
    order = np.lexsort((last, *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    if gap is not None:
        new[1:] &= np.diff(last[order]) <= gap
    new[1:] = ~new[1:]
    return order, np.flatnonzero(new)


def _chosen(min_words: int):
    """The lines and runs that may be in a passage of min_words, runs as long as they may get.

    From rows by text (doc, sig, at, size, kdoc, ksig, kat): lines (their first word, words and keeper; no
    ksig) and windows (where they begin, and where the keeper's does). To (doc, sig, starts, size, keeper,
    removed, ksig, kat): the runs of a text that have one place in the keeper are one row.
    """

    def chosen(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        doc, sig, at, size, kdoc, ksig, kat = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
        text = np.concatenate([[0], np.cumsum(_differ(doc) | _differ(sig))])
        count = np.asarray(pa.compute.list_value_length(at))
        row, start = np.repeat(np.arange(len(t)), count), np.asarray(at.flatten()).astype(np.int64)
        line = np.asarray(ksig.is_null())
        other = np.asarray(pa.compute.fill_null(kdoc.dictionary_encode().indices, -1)).astype(np.int64)
        kat, ksig_of = (np.asarray(c.fill_null(0)).astype(np.int64) for c in (kat, ksig))
        removed = np.asarray(pa.compute.not_equal(doc, kdoc))
        # windows on one diagonal are a run
        w = np.flatnonzero(~line[row])
        shift = kat[row[w]] - start[w]
        order, begin = _runs(start[w], shift, ksig_of[row[w]], other[row[w]], text[row[w]], gap=SIZE)
        w = w[order]
        ends = np.append(begin, len(w))[1:] - 1
        lines = np.flatnonzero(line[row])
        of = np.concatenate([row[lines], row[w[begin]]])
        a = np.concatenate([start[lines], start[w[begin]]])
        z = np.concatenate([start[lines] + np.asarray(size.fill_null(0)).astype(np.int64)[row[lines]], start[w[ends]] + SIZE])
        k = np.concatenate([np.zeros(len(lines), np.int64), a[len(lines) :] + shift[order][begin]])
        more = np.where(line[of], 0, STEP - 1)
        # islands of what overlaps or touches, of each text the removed ones apart
        island = 2 * text[of] + removed[of]
        lo, hi = (island << 40) + a - more + STEP, (island << 40) + z + more + STEP
        order = np.lexsort((hi, lo))
        reach = np.maximum.accumulate(hi[order])
        begin = np.flatnonzero(np.append(True, lo[order][1:] > reach[:-1]))
        words = reach[np.append(begin, len(of))[1:] - 1] - lo[order][begin]
        keep = order[np.repeat(words >= min_words, np.diff(np.append(begin, len(of))))]
        of, a, z, k = of[keep], a[keep], z[keep], k[keep]
        # a line stays a row of its own
        own = np.where(line[of], of + 1, 0)
        order, begin = _runs(a, z - a, k, ksig_of[of], other[of], own, text[of])
        one = order[begin]
        plain, take = line[of[one]], pa.array(of[one])
        columns = [doc.take(take), sig.take(take), offsets_list(a[order].astype(np.int32), np.append(begin, len(order))), pa.array(z[one] - a[one], pa.int32()), kdoc.take(take), pa.array(removed[of[one]]), ksig.take(take), pa.array(k[one], pa.int32(), mask=plain)]
        return pa.record_batch(columns, ["doc", "sig", "starts", "size", "keeper", "removed", "ksig", "kat"])

    def run(batches):
        held = []
        for b in batches:
            if not len(b):
                continue
            new = np.flatnonzero(_differ(b.column(0)) | _differ(b.column(1)))
            last = int(new[-1]) + 1 if len(new) else 0  # the last text may go on
            if held and (held[-1].column(0)[-1] != b.column(0)[0] or held[-1].column(1)[-1] != b.column(1)[0]):
                yield chosen(pa.Table.from_batches(held))
                held = []
            if last:
                yield chosen(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield chosen(pa.Table.from_batches(held))

    return run


def _differ(column: pa.Array) -> np.ndarray:
    """Of each item but the first, whether it isn't the one before."""
    return np.asarray(pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)))


def _contexts(batches):
    """Words beside asked places: those before it (side 0) or from it on (side 1).

    With them where in the text they begin, and the place itself, or where the word before the place
    and they end. batches: doc, text, asked array<struct<sig, at, side>>.
    """
    for b in batches:
        data, at = raw(b.column(1))
        asked = b.column(2).to_pylist()
        out: list[list] = [[] for _ in range(6)]
        for k in range(len(b)):
            sig = signature(data[at[k] : at[k + 1]])
            places = sorted((x["at"], x["side"]) for x in asked[k] if x["sig"] == sig)
            if not places:
                continue
            low, start, end, _ = spans(data, at, k, k + 1)
            h = hash_spans(low, start, end - start)
            point = _points(low)
            for p, side in places:
                a, z = (max(0, p - STEP), p) if side == 0 else (p, min(len(h), p + STEP))
                edge = point[start[a : p + 1]] if side == 0 else point[end[p - 1 : z]]
                for column, value in zip(out, (k, sig, p, side, signed(h[a:z]), edge), strict=True):
                    column.append(value)
        k, sig, p, side, h, edge = out
        lists = lambda some, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(np.concatenate(some) if some else np.zeros(0, np.int64), kind))
        yield pa.record_batch([b.column(0).take(pa.array(k, pa.int64())), pa.array(sig, pa.int32()), pa.array(p, pa.int32()), pa.array(side, pa.int32()), lists(h, pa.int64()), lists(edge, pa.int32())], ["kdoc", "ksig", "at", "side", "h", "edge"])


def _points(low: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((low[:-16] & 0xC0) != 0x80)])


def _common(own: np.ndarray, other: np.ndarray) -> int:
    """How many items from the first on are the same."""
    n = min(len(own), len(other))
    differ = np.flatnonzero(own[:n] != other[:n])
    return int(differ[0]) if len(differ) else n


class Marks:
    """The marks of a batch of texts, without making Python objects of their arrays."""

    def __init__(self, column: pa.ListArray):
        self.at = np.asarray(column.offsets)
        self.valid = np.asarray(column.is_valid())
        flat = column.values
        self.sig, self.size = (np.asarray(flat.field(c)) for c in ("sig", "size"))
        self.first, self.start = np.asarray(flat.field("starts").offsets), np.asarray(flat.field("starts").values)
        self.removed, self.keeper = np.asarray(flat.field("removed")), flat.field("keeper")
        self.run = np.asarray(flat.field("before").is_valid())
        self.sides = [[(np.asarray(flat.field(side).field(c).offsets), np.asarray(flat.field(side).field(c).values)) for c in ("h", "edge")] for side in ("before", "behind")]

    def of(self, row: int, sig: int) -> list[int]:
        if not self.valid[row]:
            return []
        a, z = self.at[row], self.at[row + 1]
        return (a + np.flatnonzero(self.sig[a:z] == sig)).tolist()

    def starts(self, mark: int) -> list[int]:
        return self.start[self.first[mark] : self.first[mark + 1]].tolist()

    def beside(self, mark: int, side: int) -> tuple[np.ndarray, np.ndarray]:
        """A run's keeper's words on a side, and where they begin or end."""
        return tuple(values[at[mark] : at[mark + 1]] for at, values in self.sides[side])


def _resolve(text: np.ndarray, marks: Marks, row: int, min_words: int) -> tuple[list[tuple], list[tuple]]:
    """Passages of a text, (start, end, keeper, removed, by), and what keepers' runs are, (keeper, start, end).

    A mark is a paragraph or a run (of size words from each of its starts on) with its keeper's words before and behind.
    """
    some = marks.of(row, signature(text))
    if not some:
        return [], []
    low, start, end, _ = spans(text, np.array([0, len(text)]), 0, 1)
    point = _points(low)
    h = signed(hash_spans(low, start, end - start)) if marks.run[some].any() else None
    found, kept = [], []
    for m in some:
        size, keeper, removed = int(marks.size[m]), marks.keeper[m].as_py(), bool(marks.removed[m])
        if marks.run[m]:
            (before, begins), (behind, ends) = marks.beside(m, 0), marks.beside(m, 1)
        for a in marks.starts(m):
            z, runs = a + size, None
            if marks.run[m]:
                left, right = _common(h[max(0, a - STEP) : a][::-1], before[::-1]), _common(h[z : z + STEP], behind)
                a, z = a - left, z + right
                runs = (keeper, int(begins[len(before) - left]), int(ends[right]))
            found.append((a, z, keeper, removed, "paragraph" if runs is None else "passage", runs))
    out = []
    for removed in (False, True):
        rest = sorted((x for x in found if x[3] is removed), key=lambda x: x[:3])
        at = 0
        while at < len(rest):
            k, reach = at + 1, rest[at][1]
            while k < len(rest) and rest[k][0] <= reach:
                reach = max(reach, rest[k][1])
                k += 1
            group, at = rest[at:k], k
            if reach - group[0][0] >= min_words:
                by = {x[4] for x in group}
                out.append((int(point[start[group[0][0]]]), int(point[end[reach - 1]]), min(x[2] for x in group), removed, by.pop() if len(by) == 1 else "both"))
                kept += [x[5] for x in group if x[5]]
    return out, kept


def _marks(docs: DataFrame, threshold: float, min_words: int, scratch: Scratch) -> DataFrame:
    """Per document: doc, marks. docs: doc, text, no id null."""
    kind = docs.schema["doc"].dataType.simpleString()
    clusters = scratch.save(join_documents(docs, k=5, threshold=threshold, id_col="doc", cut=paragraphs, scratch=scratch).select(F.col("doc").alias("place"), F.col("component_id").alias("least"), F.xxhash64("component_id").alias("c")))
    met = with_groups(clusters, "c", last=F.max("place.doc")).where("least.doc <> last")
    lines = met.select("place.doc", "place.sig", "place.start", "place.end", F.col("least.doc").alias("keeper"))

    pieces = scratch.save(docs.mapInArrow(tidy(_cut), f"doc {kind}, sig int, key long, at array<int>"))
    shared = with_groups(pieces, "key", least=F.min(F.struct("doc", "sig", F.col("at")[0].alias("at"))), last=F.max("doc")).where("least.doc <> last AND doc <> least.doc")
    copies = shared.select("doc", "sig", "at", F.lit(None).cast("int").alias("size"), F.col("least.doc").alias("kdoc"), F.col("least.sig").alias("ksig"), F.col("least.at").alias("kat"))
    none = F.lit(None).cast("int")
    flat = lines.select("doc", "sig", F.array("start").alias("at"), F.expr("`end` - start").alias("size"), F.col("keeper").alias("kdoc"), none.alias("ksig"), none.alias("kat"))
    by_text = flat.unionByName(copies).repartition("doc").sortWithinPartitions("doc", "sig")
    wanted = scratch.save(by_text.mapInArrow(tidy(_chosen(min_words)), f"doc {kind}, sig int, starts array<int>, size int, keeper {kind}, removed boolean, ksig int, kat int"))

    # the keepers' words beside the runs
    some = wanted.where("ksig IS NOT NULL")
    ends = (F.col("kat"), F.col("kat") + F.col("size"))
    sides = [some.select(F.col("keeper").alias("kdoc"), "ksig", c.alias("at"), F.lit(k).alias("side")) for k, c in enumerate(ends)]
    asked = scratch.save(sides[0].union(sides[1]).distinct())
    by_keeper = asked.groupBy(F.col("kdoc").alias("doc")).agg(F.collect_list(F.struct(F.col("ksig").alias("sig"), "at", "side")).alias("asked"))
    texts = docs.join(checked_broadcast(by_keeper, asked.count()), "doc").select("doc", "text", "asked")
    beside = scratch.save(texts.mapInArrow(tidy(_contexts), f"kdoc {kind}, ksig int, at int, side int, h array<long>, edge array<int>").dropDuplicates(["kdoc", "ksig", "at", "side"]))
    place = lambda side: F.xxhash64("keeper", "ksig", ends[side], F.lit(side))
    known = scratch.save(some.withColumn("k0", place(0)).withColumn("k1", place(1)))
    of = lambda name, k: beside.where(F.col("side") == k).select(F.xxhash64("kdoc", "ksig", "at", "side").alias(f"k{k}"), F.struct("h", "edge").alias(name))
    told = join_split(join_split(known, of("before", 0), "k0"), of("behind", 1), "k1", hot=hot_keys(known, "k1"))
    none = F.lit(None).cast("struct<h: array<bigint>, edge: array<int>>")
    plain = wanted.where("ksig IS NULL").withColumn("before", none).withColumn("behind", none)
    mark = ["doc", "sig", "starts", "size", "keeper", "removed", "before", "behind"]
    return told.select(*mark).unionByName(plain.select(*mark)).groupBy("doc").agg(F.collect_list(F.struct(*mark[1:])).alias("marks"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("doc"), docs[text_col].alias("text"))


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per passage: id_col, start, end, component_id (its keeper), removed, by (paragraph, passage or both).

    A keeper's own passages are there with ``removed`` false.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = _source(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            data, at = raw(b.column(1))
            marks, rows, told = Marks(b.column(2)), [], {}
            for k, doc in enumerate(b.column(0).to_pylist()):
                found, kept = _resolve(data[at[k] : at[k + 1]], marks, k, min_words)
                rows += [(doc, *x) for x in found]
                told |= dict.fromkeys(kept)
            rows += [(x[0], x[1], x[2], x[0], False, "passage") for x in told]
            names = ["doc", "start", "end", "keeper", "removed", "by"]
            kinds = [b.schema.types[0], pa.int32(), pa.int32(), b.schema.types[0], pa.bool_(), pa.string()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    marked = source.join(_marks(source, threshold, min_words, scratch), "doc").select("doc", "text", "marks")
    found = scratch.save(marked.mapInArrow(tidy(run), f"doc {kind}, start int, `end` int, keeper {kind}, removed boolean, by string"))
    # many copies tell the same of their keeper
    kept = found.where("NOT removed").groupBy("doc", "start", "end", "keeper", "by").agg(F.lit(1).alias("one")).drop("one")
    by_doc = W.partitionBy("doc").orderBy("start", "end")
    new = F.coalesce(F.col("start") > F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    islands = kept.withColumn("new", new).withColumn("island", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    how = F.when(F.count_distinct("by") > 1, "both").otherwise(F.min("by"))
    kept = islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("keeper").alias("keeper"), how.alias("by"))
    # a keeper's passage may itself be a copy of an earlier one
    gone = found.where("removed").select(F.col("doc").alias("d"), F.col("start").alias("a"), F.col("end").alias("z"))
    kept = kept.join(gone, F.expr("doc = d AND a <= start AND z >= `end`"), "left_anti")
    columns = [F.col("doc").alias(id_col), "start", "end", F.col("keeper").alias("component_id"), "removed", "by"]
    return found.where("removed").select(*columns).unionByName(kept.withColumn("removed", F.lit(False)).select(*columns))


def remove_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` without their removed passages; a row of which nothing is left goes."""
    scratch = scratch or Scratch(docs.sparkSession)
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    chars_at = names.index(chars_col) if chars_col in names else None
    marks = _marks(_source(docs, id_col, text_col), threshold, min_words, scratch).toDF("doc", "marks")
    fields = [f"c{k}" for k in range(len(names))]
    plain = docs.toDF(*fields)

    def run(batches):
        for b in batches:
            column, marks = b.column(text_at), Marks(b.column(len(names)))
            data, at = raw(column)
            touched, text, size, keep = [], [], [], []
            for k in range(len(b)):
                gone = [x for x in _resolve(data[at[k] : at[k + 1]], marks, k, min_words)[0] if x[3]] if marks.valid[k] else []
                if not gone:
                    keep.append(True)
                    continue
                x, begin, left = data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"), 0, []
                for a, z, *_ in sorted(gone):
                    left.append(x[begin:a])
                    begin = z
                y = "".join([*left, x[begin:]])
                touched.append(k)
                text.append(y)
                size.append(len(y))
                keep.append(bool(y.strip()))
            columns = list(b.columns[: len(names)])
            if touched:
                mask = np.zeros(len(b), bool)
                mask[touched] = True
                columns[text_at] = pa.compute.replace_with_mask(column, pa.array(mask), pa.array(text, column.type))
                if chars_at is not None:
                    columns[chars_at] = pa.compute.replace_with_mask(columns[chars_at], pa.array(mask), pa.array(size, columns[chars_at].type))
            yield pa.record_batch(columns, names=fields).filter(pa.array(keep, pa.bool_()))

    joined = plain.join(marks, plain[f"c{id_at}"] == marks["doc"], "left").drop("doc")
    return joined.mapInArrow(tidy(run), plain.schema).toDF(*names)
