"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a token-group matrix.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set is its distinct
shingles of k words as 64-bit hashes, with fewer words the whole sequence as one. Documents of equal
sets are one class from the start; classes are linked as ``similar`` describes.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing.
Repeated rows are one class and each keeps its row; rows of one id with different texts are
separate documents that share the id. A null id is linked like others, but never names a component
that has another id. Bytes are hashed as they are. Other columns aren't looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmill.llm import similar
from obsmill.llm.common import BROADCAST_ROWS, U64, Scratch, checked_broadcast, distinct_by_row, join_split, mix, offsets_list, raw, shingles, signed, slices, sums_by_row, tidy, words
from obsmill.llm.components import components


Cut = Callable[[pa.RecordBatch], Iterable[tuple[pa.Array, pa.Array]]]


def _sets(column: pa.Array, k: int):
    """Some rows at a time: their number, their sets one after another, rising, and where each begins."""
    data, at = raw(column)
    for i, j in slices(at):
        h, _, _, first = words(data, at, i, j)
        yield j - i, *distinct_by_row(*shingles(h, first, k))


def _classes(tokens: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Each set's class: a hash of its tokens and its size; 0 of an empty set."""
    size = np.diff(to).astype(np.uint64)
    a, b = sums_by_row(mix(tokens), to), sums_by_row(tokens * U64(0x9E3779B97F4A7C15) ^ (tokens >> U64(29)), to)
    return np.where(size > 0, mix(mix(a + size) ^ b), U64(0))


def join_documents(docs: DataFrame, *, k: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", cut: Cut | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the smallest id that links reach, its own included).

    cut makes parts of rows, within the tasks that read them: it turns a batch (ids, texts) into
    batches (parts' ids, texts). A part's id is struct<doc, sig, start, end>: the row's id, a hash of
    its text, and the part's place in it; the result then has a row for each part, and id_col and
    component_id are such ids.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    if cut:
        kind = f"struct<doc: {kind}, sig: int, start: int, `end`: int>"
    split = cut or (lambda b: [(b.column(0), b.column(1))])
    source = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    exact = threshold >= similar.EXACT
    bands, rows = similar.tune(threshold)
    # a smaller set is similar to its equals alone, which its class joins
    least = math.ceil(similar.percent(threshold) / max(1, 100 - similar.percent(threshold)))

    def signatures(tokens: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if exact:
            keys = similar.part_signatures([tokens[a:b] for a, b in zip(to[:-1], to[1:], strict=True)], threshold)
            return np.concatenate(keys), np.cumsum([0, *map(len, keys)])
        some = np.diff(to) >= least
        begin, end = to[:-1][some], to[1:][some]
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(len(to), np.int64)
        # sets that are too small are left out of the runs of tokens
        of = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange((end - begin).sum())
        found = similar.band_signatures(tokens[of], np.concatenate([[0], np.cumsum(end - begin)]), bands, rows)
        return found.ravel(), np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])

    def describe(batches):
        for ids, column in (x for b in batches for x in split(b)):
            at = 0
            for n, tokens, to in _sets(column, k):
                keys, ends = signatures(tokens, to)
                yield pa.record_batch([ids.slice(at, n), pa.array(np.diff(to)), pa.array(signed(_classes(tokens, to))), offsets_list(signed(keys), ends)], ["doc", "n", "id", "keys"])
                at += n

    def fetched(batches):
        for b in batches:
            wanted = b.column(2)
            for ids, column in split(b):
                if cut:  # of a row's parts only those asked for
                    of = dict(zip(b.column(0).to_pylist(), wanted.to_pylist(), strict=True))
                    asked = {d: set(x) for d, x in of.items()}
                    names = zip(ids.field("doc").to_pylist(), ids.field("sig").to_pylist(), ids.field("start").to_pylist(), strict=True)
                    column = column.filter(pa.array([f"{s}:{a}" in asked[d] for d, s, a in names], pa.bool_()))
                for _, tokens, to in _sets(column, k):
                    yield pa.record_batch([pa.array(signed(_classes(tokens, to))), offsets_list(signed(tokens), to)], ["id", "tokens"])

    described = scratch.save(source.mapInArrow(tidy(describe), f"doc {kind}, n long, id long, keys array<long>"))
    filled = described.where("n > 0")
    classes = scratch.save(filled.groupBy("id").agg(F.min("doc").alias("doc"), F.count("*").alias("c")))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = scratch.save(ids.join(classes, "id").select("id", "doc"))
        n = wanted.count()
        # a class whose rows all lack an id is found among those
        if cut:
            by_doc = wanted.groupBy(F.col("doc.doc").alias("d")).agg(F.collect_set(F.concat_ws(":", "doc.sig", "doc.start")).alias("places"))
        else:
            by_doc = wanted.select(F.col("doc").alias("d"), F.lit(None).cast("array<string>").alias("places")).distinct()
        some = source.join(checked_broadcast(by_doc, n), F.expr("doc <=> d")).select("doc", "text", "places")
        return some.mapInArrow(tidy(fetched), "id long, tokens array<long>").join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])

    # one row of each class brings the signatures; a class of one row is that row
    again = scratch.save(classes.where("c > 1").select("id", F.col("doc").alias("d")))
    n = again.count()
    many = join_split(filled, again, "id", "left") if n > BROADCAST_ROWS else filled.join(F.broadcast(again), "id", "left")
    first = many.where("d IS NULL OR doc = d").select("id", "keys", "n")
    keys = scratch.save(first.where("size(keys) > 0")).select(F.explode("keys").alias("key"), "id", "n")
    edges = similar.band_links(keys, fetch, threshold, scratch) if cut else similar.links(keys.select("key", "id"), fetch, threshold, scratch)
    found = components(edges, scratch)
    names = scratch.save(classes.join(found, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component")))
    name = names.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_class = join_split(names.select("id", "component"), name, "component").select("id", "component_id")
    return join_split(described.select("doc", "n", "id"), by_class, "id", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.expr("if(n > 0, component_id, doc)").alias("component_id"))


def keep_one(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document of its smallest id.

    A row that is there again with its id and text stays once; rows without an id stay.
    """
    joined = join_documents(docs, k=k, threshold=threshold, id_col=id_col, text_col=text_col)
    gone = joined.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    again = joined.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("c")).where("c > 1").select(id_col)
    left = docs.join(gone, id_col, "left_anti")
    if not again.isEmpty():
        left = left.join(again, id_col, "left_anti").unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]))
    return left.select(*docs.columns)
