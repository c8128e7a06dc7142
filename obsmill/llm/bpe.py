"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut before white space that follows a visible ASCII character: no match of the
splitting pattern holds both, so the ids are those of the whole text. A stretch without such a
place is split by the pattern itself, match by match, since the library's own splitter overflows
its stack on very long runs.

Null and empty texts have no ids and decode to no bytes. Bytes that aren't UTF-8 count as U+FFFD.
Repeated rows are encoded each on its own; other columns aren't looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from obsmill.llm.common import parts

#: Characters after which a safe boundary is looked for.
CHUNK = 32_768
#: A chunk longer than this had no safe boundary for long.
UNSAFE = 131_072
_SAFE = re.compile(r"[!-~](?=[ \n])")


@cache
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK and (m := _SAFE.search(text, at + CHUNK)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(text: str, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    import regex

    enc, ids = encoding(rank_file, pattern), []
    for chunk in chunks(text):
        if len(chunk) <= UNSAFE:
            ids.append(np.asarray(enc.encode_ordinary(chunk), "<u4"))
        else:
            ids += [np.asarray(enc._encode_single_piece(m[0]), "<u4") for m in regex.finditer(pattern, chunk)]
    return np.concatenate(ids)


def decode(ids: np.ndarray, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """Raw bytes; a token may hold part of a character."""
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row: id_col, ids array<int>."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            for i, some in parts(b.column(1)):
                ids = [pa.array(encode(x, rank_file, pattern).astype(np.int32)) for x in some]
                yield pa.record_batch([b.column(0).slice(i, len(some)), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes, decodes the ids again, and returns counts and SHA-256 of both, without moving the ids."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            for i, some in parts(b.column(1)):
                n, of_ids, of_bytes = [], [], []
                for x in some:
                    ids = encode(x, rank_file, pattern)
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
                yield pa.record_batch([b.column(0).slice(i, len(some)), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n", "a", "b"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
