"""Token ids of a whole corpus under a public byte-level tokenizer, and back."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.llm.records import table
from mendframe.operators.components import join_with_hot_keys
from mendframe.session import Scratch

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that share a dictionary of words; a longer text has one of its own.
CHUNK_CHARS = 1 << 20


def ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """Token bytes to ids, from the rank file of a tokenizer in ``folder``."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def _code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as numbers into a dictionary of the distinct words of their chunk, then its words."""
    import regex

    split = regex.compile(PATTERN).findall
    part, serial = TaskContext.get().partitionId(), 0
    docs: list[tuple[int, list[int]]] = []
    words: dict[str, int] = {}
    size = 0

    def out() -> pd.DataFrame:
        chunk = (part << 32) + serial
        n, m = len(docs), len(words)
        return pd.DataFrame(
            {
                "chunk": np.full(n + m, chunk), "key": [k for k, _ in docs] + [None] * m, "codes": [c for _, c in docs] + [None] * m,
                "word": [None] * n + list(words), "place": np.concatenate([np.full(n, -1), np.arange(m)]).astype(np.int32),
            }
        )

    for b in batches:
        for key, text in zip(b["key"], b["text"]):
            docs.append((key, [words.setdefault(w, len(words)) for w in split(text)] if text else []))
            size += len(text) if text else 0
            if size >= CHUNK_CHARS or len(docs) >= 20_000:
                yield out()
                docs, words, size, serial = [], {}, 0, serial + 1
    if docs:
        yield out()


def _rebuild(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Token ids of the documents of a chunk from those of its words."""
    place = words["place"].to_numpy()
    ids = words["ids"].combine_chunks()
    sizes = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    own = np.diff(ids.offsets.to_numpy())
    sizes[place] = own
    start = np.zeros(len(sizes), np.int64)
    start[place] = np.cumsum(own) - own
    codes = docs["codes"].combine_chunks()
    seq = codes.flatten().to_numpy(zero_copy_only=False)
    n = sizes[seq]
    total = np.concatenate(([0], np.cumsum(n)))
    take = np.repeat(start[seq] - total[:-1], n) + np.arange(total[-1])
    offsets = total[codes.offsets.to_numpy() - codes.offsets[0].as_py()]
    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[take].astype(np.int32)))
    return pa.table({"key": docs["key"], "ids": out})


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, scratch_name: str = "encode") -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    Texts are split into words chunk by chunk and kept as positions into the chunk's dictionary, so a word
    travels once a chunk however often it occurs; each distinct word of the corpus is encoded once and its
    ids joined back, the commonest words by broadcast. An empty or null text has an empty list; texts
    that look like special tokens are ordinary text. One row out per row in; no row is dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, scratch_name)
    kind = docs.schema[key].dataType.simpleString()
    coded = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(_code, f"chunk long, key {kind}, codes array<int>, word string, place int")
    coded = scratch.write(coded, "coded")
    book = spark.sparkContext.broadcast(ranks(name, folder))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=book.value, special_tokens={})
        for b in batches:
            found = [own._encode_single_piece(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["word", "ids"])

    words = coded.where("place >= 0").select("chunk", "place", "word")
    once = scratch.write(words.select("word").distinct().mapInArrow(merge, "word string, ids array<int>"), "words")
    known = join_with_hot_keys(words, once, "word").select(F.col("chunk").alias("of"), "place", "ids")
    texts = coded.where("place < 0").select("chunk", "key", "codes")
    out = texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_rebuild, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode(ids: DataFrame, key: str = "doc_id", column: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, text): the texts of id lists, by a join of the table of token bytes. ``key`` is unique.

    That table has one row per id of the vocabulary, which bounds the broadcast. Ids outside of it
    give no bytes; an empty list gives an empty text, bytes that are no UTF-8 its replacement sign.
    """
    book = ids.sparkSession.createDataFrame([(i, bytearray(b)) for b, i in ranks(name, folder).items()], "id int, bytes binary")
    at = ids.select(key, F.posexplode(column).alias("pos", "id"))
    hexed = at.join(F.broadcast(book.select("id", F.hex("bytes").alias("h"))), "id")
    whole = hexed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("parts"))
    text = whole.select(key, F.decode(F.unhex(F.array_join(F.col("parts.h"), "")), "UTF-8").alias("text"))
    return ids.select(key).join(text, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the length of its ids and whether decoding gives its text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "roundtrip")
    ids = scratch.write(encode(docs, scratch_name="roundtrip_encode"), "ids")
    back = decode(ids).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").join(ids, "doc_id").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p6_same(spark: SparkSession, folder: str) -> DataFrame:
    """For every document whether its list of ids is empty and whether decoding gives its text back."""
    return p6_roundtrip(spark, folder).select("doc_id", (F.col("n_tokens") == 0).alias("empty"), "same")


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p6_same": p6_same}
ORACLES = {"p6_same": "SELECT doc_id, coalesce(length(text), 0) = 0 AS empty, true AS same FROM documents"}
