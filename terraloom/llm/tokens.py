"""Encoding of a whole corpus with a public byte-level tokenizer, by overlapping chunks.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised in parallel. Two neighbours resynchronise at the first
place of their overlap that both call a pre-token boundary; between such places lie the pieces, which are encoded on their own. Should
an overlap hold no common boundary, the document is encoded as one piece. A text that fits a chunk is its own piece.

Defined results: null and empty texts have the empty list of ids; nothing is added for special tokens, whose names are ordinary text;
a repeated key counts once; decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.runtime import broadcast_if_small, materialise

TOKENIZERS = "/opt/tokenizers"
CHUNK, OVERLAP = 16_384, 512


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A byte-level tokenizer of ``folder``, loaded once for each worker process."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern(folder), mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def pattern(folder: str = TOKENIZERS) -> str:
    """The pre-token pattern that comes with the vocabulary files."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(maxsize=4)
def _compiled(folder: str):
    import regex

    return regex.compile(pattern(folder))


def boundaries(text: str, folder: str = TOKENIZERS) -> list[int]:
    """Where pre-tokens of ``text`` end."""
    return [m.end() for m in _compiled(folder).finditer(text)]


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    t = tokenizer(name, folder)
    return b"".join(t.decode_single_token_bytes(i) for i in ids)


def _encoder(name: str, folder: str, keys: list[str], count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = [np.asarray(t.encode_ordinary(x), np.int32) if x else np.empty(0, np.int32) for x in part.column("text").to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                kept = [part.column(k) for k in keys]
                if count_only:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes)], names=[*keys, "n_tokens"])
                else:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keys, "ids"])

    return run


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key. The keys that do repeat are found and written first, so that their size is known: as long as they are few,
    no text is shuffled for the others."""
    again = broadcast_if_small(materialise(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)))
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").groupBy(key).agg(F.min("text").alias("text")))


def _pieces(long: DataFrame, folder: str) -> DataFrame:
    """(key, piece, text) of long texts."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    parts = long.select("key", cut.alias("parts")).select("key", F.posexplode(F.transform("parts", lambda c, i: F.struct(c.alias("c"), F.coalesce(F.get("parts", i + 1).substr(1, OVERLAP), F.lit("")).alias("more")))).alias("piece", "p"))
    parts = parts.select("key", "piece", F.concat("p.c", "p.more").alias("text"), F.length("p.c").alias("size"), (F.length("p.more") > 0).alias("goes_on"))
    parts = parts.repartition("key", "piece")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for text, size in zip(b.column("text").to_pylist(), b.column("size").to_pylist()):
                # Behind white space the end of a piece would read differently than the middle of a text.
                at = np.array([0, *(e for e in boundaries(text, folder) if not text[e - 1].isspace())], np.int32)
                heads.append(at[at < OVERLAP].tolist())
                tails.append((at[(at >= size) & (at < len(text))] - size).tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*b.schema.names, "heads", "tails"])

    kind = dict(long.dtypes)["key"]
    marked = parts.mapInArrow(ends, f"key {kind}, piece int, text string, size int, goes_on boolean, heads array<int>, tails array<int>")
    w = Window.partitionBy("key").orderBy("piece")
    meet = F.array_min(F.array_intersect("tails", F.lead("heads").over(w)))
    marked = marked.withColumn("until", F.when(F.col("goes_on"), meet).otherwise(F.lit(0)))
    marked = marked.withColumn("whole", F.max(F.col("until").isNull()).over(Window.partitionBy("key"))).withColumn("since", F.coalesce(F.lag("until").over(w), F.lit(0)))
    # Places count from a chunk's own start; the piece goes on into the overlap up to the meeting place.
    text = F.when(F.col("whole"), F.substring("text", 1, CHUNK)).otherwise(F.expr("substring(text, since + 1, size - since + until)"))
    out = marked.select("key", "piece", "whole", text.alias("text"))
    joined = out.filter("whole").groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))
    return out.filter("not whole").select("key", "piece", "text").unionByName(joined.select("key", F.lit(0).alias("piece"), "text"))


def _encoded(df: DataFrame, key: str, text: str, name: str, folder: str, count_only: bool) -> DataFrame:
    kind = dict(df.dtypes)[key]
    rows = _once(df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null"), "key")
    fits = F.coalesce(F.length("text") <= CHUNK, F.lit(True))
    result = "n_tokens bigint" if count_only else "ids array<int>"
    short = rows.filter(fits).mapInArrow(_encoder(name, folder, ["key"], count_only), f"key {kind}, {result}")
    pieces = _pieces(rows.filter(~fits), folder).repartition("key", "piece").mapInArrow(_encoder(name, folder, ["key", "piece"], count_only), f"key {kind}, piece int, {result}")
    if count_only:
        long = pieces.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        long = pieces.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long).withColumnRenamed("key", key)


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every text."""
    return _encoded(df, key, text, name, folder, False)


def token_counts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of every text."""
    return _encoded(df, key, text, name, folder, True)
