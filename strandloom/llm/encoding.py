"""Problem 8: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
#: Vocabularies are broadcast; a file beyond this size is refused.
MAX_VOCABULARY = 32_000_000

#: Rank files whose texts are split by the rules of :mod:`strandloom.llm.bpe`; ranks of other rules would give wrong ids.
SAME_RULES = ("byte_bpe_50k", "byte_bpe_multi_50k")

_MERGERS: dict[int, bpe.Merger] = {}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """A broadcast of the rank file ``name``.tiktoken, which must be one of SAME_RULES."""
    if name not in SAME_RULES:
        raise ValueError(f"{name} is not known to split texts by the rules used here")
    data = Path(folder, f"{name}.tiktoken").read_bytes()
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary {name} has {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


def merger_of(shared) -> bpe.Merger:
    """The worker's merger for a broadcast vocabulary; it and its cache serve all tasks of the worker."""
    key = hash(shared.value)
    if key not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[key] = bpe.Merger(bpe.read_ranks(shared.value))
    return _MERGERS[key]


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, offsets: bool = False) -> DataFrame:
    """key, ids (and offsets: for each id the code point where its piece begins). No special tokens.

    Null and empty texts have an empty list. Whole texts are encoded, of any length; repeated keys give a row each.
    """
    shared = vocabulary(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(shared)
        for batch in batches:
            at = 0
            for texts in bpe.chunks([t or "" for t in batch.column(1).to_pylist()]):
                ids, counts, starts = bpe.encode(texts, merger)
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                out = [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(bounds, pa.array(ids))]
                if offsets:
                    out.append(pa.ListArray.from_arrays(bounds, pa.array(starts)))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(out, ["key", "ids", "offsets"][: len(out)])

    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + ", offsets array<int>" * offsets
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """The columns ``keep`` and BIGINT n_tokens of each document; 0 for null and empty texts."""
    shared = vocabulary(documents.sparkSession, name, folder)
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            _, counts, _ = bpe.encode(texts, merger)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    return documents.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, n_tokens bigint")


def decoded(rows: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """key, text of encoded rows."""
    shared = vocabulary(rows.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = merger_of(shared).ranks
        words = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            words[i] = w
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids, words) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
