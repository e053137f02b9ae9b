"""Encoding of a corpus with a public byte-level BPE, over a table of distinct words.

Words are split in the JVM. A block of texts keeps its distinct words once and its texts as codes of those words, by
position; so what is shuffled is one row for each block and distinct word, not one for each occurrence. Sorted by word,
each distinct word is encoded once; its ids go back to the blocks, where the positions take them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.session import write_cut

#: The public pre-tokenization pattern of this vocabulary, a fixed value; (?U) gives \s its Unicode meaning in the JVM.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and bytes after which a block of texts is full. A block is one row, so they bound a row and a task's memory.
BLOCK_WORDS, BLOCK_BYTES = 1_000_000, 1 << 27


def default_vocabulary() -> str:
    """Path of the ranks file byte_bpe_50k; the file itself is never copied."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def read_ranks(vocabulary: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    """Read once for each Python worker, from a file that all nodes have."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(vocabulary), special_tokens={})


def blocks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids ARRAY, sizes BINARY, codes BINARY, words ARRAY<STRING>): texts as codes of their block's distinct words.

    Pieces of a text that are encoded by themselves are its words; joined in order they are the text.
    """
    key = texts.schema[id_col].dataType.simpleString()
    split = texts.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PATTERN), F.lit(0)).alias("words"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, pa.Array]] = []
        words = octets = 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, _ in held])
            sizes = np.concatenate([np.diff(w.offsets.to_numpy()) for _, w in held]).astype(np.int32)
            coded = pa.chunked_array([w.flatten() for _, w in held], pa.string()).combine_chunks().dictionary_encode()
            one = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([sizes.tobytes()], pa.binary())]
            one += [pa.array([coded.indices.to_numpy().astype(np.int32).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)]
            return pa.RecordBatch.from_arrays(one, ["block", "ids", "sizes", "codes", "words"])

        for batch in batches:
            held.append((batch.column(0), batch.column(1)))
            words += len(batch.column(1).flatten())
            octets += batch.column(1).nbytes
            if words > BLOCK_WORDS or octets > BLOCK_BYTES:
                yield flush()
                held, words, octets, number = [], 0, 0, number + 1
        if held:
            yield flush()

    return split.mapInArrow(pack, f"block bigint, ids array<{key}>, sizes binary, codes binary, words array<string>")


def encode_words(placed: DataFrame, vocabulary: str) -> DataFrame:
    """(block, code, ids) from (block, code, word) sorted by word within partitions: each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoding(vocabulary)
        last: tuple[str, list[int]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ids = [last[1] if last and w == last[0] else bpe.encode_ordinary(w) for w in distinct]
            last = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())).take(coded.indices)], ["block", "code", "ids"])

    return placed.select("block", "code", "word").mapInArrow(encode, "block bigint, code int, ids array<int>")


def encode_corpus(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row, without special tokens; their strings are ordinary text.

    - An empty and a null text both give an empty list. Nothing is trimmed or normalised; texts are taken whole.
    - Every row gives a row: repeated ids come out as often as they go in, a null id stays null.
    - Other columns are not read. An empty table gives no rows.

    A word has one row for each block it occurs in, however often it occurs there, so even the commonest word has at
    most the share of one in a block's distinct words of what is shuffled. A block's words are at most BLOCK_WORDS.
    """
    vocabulary = vocabulary or default_vocabulary()
    key = texts.schema[id_col].dataType.simpleString()
    packed = write_cut(blocks(texts, id_col, text_col))
    placed = packed.select("block", F.posexplode("words").alias("code", "word")).repartition("word").sortWithinPartitions("word")
    known = encode_words(placed, vocabulary).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "ids"))).alias("known"))
    both = packed.select("block", "ids", "sizes", "codes").join(known.withColumn("known", F.col("known.ids")), "block", "left")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ids = batch.column(1).slice(i, 1).flatten(), batch.column(4).slice(i, 1).flatten()
                sizes, codes = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in (2, 3))
                ids = ids if len(ids) else pa.array([], pa.list_(pa.int32()))
                taken = ids.take(pa.array(codes))
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[bounds], pa.int32()), taken.values)
                yield pa.RecordBatch.from_arrays([keys, lists], ["doc_id", "ids"])

    return both.mapInArrow(unpack, f"doc_id {key}, ids array<int>")


def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, piece BINARY): the vocabulary, whose size is fixed, as a table."""
    ranks = read_ranks(vocabulary or default_vocabulary())
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, piece binary")


def decode_corpus(encoded: DataFrame, id_to_piece: DataFrame) -> DataFrame:
    """(doc_id, text): ids joined to their pieces, put together by position. An empty list gives an empty text."""
    spread = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    placed = spread.join(F.broadcast(id_to_piece), "id", "left")
    parts = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", F.hex("piece").alias("h")))))
    return placed.groupBy("doc_id").agg(F.decode(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")), "UTF-8").alias("text"))
