"""Operator 4: token counts by a separator scan over flat token files.

A flat token file is a sequence of token ids of fixed width in which an end-of-document id
follows each document; nothing says where documents begin. It is read as blocks of bytes.
Each block is searched for the separator with numpy and reports the tokens before its first
separator, between its separators and after its last one. A prefix scan over the blocks of
a file then stitches documents that cross borders: the documents that ended before a block
give its first ordinal, and the tokens left open before it belong to the first document that
ends in it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import bounded, written

#: Where the vocabulary of the default encoder lies, and its free id that ends a document.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: Bytes of a block. A multiple of every token width.
BLOCK = 1 << 20
#: Longest text that is encoded in one go; longer ones are cut before a space that follows a letter.
_PIECE = 1 << 16
#: Fixed value: how the vocabulary's encoder splits text before it merges bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_points(text: str, size: int = _PIECE) -> list[str]:
    """The text in parts that encode to the same tokens as the whole.

    A part may end only between a letter and a space before a letter, where the encoder's
    split always has a border.
    """
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def encoded(text: str, path: str = VOCABULARY) -> list[int]:
    encode = encoder(path).encode_ordinary
    if len(text) <= _PIECE:
        return encode(text)
    return [t for part in cut_points(text) for t in encode(part)]


def _flat_rows(path: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "tokens", "documents"]
        # The first document of a partition names its file.
        file, number, held, ids = None, 0, bytearray(), []

        def out(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int32()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names)

        for batch in batches:
            for place, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "text"))):
                file = place if file is None else file
                held += np.array([*encoded(text, path), end], "<u2").tobytes()
                ids.append(doc_id)
                while len(held) >= block:
                    yield out(bytes(held[:block]))
                    del held[:block]
                    number, ids = number + 1, []
        if held or ids:
            yield out(bytes(held))

    return run


def flat_files(docs: DataFrame, path: str = VOCABULARY, end: int = END_OF_DOCUMENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, block, tokens, documents): the documents as flat token files of 16-bit ids, in blocks.

    Each task writes the documents it reads into one file. ``documents`` lists the ids of
    the documents whose text was encoded into a block or across its border, in order; it is
    kept beside the tokens, so that counts can be told apart by id, and the scan never reads
    it. Written out. A null text is an empty document.
    """
    rows = bounded(docs).select(F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(_flat_rows(path, end, block), "file long, block int, tokens binary, documents array<long>"))


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, tokens) of flat token files in a folder; file is their path.

    Spark's binary reader takes a file as one value, so files must fit in a task; each is
    then cut into blocks.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("content") / block).cast("int") - 1, F.lit(0)))
    cut = files.select("file", "content", F.explode(blocks).alias("block"))
    return cut.select("file", "block", F.substring("content", F.col("block") * block + 1, F.lit(block)).alias("tokens"))


def _scan_rows(end: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for cell in batch.column("tokens"):
                tokens = np.frombuffer(cell.as_buffer(), kind)
                ends = np.flatnonzero(tokens == end)
                if len(ends):
                    row = (len(ends), int(ends[0]), (np.diff(ends) - 1).tolist(), len(tokens) - 1 - int(ends[-1]))
                else:
                    row = (0, 0, [], len(tokens))
                for x, value in zip(out, row):
                    x.append(value)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *(pa.array(x, t) for x, t in zip(out, types))], ["file", "block", "ends", "head", "inner", "tail"])

    return run


def separator_scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens): the tokens of each document of flat token files (file, block, tokens).

    Documents count from 0 in their file; separators are not counted as tokens. Tokens after
    the last separator of a file are one more document, unless there are none. Blocks are
    whole tokens, numbered from 0 without gaps; an empty file gives no document.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", "block", "tokens").mapInArrow(_scan_rows(end, width), f"file {kind}, block int, ends long, head long, inner array<long>, tail long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Tokens open at a block: those since the last block that had a separator.
    total = F.sum("tail").over(before)
    at_last = F.last(F.when(F.col("ends") > 0, F.col("through") - F.col("tail")), ignorenulls=True).over(before)
    scan = found.withColumn("through", F.sum("tail").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    scan = scan.select("*", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"), F.coalesce(total - F.coalesce(at_last, F.lit(0)), F.lit(0)).alias("open"))
    closed = scan.where("ends > 0").select("file", "first", F.posexplode(F.concat(F.array(F.col("open") + F.col("head")), "inner")).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")
    last = scan.groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("ends")).alias("ordinal"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("n_tokens")), "block").alias("rest"))
    rest = last.where("rest.n_tokens > 0").select("file", "rest.ordinal", "rest.n_tokens")
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, path: str = VOCABULARY, end: int = END_OF_DOCUMENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), one row for each row of docs, through flat token files.

    Null and empty texts have 0 tokens; null ids and repeated rows stay; an empty table
    gives an empty result; other columns are not read.
    """
    blocks = flat_files(docs, path, end, block, id_col, text_col)
    counts = separator_scan(blocks, end)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    listed = blocks.select("file", "block", "documents").withColumn("first", F.coalesce(F.sum(F.size("documents").cast("long")).over(before), F.lit(0)))
    names = listed.select("file", "first", F.posexplode("documents").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
