"""Best-fit packing of token pieces by minimum bin slack.

Texts become ids of a public tokenizer, and the id 0 after them; what is longer than a sequence is cut
so that all pieces but the first are full. Only lengths matter for packing, and there are at most
`capacity` of them: the histogram of lengths is all the driver sees, however many pieces there are.
For each sequence a subset-sum table over the lengths still there (bit sets, one bit a sum) finds the
fullest combination that holds the longest piece left. That combination is then taken as often as its
pieces last, which is what the next searches would find again: so there are no more combinations than
lengths. Pieces are numbered within their length and joined to the combinations' ranges of numbers.

A null or empty text is the id 0 alone; a text of any length is encoded whole. Rows with one doc_id and the same text are packed each, with the
same piece numbers. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionforge.llm.common import positions, saved

CAPACITY, END = 2048, 0
#: Texts that are encoded in one call.
AT_ONCE = 64
#: The tokenizer, and the same vocabulary as ranks for a faster reader of it.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> Callable[[list[str]], list]:
    """The ids of texts by a public tokenizer file as it is, without special tokens added; their strings in a text are those tokens.

    Texts that hold a string of a special token are encoded by `tokenizers` itself. All others are
    encoded with the same ranks by `tiktoken`, which gives the same ids in two fifths of the time; with
    ranks None every text is encoded by `tokenizers`.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    plain = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if ranks is None:
        return plain
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lambda texts: [plain([t])[0] if any(s in t for s in special) else fast.encode_to_numpy(t, disallowed_special=()) for t in texts]


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what doesn't fill a sequence."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def tokenized(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids of each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode = encoder(vocabulary)
        for pdf in batches:
            out = []
            texts = (t or "" for t in pdf["text"])
            for doc_id, found in zip(pdf["doc_id"], itertools.chain.from_iterable(map(encode, itertools.batched(texts, AT_ONCE))), strict=True):
                ids = np.append(np.asarray(found, "<u4"), np.uint32(END)).astype("<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[start : start + length]
                    out.append((doc_id, piece, start, length, zlib.crc32(part.tobytes()), *([part.astype("int32")] if with_ids else [])))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of lengths (length: times) that leaves least slack and holds the longest length left.

    Bit s of the table is set if some combination sums to s. Lengths come in falling order, each with
    as many copies as there are, doubled up; the way back takes as few copies as it can of the
    shorter lengths, so long pieces go first.
    """
    longest = max(left)
    room = capacity - longest
    used = {longest: 1}
    lengths = sorted((n for n in left if n <= room and left[n] - (n == longest) > 0), reverse=True)
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in lengths:
        steps.append(reach)
        copies, k = min(left[n] - (n == longest), room // n), 1
        while copies > 0:
            k = min(k, copies)
            reach |= (reach << (k * n)) & mask
            copies -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for n, before in zip(reversed(lengths[: len(steps)]), reversed(steps), strict=True):
        times = 0
        while not before >> total & 1:
            total -= n
            times += 1
        if times:
            used[n] = used.get(n, 0) + times
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Rows (length, lo, sequence, offset): from number lo on, until the next row of this length, the pieces
    of the length stand at offset of sequences sequence, sequence + 1 and so on.

    Each use of a length in a combination that is taken n times covers n numbers, one for each sequence.
    """
    left, at, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        used = fullest(left, capacity)
        times = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            for _ in range(k):
                rows.append((n, at[n], sequence, offset))
                at[n] += times
                offset += n
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and the ids if asked for, of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    pieces = saved(tokenized(docs, capacity, with_ids, vocabulary))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("of", "lo", "sequence", "offset")])
    ranges = spark.createDataFrame(plan(counts, capacity), schema)
    numbered = positions(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], name="number")
    # a length's ranges are grouped in one row and searched in it: there are at most `capacity` such rows
    starts = ranges.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("lo", "sequence", "offset"))).alias("ranges"))
    out = numbered.join(F.broadcast(starts), F.col("length") == F.col("of"))
    cut = F.aggregate("ranges", F.lit(None).cast("struct<lo:bigint,sequence:bigint,offset:bigint>"), lambda best, r: F.when(r["lo"] <= F.col("number"), r).otherwise(best))
    out = out.withColumn("cut", cut)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return out.select(*cols, (F.col("cut.sequence") + F.col("number") - F.col("cut.lo")).alias("sequence_id"), F.col("cut.offset").alias("offset"), *["ids"] * with_ids)
