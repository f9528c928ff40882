"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces. The histogram of piece lengths, which has as many entries as a sequence has
tokens, is packed alone: lengths are placed longest first, each into the packs that are shortest so far, by changing the
counts of packing patterns. The patterns are then joined back to the pieces by a piece's rank among those of its length.
"""

from __future__ import annotations

import heapq
import json
import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismlake.llm.common import copies, documents, kept, running, size_bins, with_computed

VOCABULARY = "byte_bpe_50k.json"
TOKENS, END = 2048, 1


def _ranks(path: str) -> tuple[dict[bytes, int], list[str]]:
    """The vocabulary file's tokens as bytes, whose ids are the ranks of their merges; and its special tokens' strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))
    special = [t["content"] for t in vocabulary["added_tokens"]]
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}, special


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level vocabulary, as little-endian 32-bit integers.

    Texts without a special token's string are encoded by tiktoken from the same file, at a quarter of the CPU time; the
    tests hold the two against each other. Others are encoded by the tokenizers library itself.
    """

    def __init__(self, path: str | None):
        path = path or str(public_tokenizers.path(VOCABULARY))
        ranks, self.special = _ranks(path)
        self.path, self.tokenizer = path, None
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_encoders: dict[str | None, Encoder] = {}


def encode(texts: list[str], path: str | None = None) -> list[bytes]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return [*map(_encoders[path], texts)]


@dataclass
class Slots:
    """Where the pieces of one length go: from rank `first` on, `each` in a sequence, from sequence and offset on."""

    first: list[int]
    each: list[int]
    sequence: list[int]
    offset: list[int]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[list[int]]]], int]:
    """Patterns (count, [[length, times], ...]) that hold each length as often as the histogram says; and their total count.

    There are at most 3 patterns for each length: a length splits one at most and opens two.
    """
    patterns: list[tuple[int, list[list[int]]]] = []
    free: dict[int, list[int]] = {}
    heap: list[int] = []

    def put(count: int, runs: list[list[int]], left: int, length: int, times: int) -> None:
        runs = [*map(list, runs)]
        if runs and runs[-1][0] == length:
            runs[-1][1] += times
        else:
            runs.append([length, times])
        patterns.append((count, runs))
        if left not in free:
            free[left] = []
            heapq.heappush(heap, -left)
        free[left].append(len(patterns) - 1)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while heap and not free[-heap[0]]:
                del free[-heapq.heappop(heap)]
            left = -heap[0] if heap else -1
            if left < length:
                times = capacity // length
                if n >= times:
                    put(n // times, [], capacity - times * length, length, times)
                if n % times:
                    put(1, [], capacity - n % times * length, length, n % times)
                break
            at = free[left].pop()
            count, runs = patterns[at]
            used = min(count, n)
            patterns[at] = (count - used, runs)
            if count > used:
                free[left].append(at)
            put(used, runs, left - length, length, 1)
            n -= used
    patterns = [p for p in patterns if p[0]]
    return patterns, sum(c for c, _ in patterns)


def slots_of(patterns: list[tuple[int, list[list[int]]]]) -> dict[int, Slots]:
    found: dict[int, Slots] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for count, runs in patterns:
        offset = 0
        for length, times in runs:
            s = found.setdefault(length, Slots([], [], [], []))
            s.first.append(rank.get(length, 0))
            s.each.append(times)
            s.sequence.append(sequence)
            s.offset.append(offset)
            rank[length] = rank.get(length, 0) + count * times
            offset += length * times
        sequence += count
    return found


def pack(docs: DataFrame, capacity: int = TOKENS, end: int = END, path: str | None = None) -> DataFrame:
    """A row for each piece of each of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: of the vocabulary's file where the executors see it; none: the public one that is installed there.

    A null or empty text is the end token alone. Rows of equal doc_id are packed each on its own; equal pieces of them are
    one row with a count until the last step, however many there are. Texts of any length are cut into pieces that fill a
    sequence, and a rest. No text is shuffled. An empty table gives an empty one. Columns other than doc_id and text are not
    read, whatever their names.
    """
    last = int(end).to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = []
        for ids in encode([t or "" for t in batch["text"].to_pylist()], path):
            ids += last
            n = len(ids) // 4
            pieces.append([{"start": at, "length": min(capacity, n - at), "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + capacity)]), "doc_tokens": n} for at in range(0, n, capacity)])
        return [pa.array(pieces, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")])))]

    cuts = with_computed(docs.select("doc_id", "text"), cut, "pieces array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>", drop=["text"])
    every = cuts.select("doc_id", F.inline("pieces"))
    pieces = kept(every.groupBy(*every.columns).agg(F.count("*").alias("n")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    bins = size_bins(pieces.count())
    binned = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(bins)))
    ranked = kept(running(binned, ["length"], "bin", [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")], F.col("n"), "first"), "ranked")
    each = copies(ranked, "n", "copy", sum(counts.values())).withColumn("rank", F.col("first") + F.col("copy"))
    table = {k: [np.array(x, np.int64) for x in (s.first, s.each, s.sequence, s.offset)] for k, s in slots_of(shortest_pack_first(counts, capacity)[0]).items()}

    def place(batch: pa.RecordBatch) -> list[pa.Array]:
        length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
        out = np.empty((2, len(length)), np.int64)
        for k in np.unique(length):
            rows = np.flatnonzero(length == k)
            first, each, sequence, offset = table[int(k)]
            at = np.searchsorted(first, rank[rows], side="right") - 1
            into = rank[rows] - first[at]
            out[0, rows] = sequence[at] + into // each[at]
            out[1, rows] = offset[at] + into % each[at] * k
        return [pa.array(out[0]), pa.array(out[1])]

    return with_computed(each.drop("bin", "n", "first", "copy"), place, "sequence_id bigint, offset bigint", drop=["rank"])


def op9_pack(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
