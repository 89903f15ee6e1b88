"""Problem 6: texts packed whole into containers of fixed capacity.

Bounded-space online best-fit.  A task keeps a fixed number of open bins; a bitset has bit f set while
some open bin has free space f, so the tightest bin for an item is the lowest set bit at or above its
size: one shift and one bit trick, whatever the number of bins.  If none fits and all are open, the
fullest bin closes.  Texts longer than a container are cut into full containers and a rest.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

CAPACITY = 2048
OPEN_BINS = 256
ITEMS_PER_TASK = 500_000


class OpenBins:
    """The bins of one stream: ``place(size)`` gives (bin, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free_bits, self.by_free, self.n_open, self.made = 0, {}, 0, 0

    def _put(self, bin_: int, free: int) -> None:
        if free == 0:
            self.n_open -= 1
            return
        self.by_free.setdefault(free, []).append(bin_)
        self.free_bits |= 1 << free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        if size == self.capacity:  # full at once, needs no open bin
            self.made += 1
            return self.made - 1, 0
        fitting = self.free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)  # the fullest closes
                self.n_open -= 1
            free, bin_ = self.capacity, self.made
            self.made += 1
            self.n_open += 1
        self._put(bin_, free - size)
        return bin_, self.capacity - free


def load_tokenizer(path: str):
    """A public tokenizer from its file: .tiktoken ranks, a tokenizers .json or a sentencepiece .model."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def token_counts(documents: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens), null for a null text.  ``tokenizer`` is a file's path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = iter(count([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else next(n) for t in texts], pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pack(sizes: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(doc_id, piece, container_id, start_token, n_tokens, place) from (doc_id, n_tokens).

    ``place`` is the token position within the container.  A text of at most ``capacity`` tokens is one
    piece; a longer one gives full containers and a rest.  A text of no tokens takes a place of no width in
    the container at hand.  A null size (no text) has a null container.  Repeated rows are separate items.
    Each task packs about ``items_per_task`` items (its bins left open at the end are the only extra loss);
    container_id is the task's number times 2^40 plus the bin's.
    """
    tasks = max(1, -(-sizes.count() // items_per_task))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("container_id", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for b in batches:
            rows = []
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n is None:
                    rows.append((doc, 0, None, 0, None, None))
                    continue
                start = piece = 0
                while n - start > capacity:
                    rows.append((doc, piece, base + bins.made, start, capacity, 0))
                    bins.made += 1
                    start, piece = start + capacity, piece + 1
                bin_, place = bins.place(n - start)
                rows.append((doc, piece, base + bin_, start, n - start, place))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ordered = sizes.repartition(tasks, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "n_tokens")
    return ordered.mapInArrow(run, "doc_id bigint, piece bigint, container_id bigint, start_token bigint, n_tokens bigint, place bigint")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Containers of whole texts; texts are tokenised where they are read, only ids and sizes move."""
    return pack(written(token_counts(documents, tokenizer), "sizes"), capacity, open_bins)
