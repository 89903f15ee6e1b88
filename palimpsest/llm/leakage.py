"""Problem 7: evaluation texts inside training texts.

The test items form generalised suffix automata over words.  Training texts are streamed through them
word by word; an automaton's state is the longest suffix of the text read so far that occurs in some
item, so each run shared with an item is seen with its full length.  The items are dealt into parts of
about PART_WORDS words (one part for an ordinary test suite); every part's automaton is built by a task,
goes to the executors by itself, and the corpus is streamed through one part after the other, so neither
the driver nor a worker ever holds more than one part, and the results are united.  The corpus is neither
shuffled nor collected.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

LEAST_WORDS = 12
PART_WORDS = 250_000
_WORD = re.compile(r"[^\W_]+")


class _Separators(dict):
    """Translation of every character that is no letter or digit to a blank, filled as characters turn up."""

    def __missing__(self, char: int) -> int:
        self[char] = to = char if chr(char).isalnum() else 32
        return to


_BLANKED = _Separators()


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text."""
    return text.lower().translate(_BLANKED).split()


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences; ``items[s]`` are the sequences holding state s."""

    def __init__(self, sequences: list[tuple[int, list[str]]], least: int = 1):
        """States shorter than ``least`` words keep no items: no report ever asks them."""
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        for item, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                while len(owners) < len(self.next):
                    owners.append(set())
                owners[last].add(item)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= least:
                owners[self.link[s]] |= owners[s]
        self.items = [tuple(sorted(o)) if self.length[s] >= least else () for s, o in enumerate(owners)]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def anchors(self, least: int) -> array:
        """For each state, the ancestor that holds its suffix of ``least`` words (itself or 0 if shorter)."""
        out = array("i", bytes(4 * len(self.link)))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= least:
                out[s] = out[self.link[s]] if self.length[self.link[s]] >= least else s
        return out

    def packed(self) -> SuffixAutomaton:
        """The finished automaton with numbers in arrays; only states with several ways on keep a dictionary."""
        self.only_word, self.only_to = array("i", [-1] * len(self.next)), array("i", bytes(4 * len(self.next)))
        self.ways = {}
        for s, edges in enumerate(self.next):
            if len(edges) == 1:
                self.only_word[s], self.only_to[s] = next(iter(edges.items()))
            elif edges:
                self.ways[s] = edges
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.items = {s: own for s, own in enumerate(self.items) if own}
        self.next = None
        return self

    def runs(self, words: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, matched, state) wherever the longest match that ends there has at least ``least`` words.

        A word of no item ends every match, so only stretches of ``least`` or more known words are walked.
        """
        link, length, word, to, ways, none = self.link, self.length, self.only_word, self.only_to, self.ways, {}
        codes = list(map(self.ids.get, words))
        first = 0
        for stop in [*(i for i, w in enumerate(codes) if w is None), len(codes)]:
            start, first = first, stop + 1
            if stop - start < least:
                continue
            state = matched = 0
            for end in range(start, stop):
                w = codes[end]
                if word[state] == w:
                    state, matched = to[state], matched + 1
                elif (far := ways.get(state, none).get(w)) is not None:
                    state, matched = far, matched + 1
                else:
                    state = link[state]
                    while state >= 0 and word[state] != w and w not in ways.get(state, none):
                        state = link[state]
                    if state < 0:
                        state = matched = 0
                        continue
                    matched = length[state] + 1
                    state = to[state] if word[state] == w else ways[state][w]
                if matched >= least:
                    yield end + 1, matched, state


def item_parts(items: DataFrame, least: int = LEAST_WORDS, item: str = "item_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """(part, automaton): the automata of all items, pickled, built by one task a part and written.

    Items go to parts by a hash of their id.  A text of more than half a part is cut into stretches of that
    size which share ``least`` - 1 words, so that every run of ``least`` words stays whole in one of them (for
    such an item n_words of a span is the longest match within a stretch).  Null texts and ids have no part.
    """
    stretch = max(part_words // 2, 2 * least)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(value)
                for k in range(0, max(1, len(words) - least + 1), stretch):
                    own = words[k : k + stretch + least - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([k // stretch], pa.int64()), pa.array([" ".join(own)]), pa.array([len(own)], pa.int64())], names=["item", "stretch", "words", "n"])

    live = items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), text)
    pieces = written(live.mapInArrow(cut, "item bigint, stretch bigint, words string, n bigint").where(F.col("n") >= least), "items")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_parts = -(-total * 5 // (part_words * 4)) if total > part_words else 1  # a quarter of slack, as hashes deal unevenly

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "stretch", "words"])
        sam = SuffixAutomaton([(int(i), w.split()) for i, w in zip(pdf["item"], pdf["words"])], least).packed()
        sam.anchor = sam.anchors(least)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "automaton": [pickle.dumps(sam, protocol=5)]})

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "stretch"), F.lit(n_parts)))
    return written(dealt.groupBy("part").applyInPandas(build, "part bigint, automaton binary"), "automata")


class _Shared:
    """One part's automaton on its way to the workers, unpickled once a worker."""

    _held: tuple[str, SuffixAutomaton] | None = None

    def __init__(self, spark, automata: DataFrame, part: int):
        self.of, self.token = spark.sparkContext.broadcast(automata.where(F.col("part") == part).first()["automaton"]), uuid.uuid4().hex

    @property
    def value(self) -> SuffixAutomaton:
        if _Shared._held is None or _Shared._held[0] != self.token:
            _Shared._held = None
            _Shared._held = self.token, pickle.loads(bytes(self.of.value))
        return _Shared._held[1]


def _parts(automata: DataFrame) -> list[int]:
    return sorted(r["part"] for r in automata.select("part").collect())


def _batches(texts: Iterator[pa.RecordBatch]):
    for b in texts:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, doc: str = "doc_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, n_words): maximal runs of shared words, 1-based and inclusive.

    A span belongs to every item that holds its last ``least`` words anywhere along it; n_words is the
    longest match with any item of the part.  Null or short texts and items have no span; a null doc_id or
    item_id does not count; repeated items report once.  Empty tables give an empty result.
    """
    spark = documents.sparkSession
    automata = item_parts(items, least, part_words=part_words)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("n_words", pa.int32())])
    live = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint"), text)

    def scan(shared: _Shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam, rows = shared.value, []
            anchor = sam.anchor
            for key, value in _batches(batches):
                open_: dict[int, list[int]] = {}
                for end, matched, state in sam.runs(words_of(value), least):
                    for it in sam.items[anchor[state]]:
                        span = open_.get(it)
                        if span and span[1] == end - 1:
                            span[1], span[2] = end, max(span[2], matched)
                        else:
                            if span:
                                rows.append((key, it, *span))
                            open_[it] = [end - least + 1, end, matched]
                rows += [(key, it, *span) for it, span in open_.items()]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return live.mapInArrow(run, "doc_id bigint, item_id bigint, first_word int, last_word int, n_words int")

    parts, found = _parts(automata), spark.createDataFrame([], "doc_id bigint, item_id bigint, first_word int, last_word int, n_words int")
    for part in parts:
        shared = _Shared(spark, automata, part)
        if len(parts) == 1:
            return scan(shared)
        found = found.unionByName(written(scan(shared), "spans"))
        shared.of.destroy()
    return found


def without_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, most_share: float = 0.5, doc: str = "doc_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, clean_text, n_words, n_leaked, dropped): spans of ``least`` or more shared words cut out.

    ``dropped`` is true, and clean_text null, if more than ``most_share`` of the words were shared.
    A cut runs from the first character of its first word to the last of its last.  Null texts stay null.
    Each part of the items adds its spans to the row, the last one cuts.
    """
    spark = documents.sparkSession
    automata = item_parts(items, least, part_words=part_words)
    final = pa.schema([("doc_id", pa.int64()), ("clean_text", pa.string()), ("n_words", pa.int32()), ("n_leaked", pa.int32()), ("dropped", pa.bool_())])

    def places(value: str) -> list[tuple[int, int]]:
        # lower-casing can change the number of characters and of words, so words are located in the text as it stands
        return [(m.start(), m.end()) for m in _WORD.finditer(value) for _ in _WORD.findall(m.group().lower())]

    def united(spans: list[list[int]]) -> list[list[int]]:
        cut: list[list[int]] = []
        for a, b in sorted(spans):
            if cut and cut[-1][1] >= a:
                cut[-1][1] = max(cut[-1][1], b)
            else:
                cut.append([a, b])
        return cut

    def cleaned(value: str, n_words: int, cut: list[list[int]]) -> tuple[str | None, int, int, bool]:
        leaked = sum(b - a for a, b in cut)
        if not cut:
            return value, n_words, 0, False
        if leaked > most_share * n_words:
            return None, n_words, leaked, True
        out, pos, at = [], 0, places(value)
        for a, b in cut:
            out.append(value[pos : at[a][0]])
            pos = at[b - 1][1]
        return "".join([*out, value[pos:]]), n_words, leaked, False

    def scan(df: DataFrame, shared: _Shared | None, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = shared.value if shared else None
            for b in batches:
                rows = []
                for value, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = words_of(value) if value is not None else []
                    found = [[end - matched, end] for end, matched, _ in sam.runs(words, least)] if sam else []
                    cut = united([*map(list, zip(known[::2], known[1::2])), *found]) if found or known else []
                    rows.append((None, 0, 0, False) if value is None else cleaned(value, len(words), cut)) if last else rows.append([x for s in cut for x in s])
                if last:
                    yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], final.field(i + 1).type) for i in range(4)]], schema=final)
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "text", "spans"])

        return df.mapInArrow(run, "doc_id bigint, clean_text string, n_words int, n_leaked int, dropped boolean" if last else "doc_id bigint, text string, spans array<int>")

    df = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<int>").alias("spans"))
    parts = _parts(automata)
    for part in parts[:-1]:
        shared = _Shared(spark, automata, part)
        df = written(scan(df, shared, False), "marked")
        shared.of.destroy()
    return scan(df, _Shared(spark, automata, parts[-1]) if parts else None, True)


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """Distinct (doc_id, item_id) sharing a run of at least ``least`` consecutive words."""
    return leaked_spans(documents, items, least, part_words=part_words).select("doc_id", "item_id").distinct()
