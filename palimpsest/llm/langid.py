"""Problem 8: language labels of texts and of their segments, by prediction by partial matching.

One byte model a language: context trees of orders 0..``order`` with the symbol counts seen in training,
frozen afterwards.  A byte's code length is -log2 of its probability in the longest context that has seen
it, plus the escapes (PPM-C: distinct / (count + distinct), with exclusion of symbols already ruled out)
on the way down; below order 0 all 256 bytes are alike.  Contexts begin at a word's start, so a word's
code length depends on the word only: it is computed once per worker and kept, and a sentence costs a
dictionary look-up a word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 5
SAMPLE_DOCS = 300  # labelled rows a language, the bound of the training sample
ROUNDS = 3
LEAST_WORDS = 8
LEAST_CONFIDENCE = 0.9
LEAST_SCORED = 3
KEPT_WORDS = 200_000

# Names a label may have for each language.
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german"],
    "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish"],
    "pt": ["pt", "por", "portuguese"],
    "nl": ["nl", "nld", "dut", "dutch"],
}
# Labels that say nothing.
MISSING = ["", "und", "unknown", "n/a"]

_NAMES = {name: code for code, names in LABELS.items() for name in names}
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_BULLET = re.compile(r"^\s*(?:[-*•>]+|\d+[.)])\s+")
_HASHES = re.compile(r"^\s*#+")
_END = re.compile(r"[.!?…]+[\"“”»’')\]]*(?=\s|$)")
_QUOTE = re.compile(r"„[^„“”]{1,100}[“”]|“[^“”]{1,100}”|«[^«»]{1,100}»|\"[^\"]{1,100}\"")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NEUTRAL = re.compile(r"\S*?(?:\w[./_\\]\w|\d)\S*")
_CONTENT = re.compile(r"[^\W_]")
_HEAD = re.compile(r"[^\W_]\S*")
_MARKS = re.compile("[„“«\"]")
_BREAK = "\x1e"


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label (code, code with region, English name, any case); None if missing; other labels as they stand, lower-cased."""
    text = (label or "").strip().lower()
    if text in MISSING:
        return None
    return _NAMES.get(text) or _NAMES.get(re.split(r"[-_]", text)[0], text)


class ByteModel:
    """Context tree of one language: context -> (count + distinct, {symbol: count})."""

    def __init__(self, words: dict[str, int], order: int = ORDER):
        self.order = order
        seen: dict[bytes, Counter] = defaultdict(Counter)
        for w, n in words.items():
            data = b" " + w.encode() + b" "
            for i in range(1, len(data)):
                for k in range(min(order, i) + 1):
                    seen[data[i - k : i]][data[i]] += n
        self.contexts = dict(seen)
        self.totals = {c: sum(s.values()) for c, s in seen.items()}

    def bits(self, word: str) -> float:
        """Code length of a word and its end, given its start."""
        data, total = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(data)):
            total += self._symbol(data[max(0, i - self.order) : i], data[i])
        return total

    def _symbol(self, context: bytes, symbol: int) -> float:
        cost, gone = 0.0, set()
        for k in range(len(context) + 1):
            own = self.contexts.get(context[k:])
            if own is None:
                continue
            n = self.totals[context[k:]] - sum(own.get(x, 0) for x in gone)
            distinct = sum(1 for x in own if x not in gone)
            if distinct == 0:
                continue
            here = own.get(symbol, 0)
            if here:
                return cost - math.log2(here / (n + distinct))
            cost -= math.log2(distinct / (n + distinct))
            gone |= own.keys()
        return cost + math.log2(max(1, 256 - len(gone)))


class LanguageModels:
    """All languages.  Words get numbers; a table keeps the code length of every word in every language."""

    def __init__(self, words: dict[str, dict[str, int]], order: int = ORDER):
        self.codes = sorted(words)
        self.models = [ByteModel(words[c], order) for c in self.codes]
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[list[float]] = []
        self.tokens: dict[str, tuple[tuple[int, ...], int]] = {}
        self.table = np.zeros((0, len(self.codes)))

    def __getstate__(self):
        return {"codes": self.codes, "models": self.models}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def number(self, word: str) -> int:
        n = self.ids.get(word)
        if n is None:
            n = self.ids[word] = len(self.rows)
            self.rows.append([m.bits(word) for m in self.models])
        return n

    def token(self, token: str) -> tuple[tuple[int, ...], int]:
        """(numbers of the scored words of a blank-separated token, 1 if it has a letter or digit)."""
        got = self.tokens[token] = (tuple(map(self.number, scored_words(token))), int(bool(_CONTENT.search(token))))
        return got

    def tokenized(self, plain: str, into: list[int]) -> int:
        """Adds the sentence's word numbers to ``into`` and returns its number of tokens that are words."""
        kept, n = self.tokens, 0
        for t in plain.split():
            own = kept.get(t)
            if own is None:
                own = self.token(t)
            into += own[0]
            n += own[1]
        return n

    def judge(self, numbers: list[int], cuts: list[int]) -> tuple[list[int], list[float]]:
        """Best language (index) and its confidence for each run of numbers ``cuts[i]..cuts[i+1]``."""
        if len(self.table) < len(self.rows):
            self.table = np.vstack([self.table, np.array(self.rows[len(self.table) :])])
        n = len(cuts) - 1
        total = np.zeros((n, len(self.codes)))
        sizes = np.diff(cuts)
        full = np.nonzero(sizes)[0]
        if len(full):
            total[full] = np.add.reduceat(self.table[np.asarray(numbers)], np.asarray(cuts)[full], axis=0)
        best = total.argmin(axis=1)
        gap = total - total[np.arange(n), best][:, None]
        sure = 1.0 / np.exp2(-np.minimum(gap, 300.0)).sum(axis=1)
        sure[sizes == 0] = 0.0
        if len(self.rows) > KEPT_WORDS:
            self._forget()
        elif len(self.tokens) > KEPT_WORDS:
            self.tokens.clear()
        return best.tolist(), sure.tolist()

    def score(self, words: list[str]) -> tuple[str | None, float]:
        if not words or not self.codes:
            return None, 0.0
        best, sure = self.judge([self.number(w) for w in words], [0, len(words)])
        return self.codes[best[0]], sure[0]


def sentences(text: str) -> Iterator[tuple[int, int, bool, str]]:
    """(start, end, whole, plain): the sentences of a text with their places.

    Tags, headings, fenced lines, bullets and quotation marks of line starts, and short quotations are set
    to blanks (places stay).  A heading's line that holds a finished sentence of LEAST_WORDS words or more is
    text; a title before the sentence counts to it, as nothing marks where it ends.  A sentence runs over line
    ends within a paragraph or list item.  It is whole if it begins with a capital, a digit or an identifier
    and ends with a mark of its own.
    """
    flat = text.replace("\r", "\n") if "\r" in text else text
    if "<" in flat:
        flat = _TAG.sub(lambda m: "\n\n" + " " * (len(m[0]) - 2), flat)
    out, fenced = [], False
    for line in flat.split("\n"):
        bare = line.lstrip()[:3]
        if bare == "```":
            fenced = not fenced
            out.append(" " * len(line) + _BREAK)
        elif not fenced and bare[:1] == "#" and _has_sentence(line):
            if out:
                out[-1] = out[-1][:-1] + _BREAK
            mark = _HASHES.match(line)
            out.append(" " * mark.end() + line[mark.end() :] + " ")
        elif fenced or not bare or bare[0] == "#":
            out.append(" " * len(line) + _BREAK)
        elif bare[0] in "-*•>0123456789" and (mark := _BULLET.match(line)):
            if bare[0] != ">" and out:
                out[-1] = out[-1][:-1] + _BREAK
            out.append(" " * mark.end() + line[mark.end() :] + " ")
        else:
            out.append(line + " ")
    flat = "".join(out)
    if _MARKS.search(flat):
        flat = _QUOTE.sub(lambda m: " " * len(m[0]) if len(m[0].split()) < LEAST_WORDS else m[0], flat)
    at = 0
    for part in flat.split(_BREAK):
        pos = 0
        for m in _END.finditer(part):
            end = m.end()
            yield from _sentence(part[pos:end], at + pos, True)
            pos = end
        yield from _sentence(part[pos:], at + pos, False)
        at += len(part) + 1


def _has_sentence(line: str) -> bool:
    pos = 0
    for m in _END.finditer(line):
        if sum(1 for t in line[pos : m.end()].split() if _CONTENT.search(t)) >= LEAST_WORDS:
            return True
        pos = m.end()
    return False


def _sentence(plain: str, at: int, ended: bool) -> Iterator[tuple[int, int, bool, str]]:
    first = _HEAD.search(plain)
    if first:
        head = first[0]
        begins = head[0].isupper() or head[0].isdigit() or bool(_NEUTRAL.fullmatch(head))
        yield at + first.start(), at + len(plain.rstrip()), ended and begins, plain


def scored_words(plain: str) -> list[str]:
    """Lower-cased words without identifiers, paths and numbers."""
    return [w for token in plain.lower().split() if not _NEUTRAL.fullmatch(token) for w in _LETTERS.findall(token)]


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER, text: str = "text", lang: str = "lang", doc: str = "doc_id") -> LanguageModels:
    """Models from a bounded sample of labelled rows: ``sample_docs`` rows a language, by hash of the id, each text whole.

    Some labels are wrong and some texts mixed: see ``clean_models``.
    """
    names = sorted(_NAMES)
    base = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1)
    code = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(_NAMES[n]))])[base]
    pool = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(code.alias("code"), F.xxhash64(doc).alias("h"), F.col(text).alias("text")).where("code IS NOT NULL")
    # row_number below a constant: each task keeps sample_docs rows a language before the shuffle
    ranked = pool.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).where(F.col("rn") <= sample_docs)
    return clean_models([(r["code"], i % 2, scored_words(p)) for i, r in enumerate(sorted(ranked.select("code", "h", "text").collect(), key=lambda r: (r["code"], r["h"]))) for _, _, _, p in sentences(r["text"])], order)


def clean_models(sample: list[tuple[str, int, list[str]]], order: int = ORDER, rounds: int = ROUNDS) -> LanguageModels:
    """Models of (label, half, words) sentences whose labels are partly wrong.

    Each round every half is judged by models of the other half, which have not seen its errors, and only
    sentences that get their own label train the next round.
    """
    sample = [x for x in sample if len(x[2]) >= LEAST_SCORED]
    kept = sample
    for _ in range(rounds):
        judge = [LanguageModels(_counts([x for x in kept if x[1] != half]), order) for half in (0, 1)]
        kept = [x for half in (0, 1) for x, code in _judged(judge[half], [x for x in sample if x[1] == half]) if code == x[0]] or sample
    return LanguageModels(_counts(kept), order)


def _judged(model: LanguageModels, sample: list[tuple[str, int, list[str]]]) -> list[tuple[tuple[str, int, list[str]], str | None]]:
    if not sample or not model.codes:
        return [(x, None) for x in sample]
    numbers, cuts = [], [0]
    for x in sample:
        numbers += map(model.number, x[2])
        cuts.append(len(numbers))
    return [(x, model.codes[b]) for x, b in zip(sample, model.judge(numbers, cuts)[0])]


def _counts(sample: list[tuple[str, int, list[str]]]) -> dict[str, Counter]:
    words: dict[str, Counter] = defaultdict(Counter)
    for code, _, own in sample:
        words[code].update(own)
    return words


def segments(documents: DataFrame, models: LanguageModels, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, segment, start, end, n_chars, n_words, lang, confidence, whole): runs of sentences of one language.

    ``whole``: a sentence of LEAST_WORDS words or more in that language stands in the segment whole.
    Sentences that cannot be judged (fewer than LEAST_SCORED scored words or a confidence below
    LEAST_CONFIDENCE) join the run they stand in.  Null, blank and wordless texts have no segment.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("whole", pa.bool_())])

    def runs(found: list[tuple], codes: list[str]) -> Iterator[list]:
        run: list | None = None
        for a, b, whole, size, scored, best, sure in found:
            judged = scored >= LEAST_SCORED and sure >= LEAST_CONFIDENCE
            if run and (not judged or codes[best] == run[3]):
                run[1], run[2] = b, run[2] + size
                if judged:
                    run[4], run[6] = run[4] + sure * size, run[6] + size
                    run[5] = run[5] or (whole and size >= LEAST_WORDS)
            elif judged:
                if run:
                    yield run
                run = [a, b, size, codes[best], sure * size, whole and size >= LEAST_WORDS, size]
        if run:
            yield run

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            numbers, cuts, places, ends, rows = [], [0], [], [], []
            for value in batch.column(1).to_pylist():
                for a, b, whole, plain in sentences(value):
                    size = model.tokenized(plain, numbers)
                    places.append((a, b, whole, size, len(numbers) - cuts[-1]))
                    cuts.append(len(numbers))
                ends.append(len(places))
            found = [(*p, x, y) for p, x, y in zip(places, *model.judge(numbers, cuts))]
            for key, a, b in zip(batch.column(0).to_pylist(), [0, *ends], ends):
                rows += [(key, n, r[0], r[1], r[2], r[3], r[4] / max(1, r[6]), r[5]) for n, r in enumerate(runs(found[a:b], model.codes))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    live = documents.where(F.col(text).isNotNull()).select(F.col(doc).cast("bigint"), text)
    return live.mapInArrow(go, "doc_id bigint, segment int, start int, end int, n_words int, lang string, confidence double, whole boolean")


def label_column(lang: str = "lang"):
    """``label_code`` as a column."""
    low = F.lower(F.trim(lang))
    names = F.create_map(*[x for n in sorted(_NAMES) for x in (F.lit(n), F.lit(_NAMES[n]))])
    return F.when(low.isNull() | low.isin(MISSING), F.lit(None)).otherwise(F.coalesce(names[low], names[F.regexp_extract(low, "^([^-_]*)", 1)], low))


def document_languages(documents: DataFrame, models: LanguageModels, doc: str = "doc_id") -> DataFrame:
    """(doc_id, label, langs, main_lang, confidence, verdict) of every document.

    langs: the languages with a whole sentence, in order.  main_lang: the language of most words.
    verdict: ``mixed`` (two or more), ``missing`` or ``wrong`` (label), ``right``, ``none`` (no language counts).
    """
    seg = segments(documents, models, doc)
    per = seg.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("w"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("c"), F.max("whole").alias("whole"))
    found = per.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("lang")))).alias("langs"), F.max(F.struct("w", "lang", "c")).alias("m"))
    labels = documents.select(F.col(doc).cast("bigint").alias("doc_id"), label_column().alias("label"))
    n = F.size("langs")
    verdict = F.when(n >= 2, "mixed").when((n == 1) & F.col("label").isNull(), "missing").when((n == 1) & (F.col("label") != F.col("langs")[0]), "wrong").when(n == 1, "right").otherwise("none")
    out = labels.join(found, "doc_id", "left").withColumn("langs", F.coalesce("langs", F.array().cast("array<string>")))
    return out.select("doc_id", "label", "langs", F.col("m.lang").alias("main_lang"), F.coalesce(F.col("m.c"), F.lit(0.0)).alias("confidence"), verdict.alias("verdict"))


def language_cases(documents: DataFrame, models: LanguageModels) -> DataFrame:
    """(doc_id, lang): the languages of every mixed document and of every one whose label is missing or wrong."""
    return document_languages(documents, models).where("verdict IN ('mixed', 'missing', 'wrong')").select("doc_id", F.explode("langs").alias("lang"))
