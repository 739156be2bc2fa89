"""Benchmark decontamination by template canonicalisation.

Words become template words: punctuation around them goes, letters become small, and
numbers, units and names become typed placeholders. A name is a capitalised word. Whether the
word that opens a sentence or line is a name cannot be told from its form, so in the
benchmark it has both forms, and its windows have a hash for each choice. All windows of five
template words (with at least two literal or opening ones) of the benchmark are hashed and
joined with those of each text. A document holds an item if at least ``SHARE`` of the item's
distinct windows are found in it, or a part of the item is: ``ALIGNED`` windows (13 words,
where they are in one run) or half of a shorter item's, ``LEAST`` of them at least, with the same
offset give or take a window. So an item with changed words or cut lines is held too.
In each case the slots must be consistent: along the matched
windows, one value of the item must always become the same value in the
document, for at least ``SHARE`` of the slots. So a question asked again with other
numbers or names is found, and prose that only shares a pattern is not.

The join is a broadcast hash join. The benchmark is read in blocks of at most
``MAX_WINDOWS`` windows; each block is one pass over the documents without any shuffle,
so memory is bounded however large the benchmark is, and every pair is tested.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from . import common

WINDOW, SHARE, MIN_LITERAL = 5, 0.8, 2
ALIGNED, LEAST = 9, 4
MAX_WINDOWS = 1_000_000
REMEMBERED = 400_000
_BATCH = 1 << 22
_TOKEN = re.compile(r"\n|" + common.WORD)
_NUMBER = re.compile(r"[+\-−]?[$€£¥]?\d[\d.,:/\-]*(?:st|nd|rd|th|%|[a-zA-Zµ°]{1,3})?[$€£¥]?$")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres mg g kg gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons ml l liter liters litre litres second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent % degree degrees mph kmh km/h watt "
    "watts volt volts byte bytes kb mb gb tb".split()
)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Templates:
    """Raw words to template words: hash, hash of the literal form, and flags.

    Flags: 1 ends a sentence, 2 is no word, 4 literal, 8 literal or a name.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = []

    def kind(self, word: str) -> tuple[str, str]:
        """The template word and its literal form, the same for a literal word and for a number or unit."""
        core = word.strip(".,;:!?\"'()[]{}«»„“”‘’…*_|<>#&~`")
        if not core or not any(c.isalnum() or c == "%" for c in core):
            return "", ""
        small = core.lower()
        if _NUMBER.match(core) or small in NUMBER_WORDS:
            return "<number>", "<number>"
        if small in UNITS:
            return "<unit>", "<unit>"
        return ("<name>" if core[0].isupper() and core[1:].islower() else small), small

    def add(self, word: str) -> int:
        import xxhash

        if word == "\n":
            row = 0, 0, 3
        else:
            form, small = self.kind(word)
            fixed = small in ("<number>", "<unit>")
            ends = word.rstrip("\"')]»”’")[-1:] in ".!?:;" and word != ""
            flags = ends + 2 * (not form) + 4 * (not fixed and form == small) + 8 * (not fixed)
            row = xxhash.xxh3_64_intdigest(form), xxhash.xxh3_64_intdigest(small), flags
        self.rows.append(row)
        self.number[word] = len(self.rows) - 1
        return len(self.rows) - 1

    def read(self, texts: list[str]):
        """Of the template words of all texts: text number, word, hash, literal form's hash, flags, start of a sentence; and the words."""
        if len(self.rows) > REMEMBERED:
            self.clear()
        words, texts_of, ids = [], [], []
        for i, text in enumerate(texts):
            found = _TOKEN.findall(text)
            found.append("\n")
            words += found
            texts_of.append(np.full(len(found), i, np.int64))
        get, add = self.number.get, self.add
        for w in words:
            at = get(w)
            ids.append(add(w) if at is None else at)
        table = np.array(self.rows, dtype=[("form", "u8"), ("small", "u8"), ("flags", "u1")])
        rows = table[np.array(ids, np.int64)]
        flags = rows["flags"]
        at = np.flatnonzero((flags & 2) == 0)
        # a mark that is no word passes on the start of a sentence: a word opens one if any mark since the word before it ends one
        ended = np.concatenate([[0], np.cumsum(flags & 1)])
        starts = np.ones(len(at), bool)
        starts[1:] = ended[at[1:]] > ended[at[:-1]]
        owner = np.concatenate(texts_of)[at] if texts else np.zeros(0, np.int64)
        return owner, at, rows["form"][at], rows["small"][at], flags[at], starts, words


def _windows(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all windows."""
    n = max(len(hashes) - WINDOW + 1, 0)
    windows = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            windows = (windows ^ (windows >> np.uint64(29))) * _P + hashes[k : k + n]
    return windows


def _value(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}«»„“”‘’…*_|<>#&~`").lower()


class Index:
    """Windows of some benchmark items."""

    def __init__(self, items: list[tuple[object, str]]):
        import xxhash

        self.ids = [i for i, _ in items]
        owner, at, forms, small, flags, starts, words = _Templates().read([t for _, t in items])
        first = np.searchsorted(owner, np.arange(len(items)))
        literal = ((flags & 4) > 0) | (starts & ((flags & 8) > 0))
        # a capitalised opening word is a slot too: it may be a name
        slot = ((flags & 4) == 0) & ~((flags & 8 > 0) & starts & (forms == small))
        self.slots = [slot[a:b] for a, b in zip(first, [*first[1:], len(owner)], strict=True)]
        self.values = [[_value(words[k]) for k in at[a:b]] for a, b in zip(first, [*first[1:], len(owner)], strict=True)]
        self.where: dict[int, list[tuple[int, int, int]]] = {}  # item, its word, window
        distinct: list[set[int]] = [set() for _ in items]
        own = _windows(np.where(starts, small, forms))
        name = np.uint64(xxhash.xxh3_64_intdigest("<name>"))
        n = len(own)
        twofold = starts & ((flags & 8) > 0)
        literals, choosing = (np.concatenate([[0], np.cumsum(x)]) for x in (literal, twofold))
        valid = (literals[WINDOW:] - literals[:-WINDOW] >= MIN_LITERAL) & (owner[:n] == owner[WINDOW - 1 :]) if n else np.zeros(0, bool)
        for p in np.flatnonzero(valid):
            i, h, span = int(owner[p]), int(own[p]), slice(p, p + WINDOW)
            distinct[i].add(h)
            # an opening word that is neither number nor unit has both forms
            kinds = {h}
            if choosing[p + WINDOW] > choosing[p]:
                choices = product(*((x, name) if two else (y,) for x, y, two in zip(small[span], forms[span], twofold[span], strict=True)))
                kinds = {int(_windows(np.array(c, np.uint64))[0]) for c in choices}
            for form in kinds:
                self.where.setdefault(form, []).append((i, int(p - first[i]), h))
        self.sizes = [len(x) for x in distinct]
        self.hashes = np.sort(np.fromiter(self.where, np.uint64, len(self.where)))

    @classmethod
    def of(cls, state: dict) -> Index:
        """The index with these attributes, all plain values, which need no package to be read."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def search(self, tool: _Templates, texts: list[str]) -> list[list[tuple[int, float, int, float, bool]]]:
        """For each text: (item, share of its windows, slots, consistent share, equal values) of each item that it holds."""
        found: list[list] = [[] for _ in texts]
        owner, at, forms, _, _, _, words = tool.read(texts)
        windows = _windows(forms)
        if not len(windows) or not len(self.hashes):
            return found
        place = np.minimum(np.searchsorted(self.hashes, windows), len(self.hashes) - 1)
        hits = np.flatnonzero((self.hashes[place] == windows) & (owner[: len(windows)] == owner[WINDOW - 1 :]))
        bounds = np.searchsorted(owner[hits], np.arange(len(texts) + 1))
        for t in np.flatnonzero(np.diff(bounds)):
            matched: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
            for p in hits[bounds[t] : bounds[t + 1]]:
                for item, q, h in self.where[int(windows[p])]:
                    matched[item][h].append((int(p), q))
            for item, by_hash in matched.items():
                share = len(by_hash) / self.sizes[item]
                if share >= SHARE or self._aligned(by_hash) >= max(LEAST, min(ALIGNED, (self.sizes[item] + 1) // 2)):
                    slots, consistent, equal = self._slots(item, by_hash, at, words)
                    if consistent >= SHARE:
                        found[t].append((item, share, slots, consistent, equal))
        return found

    @staticmethod
    def _aligned(by_hash: dict) -> int:
        """Most distinct windows on one diagonal and those at most a window beside it."""
        if len(by_hash) < LEAST:
            return 0
        on: dict[int, set[int]] = defaultdict(set)
        for h, found in by_hash.items():
            for p, q in found:
                on[p - q].add(h)
        main = max(on, key=lambda d: (len(on[d]), -d))
        return len(set().union(*(on.get(main + k, ()) for k in range(-WINDOW, WINDOW + 1))))

    def _slots(self, item: int, by_hash: dict, at: np.ndarray, words: list[str]) -> tuple[int, float, bool]:
        """Slots along the matches, on the diagonal with most windows and those beside it."""
        pairs = [pair for found in by_hash.values() for pair in found]
        main = Counter(p - q for p, q in pairs).most_common(1)[0][0]
        aligned: dict[int, int] = {}
        for p, q in sorted(pairs, key=lambda x: (abs(x[0] - x[1] - main), x)):
            for k in range(WINDOW):
                if self.slots[item][q + k]:
                    aligned.setdefault(q + k, p + k)
        if not aligned:
            return 0, 1.0, True
        uses: dict[str, Counter] = defaultdict(Counter)
        for q, p in aligned.items():
            uses[self.values[item][q]][_value(words[at[p]])] += 1
        agree = sum(c.most_common(1)[0][1] for c in uses.values())
        return len(aligned), agree / len(aligned), all(set(c) == {v} for v, c in uses.items())


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the distinct items with a text, in blocks that bound memory."""
    items, size = [], 0
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    for row in rows.toLocalIterator():
        items.append((row["item_id"], row["text"]))
        size += row["text"].count(" ") + row["text"].count("\n") + 1
        if size >= MAX_WINDOWS:
            yield Index(items)
            items, size = [], 0
    if items:
        yield Index(items)


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = [t or "" for t in batch.column(text).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BATCH or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def find(documents: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds.

    Columns: those of documents but the text, then item_id, window_share, n_slots,
    slot_share and same_values (false for a re-parameterised item). A null or empty
    text holds nothing. An item of fewer than five template words, or of placeholders
    only, has no window and is never held; a null item_id is an id like any other,
    and repeated items count once. Repeated documents are reported each. Columns named
    like added ones are replaced. Without documents or items the result is empty.
    """
    added = (("window_share", DoubleType()), ("n_slots", LongType()), ("slot_share", DoubleType()), ("same_values", BooleanType()))
    names = ["item_id", *(n for n, _ in added)]
    out = [c for c in documents.columns if c not in names and c != text]
    schema = documents.select(*out).schema.add("item_id", benchmark.schema["item_id"].dataType)
    for name, kind in added:
        schema = schema.add(name, kind)
    ids = pa.int64() if schema["item_id"].dataType != StringType() else pa.string()

    def searched(index: Index) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool, items = _Templates(), Index.of(shared.value)
            for batch in batches:
                for part, texts in _parts(batch, text):
                    found = [(i, *hit) for i, hits in enumerate(items.search(tool, texts)) for hit in hits]
                    if found:
                        rows, which, *measures = zip(*found, strict=True)
                        kinds = (pa.float64(), pa.int64(), pa.float64(), pa.bool_())
                        made = [pa.array([items.ids[k] for k in which], ids), *map(pa.array, measures, kinds)]
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in out), *made], names=[*out, *names])

        return documents.select(*out, text).mapInArrow(common.lean(run), schema)

    found = [searched(index) for index in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else documents.sparkSession.createDataFrame([], schema)


def clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of documents that hold no benchmark item, as they are; see find()."""
    columns, schema = documents.columns, documents.schema
    scratch = common.Scratch(documents.sparkSession, "clean")
    for block, index in enumerate(_blocks(benchmark)):
        if block:  # written, so that no task holds two blocks
            documents = scratch.write(documents, f"block{block}")
        shared = documents.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tool, items = _Templates(), Index.of(shared.value)
            for batch in batches:
                for part, texts in _parts(batch, text):
                    yield part.filter(pa.array([not hits for hits in items.search(tool, texts)], pa.bool_()))

        documents = documents.select(*columns).mapInArrow(common.lean(run), schema)
    return documents


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(documents, common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5}
