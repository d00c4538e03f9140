"""Benchmark decontamination: passages query a BM25 index of test items, and what is retrieved is verified word by word.

Passages are windows of a document's words, long enough and overlapping enough that any stretch as long as the longest item lies
whole in one. Impacts are BM25 weights divided by the item's threshold, so every item is retrieved at a score of 1. The threshold is
the weight that must remain if the item passes verification, less as many of its heaviest words as verification may miss: nothing
that passes is lost.

Block-max WAND with that fixed threshold, for many passages at once. A passage is dropped where the sum of its terms' list maxima stays
below 1. WAND's pivot is the first item that the cursors before it can lift to the threshold; as impacts are known by item, its cursors
stand in the order of its weights, and a posting is a pivot if the lighter words of the item can't reach 1 without it and what is heavier.
Only pivot postings bring a passage to an item, all others are skipped. Then the item's block (neighbours of about its length) is dropped
where the block maxima of the passage's terms stay below 1, and only items of blocks that are left are scored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, whole_texts
from .tokens import ragged, slices

K1, B = 1.2, 0.75
SHINGLE, SIMILARITY = 5, 0.8
#: Words of the items of one index (a longer item has one alone), which bound its bytes, and items of one of its blocks. A larger
#: benchmark is queried index by index.
INDEX_WORDS, BLOCK_ITEMS = 1_500_000, 4
#: Cells (passages by terms) of the table that tells which terms a passage has.
CELLS = 1 << 24
PUNCTUATION = ".,;:!?\"'()[]{}*#"
#: What else words lose at their ends: all but letters, their marks and digits of any script. Words of nothing else stay as they are.
EDGES = r"^[^\pL\pM\pN]+|[^\pL\pM\pN]+$"
OUT = "doc_id long, item_id long, n_passages long, question_overlap double, answer_overlap double"


def words_flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words without punctuation around them, and where each text's begin. Words of punctuation alone are empty strings."""
    runs = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    offsets = runs.offsets.to_numpy()
    coded = runs.flatten().dictionary_encode()
    plain = pc.utf8_trim(coded.dictionary, PUNCTUATION)
    bare = pc.replace_substring_regex(plain, EDGES, "")
    trimmed = pc.if_else(pc.equal(bare, ""), plain, bare)
    words = pa.DictionaryArray.from_arrays(coded.indices, trimmed)
    return words, offsets - offsets[0]


def item_words(text: str | None) -> list[str]:
    words, _ = words_flat(pa.array([text or ""], pa.string()))
    return [w for w in words.to_pylist() if w]


def shingles(words: list) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def parts(words: list[str]) -> tuple[list[str], list[str]]:
    """An item without fields of its own: the last third is the answer, what comes before is the question."""
    at = len(words) - len(words) // 3
    return words[:at], words[at:]


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at begin and end where the next does; none may be empty."""
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0)


class Index:
    """An inverted index of test items: (item_id, question words, answer words). All its arrays are as long as the items' words at most.

    Where the parts aren't the items' own (``own``), an item is also found by its shingles as a whole.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], own: bool = True):
        items = sorted(items, key=lambda x: len(x[1]) + len(x[2]))
        self.ids, self.own = [i for i, _, _ in items], own
        words = [q + a for _, q, a in items]
        self.longest = max(map(len, words), default=0)
        df = Counter(w for x in words for w in set(x))
        mean = sum(map(len, words)) / max(1, len(words))
        self.value_set = pa.array(sorted(df), pa.string())
        code = {w: k for k, w in enumerate(self.value_set.to_pylist())}
        self.n_terms = len(code)
        self.words = [np.array([code[w] for w in x], np.int32) for x in words]
        self.question = [len(q) for _, q, _ in items]
        item, term, impact, pivot = [], [], [], []
        for n, x in enumerate(words):
            weight = {code[w]: math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for w, c in Counter(x).items()}
            missed = sum(int((1 - SIMILARITY) * len(p) + 1e-9) for p in self.parts(n))
            missed = max(missed, 0 if own else int((1 - SIMILARITY) * len(self.whole(n)) + 1e-9))
            terms = np.array(sorted(weight, key=weight.get), np.int64)  # the lightest first
            value = np.array([weight[t] for t in terms.tolist()])
            value /= value[: max(1, len(value) - missed)].sum()
            item += [n] * len(terms)
            term.append(terms)
            impact.append(value)
            pivot.append(np.cumsum(value) >= 1 - 1e-5)
        self.item = np.array(item, np.int64)
        self.term, self.impact = (np.concatenate(x) if x else np.zeros(0) for x in (term, impact))
        self.item_begin = np.searchsorted(self.item, np.arange(len(items) + 1))
        self.list_max = np.zeros(self.n_terms)
        if items:
            np.maximum.at(self.list_max, self.term, self.impact)
        posting = np.flatnonzero(np.concatenate(pivot)) if items else np.zeros(0, np.int64)
        posting = posting[np.argsort(self.term[posting], kind="stable")]
        self.pivot_item = self.item[posting]
        self.pivot_begin = np.searchsorted(self.term[posting], np.arange(self.n_terms + 1)) if items else np.zeros(1, np.int64)
        block = self.item // BLOCK_ITEMS
        order = np.lexsort((self.impact, self.term, block))
        last = np.append((np.diff(block[order]) != 0) | (np.diff(self.term[order]) != 0), True)[: len(order)]
        self.block_term, self.block_max = self.term[order][last], self.impact[order][last]
        self.block_begin = np.searchsorted(block[order][last], np.arange(-(-len(items) // BLOCK_ITEMS) + 1))

    def parts(self, n: int) -> tuple[set[tuple], set[tuple]]:
        """Shingles of an item's question and answer, in term numbers."""
        words, at = self.words[n].tolist(), self.question[n]
        return shingles(words[:at]), shingles(words[at:])

    def whole(self, n: int) -> set[tuple]:
        return shingles(self.words[n].tolist())

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) pairs that score 1 or more; passage and term are distinct pairs, sorted by passage."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begins = np.flatnonzero(np.append(True, np.diff(passage) != 0)[: len(passage)])
        sizes = np.diff(np.append(begins, len(passage)))
        hope = _sums(self.list_max[term], begins) >= 1 - 1e-5
        begins, sizes = begins[hope], sizes[hope]
        rows = max(1, CELLS // max(1, self.n_terms))
        for k in range(0, len(begins), rows):
            b, n = begins[k : k + rows], sizes[k : k + rows]
            found.append(self._retrieve(passage[b], np.repeat(np.arange(len(b)), n), term[ragged(b, n)]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _retrieve(self, owner: np.ndarray, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.pivot_begin[term + 1] - self.pivot_begin[term]
        blocks = -(-len(self.ids) // BLOCK_ITEMS)
        met = np.unique(np.repeat(row, n) * blocks + self.pivot_item[ragged(self.pivot_begin[term], n)] // BLOCK_ITEMS)
        row_of, block = met // blocks, met % blocks
        has = np.zeros((len(owner), self.n_terms), bool)
        has[row, term] = True
        n = self.block_begin[block + 1] - self.block_begin[block]
        at = ragged(self.block_begin[block], n)
        alive = _sums(np.where(has[np.repeat(row_of, n), self.block_term[at]], self.block_max[at], 0.0), np.cumsum(n) - n) >= 1 - 1e-5
        row_of, first = row_of[alive], block[alive] * BLOCK_ITEMS
        n = np.minimum(BLOCK_ITEMS, len(self.ids) - first)
        row_of, item = np.repeat(row_of, n), ragged(first, n)
        n = self.item_begin[item + 1] - self.item_begin[item]
        at = ragged(self.item_begin[item], n)
        hit = _sums(np.where(has[np.repeat(row_of, n), self.term[at]], self.impact[at], 0.0), np.cumsum(n) - n) >= 1 - 1e-9
        return owner[row_of[hit]], item[hit]


def shares(words: list[int], runs: dict[int, set], found: list[set[tuple]]) -> list[float]:
    """Of each part of an item the share of its shingles that the words hold, 1 without any. A part of fewer words than a shingle is one
    run. ``runs`` keeps the words' runs by length; words that no item has are -1."""
    out = []
    for part in found:
        n = len(next(iter(part), ()))
        if n not in runs:
            runs[n] = set(zip(*(words[k:] for k in range(n))))
        out.append(len(part & runs[n]) / len(part) if part else 1.0)
    return out


def _search(index: Index, batch: pa.RecordBatch) -> list[tuple]:
    """Rows of OUT for the documents of a batch."""
    words, offsets = words_flat(batch.column("text"))
    if not index.ids or not len(words):
        return []
    keep = words.dictionary.to_numpy(zero_copy_only=False) != ""
    code = pc.index_in(words.dictionary, index.value_set).fill_null(-1).to_numpy()
    place = words.indices.to_numpy()
    real = keep[place]
    begins = np.concatenate([[0], np.cumsum(real)])[offsets]
    terms = code[place[real]]
    width = max(64, 2 * index.longest)
    stride = width - index.longest + 1
    sizes = np.diff(begins)
    n = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - width) // stride)), 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    start = begins[doc] + ragged(np.zeros(len(n), np.int64), n) * stride
    length = np.minimum(width, begins[doc + 1] - start)
    owner, term = np.repeat(np.arange(len(doc)), length), terms[ragged(start, length)]
    known = term >= 0
    distinct = np.unique(owner[known] * index.n_terms + term[known])
    found: dict[tuple[int, int], list] = {}
    as_whole: dict[tuple[int, int], list] = {}
    known_parts: dict[int, list] = {}
    last, inside, runs = -1, [], {}
    for p, item in zip(*(x.tolist() for x in index.retrieve(distinct // max(1, index.n_terms), distinct % max(1, index.n_terms)))):
        if item not in known_parts:
            known_parts[item] = [*index.parts(item), *([] if index.own else [index.whole(item)])]
        if p != last:
            last, inside, runs = p, terms[start[p] : start[p] + length[p]].tolist(), {}
        overlap = shares(inside, runs, known_parts[item])
        if min(overlap[:2]) >= SIMILARITY or max(overlap[2:], default=0) >= SIMILARITY:
            into = found if min(overlap[:2]) >= SIMILARITY else as_whole
            row = into.setdefault((int(doc[p]), item), [0, 0.0, 0.0])
            row[:] = [row[0] + 1, max(row[1], overlap[0]), max(row[2], overlap[1])]
    found = as_whole | found  # passages count by the parts where these are found, else by the whole
    ids = batch.column("doc_id").to_pylist()
    return [(ids[d], index.ids[i], *v) for (d, i), v in sorted(found.items())]


def indexes(benchmark: DataFrame):
    """The benchmark in indexes of INDEX_WORDS words at most; items without words are left out, as no passage can hold them."""
    own = {"question", "answer"} <= set(benchmark.columns)
    columns = [F.col("item_id").cast("long").alias("item_id"), *([F.col("question").cast("string"), F.col("answer").cast("string")] if own else [F.col("text").cast("string")])]
    block, n = [], 0
    for row in benchmark.select(*columns).toLocalIterator():
        question, answer = (item_words(row["question"]), item_words(row["answer"])) if own else parts(item_words(row["text"]))
        if block and n + len(question) + len(answer) > INDEX_WORDS:
            yield Index(block, own)
            block, n = [], 0
        if question or answer:
            block.append((row["item_id"], question, answer))
            n += len(question) + len(answer)
    yield Index(block, own)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs and item of which some passage holds at least SIMILARITY of the question's and of the answer's 5-word shingles.

    An item without these fields is also found by SIMILARITY of its shingles as a whole, as its parts are invented.
    ``item_id`` is the item's, ``n_passages`` counts such passages (they overlap), the overlaps are the greatest. Nulls: a null text
    is empty and matches nothing, null or empty items match nothing, a null doc_id or item_id stays null. Repeated rows match each,
    ties all count, empty tables on either side give an empty table, other columns are left behind. Very long texts are many passages.
    An index is shipped to the executors; INDEX_WORDS bound it, and further indexes are queried by all documents in turn.
    """
    spark, texts, out = docs.sparkSession, whole_texts(docs), None
    for index in indexes(benchmark):
        shipped = spark.sparkContext.broadcast(index)

        def search(batches, shipped=shipped):
            names = [x.split()[0] for x in OUT.split(", ")]
            for batch in batches:
                for part in slices(batch):
                    rows = _search(shipped.value, part)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 5, [pa.int64()] * 3 + [pa.float64()] * 2)], names)

        part = texts.mapInArrow(search, OUT)
        out = part if out is None else out.union(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they stand, of which no passage holds an item as ``contaminated`` has it.

    Rows are judged by their texts alone, so ids that are null or recur don't matter. A null text stays; so does everything where
    the benchmark is empty.
    """
    spark, names, text = docs.sparkSession, docs.columns, docs.columns.index("text")
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # mapInArrow takes no names with dots
    for index in indexes(benchmark):
        shipped = spark.sparkContext.broadcast(index)

        def sift(batches, shipped=shipped):
            for batch in batches:
                for part in slices(batch, batch.schema.names[text]):
                    texts = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column(text)], ["doc_id", "text"])
                    keep = np.ones(part.num_rows, bool)
                    keep[[row[0] for row in _search(shipped.value, texts)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs.toDF(*names)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
