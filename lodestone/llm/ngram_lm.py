"""A trigram language model in Elias-Fano tries, learnt and queried in shards.

Tokens are lower-case words and an end; START stands before a text. Estimates are Dirichlet-smoothed, each order over the one below:
p1(w) = (c(w) + 1/2) / (N + (V + 1) / 2), p(w | v) = (c(vw) + m2 p1(w)) / (c(v) + m2), p(w | uv) = (c(uvw) + m3 p(w | v)) / (c(uv) + m3).
They add up to one over V words and one unknown word.

A chunk of documents first asks shards for the numbers and counts of its distinct words (told apart by 64 bits); frequent words have
small numbers. Then it sends its distinct trigrams, as numbers and so exactly, to the shard of their last word, with what its
training documents count of them, and hears the counts of the bigrams, which are the contexts of other trigrams; those it sends after.
A shard then builds its trie: last words, the words before them, the words before those. A node holds the quantised log10 of
its n-gram's smoothed probability. Each trigram that was asked for goes down the trie as far as it leads, and takes the payload found
there, times m / (c + m) of each context that is longer. The chunk hears one quantised probability a distinct trigram, and adds up.

A chunk sends each distinct trigram once, and those of a frequent word are dealt by the word before it too, so none makes a hot shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .elias_fano import Trie
from .exchange import Exchange, in_order, mix, packed, split_by_shard, steps, unpacked, word_hashes
from .tokens import ragged

#: Weight, in counts, of the order below.
M2, M3 = 2000.0, 2.0
#: Codes a decade of a quantised probability.
DECADE = 2048
HELD_OUT = 1
END = np.uint64(0xC949D7C7509E6557)
#: The number of what stands before a text; words have greater ones, below 2**WORD_BITS.
START, WORD_BITS = 0, 40
ODD, ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: Numbers of words whose counts a shard looks up in a table.
FREQUENT = 1 << 16
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == HELD_OUT


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as codes: how far below 1, in parts of a decade; what is less than any code stands for is the last."""
    return np.minimum(np.rint(-np.log10(p) * DECADE), 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (-codes.astype(np.float64) / DECADE)


def unigram(count: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
    return (count + 0.5) / (n_tokens + 0.5 * (n_words + 1))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them."""
    order, ranked = in_order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


class Tokens:
    """The tokens of a chunk's documents in a row."""

    def __init__(self, table: pa.Table):
        texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        words, begins = word_hashes(texts, lower=True)
        n = len(begins) - 1
        self.starts, self.sizes = begins[:-1] + np.arange(n), np.diff(begins) + 1
        self.words, self.place = _distinct(np.insert(words, begins[1:], END) if n else words)
        self.held_out = np.array([_is_held_out(i) for i in table.column("doc_id").to_pylist()], bool)
        self.train = np.repeat(~self.held_out, self.sizes)


class Trigrams:
    """The distinct bigrams and trigrams of a chunk that has heard what its words count, in the order they are sent to shards.

    A trigram goes to the shard of its last word, or where that is more frequent than a quarter of a shard's tokens, of its last two.
    """

    def __init__(self, table: pa.Table, bodies: dict[int, bytes], slots: tuple[int, ...]):
        self.text = text = Tokens(table)
        self.told = {shard: unpacked(b) for shard, b in bodies.items()}
        head = np.array([t[0] for t in self.told.values()], np.int64).reshape(-1, 3)
        self.n_docs, self.n_tokens, self.n_words = int(head[:, 0].max(initial=0)), int(head[:, 1].max(initial=0)), int(head[:, 2].sum())
        self.shards = split_by_shard(text.words, slots)
        count = self.heard(1)
        self.token_count, d, n = count[text.place], len(text.words) + 1, len(slots)
        last = text.place + 1  # 0 is what stands before a text
        before = np.append(0, last)[: len(last)]
        before[text.starts] = 0
        earlier = np.append(0, before)[: len(last)]
        earlier[text.starts] = 0
        bits = d.bit_length()
        pairs, self.pair_of = _distinct((last << bits) | before)
        trigrams, self.of = _distinct((self.pair_of << bits) | earlier)
        pair_of = trigrams >> bits
        self.last, self.before, self.earlier = pairs >> bits, pairs & ((1 << bits) - 1), trigrams & ((1 << bits) - 1)
        self.counted = np.bincount(self.of, text.train, len(trigrams)).astype(np.uint32)
        begin = np.append(np.flatnonzero(np.append(True, pair_of[1:] != pair_of[:-1])[: len(pair_of)]), len(pair_of))
        words = np.append(np.uint64(0), text.words)
        spread = np.append(0, count)[self.last] * 4 * n > self.n_tokens
        place = mix(words[self.last] * ODD + np.where(spread, words[self.before], np.uint64(0)))
        shard = ((place >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        self.pairs = np.argsort(shard.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")  # in the order they are sent
        self.sizes = np.diff(begin)[self.pairs]
        self.trigrams = ragged(begin[:-1][self.pairs], self.sizes)
        of_pair = np.searchsorted(shard[self.pairs], np.arange(n + 1))
        of_trigram = np.append(0, np.cumsum(self.sizes))[of_pair]
        self.bounds = [(slots[k], *of_pair[k : k + 2].tolist(), *of_trigram[k : k + 2].tolist()) for k in range(n)]

    def heard(self, k: int) -> np.ndarray:
        """The k-th array that shards sent for the chunk's distinct words."""
        return np.concatenate([np.zeros(0, np.int64), *(self.told[shard][k][: b - a].astype(np.int64) for shard, a, b in self.shards if b > a)])

    def contexts(self, bodies: dict[int, bytes]) -> np.ndarray:
        """For each distinct trigram the count of its first two words."""
        count = np.zeros(len(self.pairs), np.int64)
        for shard, a, b, _, _ in self.bounds:
            count[self.pairs[a:b]] = unpacked(bodies[shard])[0]
        context = np.append(0, count[self.pair_of])[: len(self.pair_of)]
        context[self.text.starts] = self.n_docs
        out = np.zeros(len(self.earlier), np.int64)
        out[self.of] = context
        return out


def _word_questions(table: pa.Table, slots):
    text = Tokens(table)
    counts = np.bincount(text.place, text.train, len(text.words)).astype(np.uint32)
    head = np.array([np.count_nonzero(~text.held_out), np.count_nonzero(text.train)], np.int64)
    for shard, a, b in split_by_shard(text.words, slots):
        yield shard, packed(head, steps(text.words[a:b]), counts[a:b])


class Words:
    """What all chunks asked a shard about words: the distinct ones, their counts, and where each chunk's stand among them."""

    def __init__(self, bodies: list[bytes]):
        parts = [unpacked(b) for b in bodies]
        asked = [np.cumsum(p[1], dtype=np.uint64) for p in parts]
        self.distinct, place = _distinct(np.concatenate(asked))
        self.counts = np.bincount(place, np.concatenate([p[2] for p in parts]), len(self.distinct)).astype(np.int64)
        self.head = np.append(sum(p[0] for p in parts), np.count_nonzero(self.counts))
        self.of_chunks = np.split(place, np.cumsum([len(x) for x in asked])[:-1])


def _count_answers(bodies: list[bytes]) -> list[bytes]:
    """Totals, and the count of each word."""
    words = Words(bodies)
    return [packed(words.head, words.counts[at].astype(np.uint64)) for at in words.of_chunks]


def _number_answers(bodies: list[bytes], n_shards: int, shard: int) -> list[bytes]:
    """The same, and the number of each word: the smaller the more frequent in this shard, and no other shard's. So counts follow from
    numbers by a short table (how many words have the greatest count, and so on), which goes to one chunk, for it to pass on."""
    words = Words(bodies)
    order = np.lexsort((words.distinct, -words.counts))
    number = np.empty(len(order), np.uint64)
    number[order] = np.arange(len(order), dtype=np.uint64) * np.uint64(n_shards) + np.uint64(shard + 1)
    ranked = words.counts[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
    table = [np.full(len(first), shard, np.uint32), np.append(first[1:], len(ranked))[: len(first)].astype(np.uint64), ranked[first].astype(np.uint64)]
    none = [x[:0] for x in table]
    carrier = shard % len(bodies)
    return [packed(words.head, words.counts[at].astype(np.uint64), number[at], *(table if k == carrier else none)) for k, at in enumerate(words.of_chunks)]


def _trigram_questions(table: pa.Table, bodies: dict[int, bytes], slots):
    chunk = Trigrams(table, bodies, slots)
    head = np.array([chunk.n_docs, chunk.n_tokens, chunk.n_words], np.int64)
    number = np.append(START, chunk.heard(2)).astype(np.uint64)
    passed = [np.concatenate(x) for x in zip(*(t[3:6] for t in chunk.told.values()))]
    last, before = chunk.last[chunk.pairs], chunk.before[chunk.pairs]
    for shard, a, b, c, d in chunk.bounds:
        first = np.flatnonzero(np.append(True, np.diff(last[a:b]) != 0)[: b - a])
        of_trigram = chunk.trigrams[c:d]
        yield shard, packed(
            head, number[last[a:b][first]], np.diff(np.append(first, b - a)).astype(np.uint32), number[before[a:b]], chunk.sizes[a:b].astype(np.uint32),
            number[chunk.earlier[of_trigram]], chunk.counted[of_trigram], *passed,
        )


class Asked:
    """What all chunks sent a shard: distinct last words, pairs and trigrams, each with its parent's place, and where each chunk's stand among them."""

    def __init__(self, bodies: list[bytes], n_shards: int):
        parts = [unpacked(b) for b in bodies]
        self.n_docs, self.n_tokens, self.n_words = (int(x) for x in parts[0][0])
        self.parts, self.n_shards = parts, np.uint64(n_shards)
        before, first = self.join(3), self.join(5)
        self.bits = np.uint64(int(max(before.max(initial=0), first.max(initial=0))).bit_length())
        self.words, at = _distinct(self.join(1))
        pairs, pair_at = _distinct((np.repeat(at, self.join(2)).astype(np.uint64) << self.bits) | before)
        self.pair_word, self.before = (pairs >> self.bits).astype(np.int64), pairs & ((ONE << self.bits) - ONE)
        of, self.first, self.counted = np.repeat(pair_at, self.join(4)), first, self.join(6)
        self.pair_count = np.bincount(of, self.counted, len(pairs)).astype(np.int64)
        self.pair_at, self.pair_ends, self.of = pair_at, np.cumsum([0, *(len(p[3]) for p in parts)]), of
        self.trigram_ends = np.cumsum([0, *(len(p[5]) for p in parts)])

    def join(self, k: int) -> np.ndarray:
        return np.concatenate([p[k] for p in self.parts])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The counts of the last words, and of the words of the pairs before them; START counts the documents."""
        shift, n = np.uint64(WORD_BITS), self.n_shards
        ends, count = (self.join(7).astype(np.uint64) << shift) | self.join(8), self.join(9)
        order, ends = in_order(ends)
        count = count[order].astype(np.int64)

        def sought(number: np.ndarray) -> np.ndarray:
            out = np.full(len(number), self.n_docs)
            word = np.flatnonzero(number != START)
            which = number[word] - ONE
            shard = which % n
            at = np.searchsorted(ends, (shard << shift) | (which // n), side="right")
            out[word] = count[np.minimum(at, len(count) - 1)]
            return out

        frequent = sought(np.arange(min(FREQUENT, len(self.before)), dtype=np.uint64)) if len(count) else np.zeros(0, np.int64)

        def counts_of(number: np.ndarray) -> np.ndarray:
            """By table for most, as frequent words have small numbers."""
            rare = np.flatnonzero(number >= np.uint64(len(frequent)))
            if len(rare) == len(number):
                return sought(number)
            out = frequent[np.minimum(number, np.uint64(len(frequent) - 1)).astype(np.int64)]
            out[rare] = sought(number[rare])
            return out

        return counts_of(self.words), counts_of(self.before)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct trigrams the pair, the first word, the count; and the place of each that was sent."""
        distinct, at = _distinct((self.of.astype(np.uint64) << self.bits) | self.first)
        return (distinct >> self.bits).astype(np.int64), distinct & ((ONE << self.bits) - ONE), np.bincount(at, self.counted, len(distinct)).astype(np.int64), at


def _pair_answers(bodies: list[bytes], n_shards: int) -> list[bytes]:
    """The count of each pair."""
    asked = Asked(bodies, n_shards)
    counts = asked.pair_count[asked.pair_at].astype(np.uint64)
    return [packed(counts[a:b]) for a, b in zip(asked.pair_ends[:-1], asked.pair_ends[1:])]


def _context_questions(table: pa.Table, bodies: dict[int, bytes], pair_bodies: dict[int, bytes], slots):
    chunk = Trigrams(table, bodies, slots)
    context = chunk.contexts(pair_bodies)[chunk.trigrams].astype(np.uint64)
    for shard, _, _, c, d in chunk.bounds:
        yield shard, packed(context[c:d])


def build(asked: Asked, counts: tuple[np.ndarray, np.ndarray], pair: np.ndarray, first: np.ndarray, count: np.ndarray, context: np.ndarray) -> Trie:
    """The trie of the n-grams that were counted, with quantised smoothed probabilities."""
    word_count, before_count = counts
    p1 = unigram(word_count, asked.n_tokens, asked.n_words)
    p2 = (asked.pair_count + M2 * p1[asked.pair_word]) / (before_count + M2)
    p3 = (count + M3 * p2[pair]) / (context + M3)
    none = np.zeros(len(asked.words), np.int64)
    known = [word_count > 0, asked.pair_count > 0, count > 0]
    levels = []
    for keep, parent, word, p, at in zip(known, (none, asked.pair_word, pair), (asked.words, asked.before, first), (p1, p2, p3), (None, *known)):
        place = none if at is None else np.cumsum(at) - 1
        levels.append((place[parent[keep]], word[keep], quantised(p[keep])))
    return Trie(levels, WORD_BITS)


def _probabilities(bodies: list[bytes], context_bodies: list[bytes], n_shards: int) -> list[bytes]:
    """The quantised probability of each trigram that was sent, by the trie."""
    asked = Asked(bodies, n_shards)
    pair, first, count, at = asked.trigrams()
    context = np.zeros(len(pair))
    context[at] = np.concatenate([np.zeros(0), *(unpacked(b)[0].astype(np.float64) for b in context_bodies)])
    counts = asked.counts()
    trie = build(asked, counts, pair, first, count, context)
    none = np.zeros(len(asked.words), np.int64)
    word = trie.children(0, none, asked.words)
    two = trie.children(1, word[asked.pair_word], asked.before)
    three = trie.children(2, two[pair], first)
    found = lambda level, place: restored(trie.payload[level][place])
    p1 = np.full(len(word), unigram(0, asked.n_tokens, asked.n_words))
    p1[word >= 0] = found(0, word[word >= 0])
    p2 = p1[asked.pair_word] * M2 / (counts[1] + M2)
    p2[two >= 0] = found(1, two[two >= 0])
    p3 = p2[pair] * M3 / (context + M3)
    code = quantised(p3)
    code[three >= 0] = trie.payload[2][three[three >= 0]]
    code = code[at]
    return [packed(code[a:b]) for a, b in zip(asked.trigram_ends[:-1], asked.trigram_ends[1:])]


def _scores(table: pa.Table, bodies: dict[int, bytes], told: dict[int, bytes], slots) -> pa.Table:
    chunk = Trigrams(table, bodies, slots)
    text = chunk.text
    log = np.zeros(len(chunk.earlier))
    for shard, _, _, c, d in chunk.bounds:
        log[chunk.trigrams[c:d]] = unpacked(told[shard])[0] / -float(DECADE)
    base = np.log10(unigram(chunk.token_count, chunk.n_tokens, chunk.n_words))
    add = lambda x, kind: np.add.reduceat(x, text.starts, dtype=kind) if len(text.starts) else np.zeros(0, kind)
    columns = (table.column("doc_id"), pa.array(text.held_out), pa.array(text.sizes, pa.int64()), pa.array(add(chunk.token_count > 0, np.int64)), pa.array(np.full(len(text.sizes), chunk.n_tokens, np.int64)), pa.array(add(base, np.float64)), pa.array(add(log[chunk.of], np.float64)))
    return pa.table(dict(zip([x.split()[0] for x in OUT.split(", ")], columns)))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (trigram), log10, for each row of docs.

    Learns from rows whose crc32 of the id's digits leaves no remainder HELD_OUT by 5 (a null id counts as no digits) and scores all.
    Nulls: a null text is empty and has the end as its one token; a null doc_id stays null. Repeated rows and ties count and score each.
    Very long texts are scored whole, in the memory of their chunk. An empty table gives an empty table, without training rows every
    probability is 1, other columns are left behind.
    """
    x = Exchange(docs)
    slots, n = x.slots, x.n
    words = x.ask(lambda t: _word_questions(t, slots))
    numbers = x.answer(words, lambda b, shard: _number_answers(b, n, slots.index(shard)))
    counts = x.answer(words, lambda b, shard: _count_answers(b))
    trigrams = x.ask_again([numbers], lambda t, w: _trigram_questions(t, w, slots))
    pairs = x.answer(trigrams, lambda b, shard: _pair_answers(b, n))
    contexts = x.ask_again([counts, pairs], lambda t, w, p: _context_questions(t, w, p, slots))
    found = x.answer_both(trigrams, contexts, lambda b, c: _probabilities(b, c, n))
    return x.hear([counts, found], lambda t, w, f: _scores(t, w, f, slots), OUT)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
