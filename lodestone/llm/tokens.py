"""Tokenizers of the public vocabulary files, as batch encoders over Arrow columns."""

from __future__ import annotations

import base64
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places [s, s + n) of every run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


#: Texts encoded at a time hold about so many bytes (a longer one goes alone), and new words are encoded so many at a time.
SLICE_BYTES, NEW_WORDS = 1 << 22, 4096


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """batch in runs of rows whose texts hold at most so many bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
        yield batch.slice(at, n)
        at += n


class WordEncoder:
    """Ids of whole texts under a word-level BPE, each distinct run of non-white-space encoded once.

    Sound where the tokenizer normalises, splits and merges within such runs, as ``word_bpe_49k.json`` does. Between ``most`` and twice
    as many runs are remembered, those that were met last, if they are no longer than LONGEST: what is remembered is bounded.
    """

    LONGEST = 64

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Each word's ids as 32-bit numbers."""
        out = list(map(self.known.get, words))
        for k in [k for k, x in enumerate(out) if x is None]:
            out[k] = self.older.get(words[k])
            if out[k] is not None:
                self._remember(words[k], out[k])
        new = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(new), NEW_WORDS):
            part = new[at : at + NEW_WORDS]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)):
                out[k] = array("I", e.ids).tobytes()
                self._remember(words[k], out[k])
        return out

    def _remember(self, word: str, ids: bytes) -> None:
        if len(word) <= self.LONGEST:
            if len(self.known) >= self.most:
                self.known, self.older = {}, self.known
            self.known[word] = ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by case
            texts = pc.ascii_lower(texts)
        runs = pc.ascii_split_whitespace(texts)
        coded = runs.flatten().dictionary_encode()
        found = self._encoded(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[place] if len(found) else np.zeros(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(found), np.uint32)[ragged(starts[place], lengths)] if len(found) else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        offsets = runs.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


_encoders: dict[str, object] = {}


def word_encoder(path: str) -> WordEncoder:
    """The process's encoder for that file (executors keep their Python workers)."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def byte_encoder(path: str, pattern: str):
    """A byte-level BPE and the byte length of each of its tokens."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]
