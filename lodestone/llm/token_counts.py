"""Token counts by section: a whole document is encoded once, and its tokens' character spans are joined to its sections' spans.

A token belongs to the section that holds its first character. So a token that crosses a boundary counts once, for the section it
starts in, and ``crossing`` says how many of a section's tokens end beyond it. Of sections that overlap the one that starts last has
the token, of those that start together the one that ends first, then the one named first. A token that starts inside a character (a
byte-level token may begin with its later bytes) starts at that character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .tokens import byte_encoder, vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
OUT = "doc_id long, section int, name string, start long, end long, n_tokens long, crossing long, n_doc_tokens long, outside long"
SECTIONS = "array<struct<name:string,start:bigint,end:bigint>>"


def line_sections(text: str) -> list[dict]:
    """One section a line, its line feed included, in code points; no section in an empty text."""
    out, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if at < end:
            out.append({"name": "line", "start": at, "end": end})
        at = end
    return out


def attribute(text: str, starts: np.ndarray, stops: np.ndarray, encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Tokens and crossing tokens of each section (in any order), all tokens, and tokens in no section."""
    data = text.encode()
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids]) if len(ids) else np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    if len(raw) and raw.max() >= 0x80:  # bytes to characters: how many characters have begun up to a byte
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        first, last = begun[ends - sizes[ids] + 1] - 1, begun[ends]
    else:
        first, last = ends - sizes[ids] if len(ids) else ends, ends
    order = np.lexsort((-np.arange(len(starts)), -stops, starts))
    order = order[stops[order] > starts[order]]
    begin, stop = starts[order], stops[order]
    if np.all(stop[:-1] <= begin[1:]):
        owner = np.searchsorted(begin, first, side="right") - 1
        if len(order):
            owner[first >= stop[owner]] = -1
    else:  # what starts later lies over what starts before
        owner = np.full(len(first), -1)
        for k, (a, b) in enumerate(zip(np.searchsorted(first, begin).tolist(), np.searchsorted(first, stop).tolist())):
            owner[a:b] = k
    n, crossing, inside = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), owner >= 0
    n[order] = np.bincount(owner[inside], minlength=len(order))
    crossing[order] = np.bincount(owner[inside][last[inside] > stop[owner[inside]]], minlength=len(order))
    return n, crossing, len(ids), len(ids) - int(n.sum())


def _given(kind) -> bool:
    """Whether a column of that type holds sections."""
    inner = getattr(kind, "elementType", None)
    return inner is not None and {"name", "start", "end"} <= set(getattr(inner, "names", ()))


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row for each section of docs' column ``sections`` (array of structs with name, start, end in code points).

    ``section`` numbers them as they stand. Without that column, or where it is of another type and so means something else, sections
    are lines. Nulls: a null text is empty; null or empty sections leave one row with section -1 that carries the document's totals; a
    section that is null or lacks a bound, or that ends where it starts or before, holds no token; a null doc_id stays null. Repeated
    rows count each, ties and overlaps go by the rule above, very long texts are encoded whole, an empty table gives an empty table,
    other columns are left behind.
    """
    given = "sections" in docs.columns and _given(docs.schema["sections"].dataType)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = lambda x: F.struct(x["name"].cast("string").alias("name"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))
    sections = F.transform("sections", each) if given else F.lit(None).cast(SECTIONS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sections.alias("sections"))

    def count(batches):
        encoding, sizes = byte_encoder(path, pattern)
        bound = lambda found, key: np.array([-1 if x is None or x["start"] is None or x["end"] is None else x[key] for x in found], np.int64)
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sections"))):
                found = (found or []) if given else line_sections(text)
                n, crossing, total, outside = attribute(text, bound(found, "start"), bound(found, "end"), encoding, sizes)
                found = [x or {"name": None, "start": None, "end": None} for x in found]
                rows += [(doc_id, k, x["name"], x["start"], x["end"], a, c, total, outside) for k, (x, a, c) in enumerate(zip(found, n.tolist(), crossing.tolist()))]
                if not found:
                    rows.append((doc_id, -1, None, 0, 0, 0, 0, total, outside))
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6]
            names = [x.split()[0] for x in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names)

    return texts.mapInArrow(count, OUT)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary(VOCABULARY), public_tokenizers.PATTERN)
