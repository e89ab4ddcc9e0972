"""Token counts of fields and sections, from one encoding of the whole document.

Encoding a section by itself gives other tokens at its edges than the document has.  Here a
document is encoded once, every token has its span of bytes, and sections are joined to the
tokens by interval: two binary searches for each section, over the tokens' owning places.

A token that crosses a boundary goes to the section that holds
    first   its first character,
    last    its last character,
    middle  its middle byte (of an even number the left one), or
    split   each section in proportion to the bytes in it.
Under every rule the counts of sections that tile a document sum to its tokens.  Sections may
overlap or leave gaps: each counts for itself, and tokens that no section owns are reported as
section -1.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "middle", "split")
Spans = Sequence[tuple[int, int]]


@cache
def _encoding(path: str | None = None) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the bytes of each token; one a worker process."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    named = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return named, sizes


def line_spans(text: str) -> Spans:
    """Lines with their line feeds, as character spans that tile the text; an empty text has none."""
    out, at = [], 0
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        if end > at:
            out.append((at, end))
        at = end
    return out


def attribute(text: str, spans: Spans, rule: str = "first", path: str | None = None):
    """(tokens of each span, tokens that cross an edge of it, tokens of no span, all tokens)."""
    encoding, sizes = _encoding(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        char_at = np.arange(len(raw) + 1)
    else:
        char_at = np.append(np.nonzero((raw & 0xC0) != 0x80)[0], len(raw))
    chars = np.array(spans, np.int64).reshape(-1, 2)
    low, high = char_at[np.clip(chars, 0, len(text))].T
    high = np.maximum(low, high)

    def first_byte(place: np.ndarray) -> np.ndarray:
        """Where the character around a byte begins."""
        return char_at[np.searchsorted(char_at, place, "right") - 1]

    if rule == "split":
        edges = np.concatenate([[0], ends])
        share = lambda x: np.interp(x, edges, np.arange(len(edges)))
        counts = share(high) - share(low)
        owned = _covered(low, high, share)
    else:
        place = {
            "first": lambda: first_byte(starts), "last": lambda: first_byte(ends - 1),
            "middle": lambda: (starts + ends - 1) // 2,
        }[rule]()
        before = lambda x: np.searchsorted(place, x, "left")
        counts = before(high) - before(low)
        owned = _covered(low, high, before)
    inside = lambda x: (np.searchsorted(starts, x, "left") - np.searchsorted(ends, x, "right"))
    # tokens open at an edge; one that crosses both edges is met twice
    both = np.zeros(len(low), np.int64)
    if len(ids) and len(low):
        token = np.searchsorted(ends, low, "right")
        ok = token < len(ids)
        token = np.minimum(token, len(ids) - 1)
        both = (ok & (starts[token] < low) & (ends[token] > high) & (high > low)).astype(np.int64)
    crossing = np.where(high > low, inside(low) + inside(high) - both, 0)
    return counts, crossing, len(ids) - owned, len(ids)


def _covered(low: np.ndarray, high: np.ndarray, measure: Callable):
    """The measure of the union of the spans."""
    total, reach = 0, 0
    for k in np.argsort(low, kind="stable"):
        a, b = max(int(low[k]), reach), int(high[k])
        if b > a:
            total += measure(np.array([b]))[0] - measure(np.array([a]))[0]
            reach = b
    return total


def with_sections(docs: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """``docs`` with an array ``sections`` of (start, end) from a table (key, start, end).

    A document's sections are listed in order of start and end; they are as many as its own.
    """
    listed = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("sections"))
    return docs.join(listed, key, "left")


def counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rule: str = "first", sections: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) of every section of every row.

    sections: a column of arrays of (start, end) in characters, or None for lines.  section is
    the place in that array, from 0.  Spans are clipped to the text; null arrays and null texts
    have no sections, and a row without sections has its tokens, if any, as section -1.
    n_tokens is a bigint, a double under ``split``.  Repeated rows are kept; other columns are
    not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    number = pa.float64() if rule == "split" else pa.int64()
    schema = f"doc_id long, section int, start long, end long, n_tokens {'double' if rule == 'split' else 'long'}, n_crossing long"
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                given = b.column(2).to_pylist() if sections else [None] * b.num_rows
                out = [[] for _ in names]
                for doc, t, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), given):
                    t = t or ""
                    spans = [(s["start"] or 0, s["end"] or 0) for s in listed or [] if s] if sections else line_spans(t)
                    n, crossing, rest, _ = attribute(t, spans, rule, path)
                    rows = [len(spans), range(len(spans)), [s for s, _ in spans], [e for _, e in spans], n.tolist(), crossing.tolist()]
                    if rest > 1e-9:
                        rows = [rows[0] + 1, [*rows[1], -1], [*rows[2], None], [*rows[3], None], [*rows[4], rest], [*rows[5], 0]]
                    out[0].extend([doc] * rows[0])
                    for column, values in zip(out[1:], rows[1:]):
                        column.extend(values)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), number, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    columns = [F.col(key).cast("long"), F.col(text), *([F.col(sections)] if sections else [])]
    return docs.select(*columns).mapInArrow(run, schema)
