"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. Byte-level tokens have known lengths,
so their spans follow from a running sum; sections are spans of characters,
mapped to bytes. A text of more than SPLIT characters is encoded in parts, cut only
where the vocabulary's own pieces end whatever follows, so its tokens are those
of the whole; a long run of white space, on which the pattern would backtrack
character by character, is given to the merges as the piece that it is. Token spans and section spans, both sorted, are joined by
binary search, and a token that crosses a boundary is allocated by a rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how this vocabulary's texts are split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that is encoded at once.
SPLIT = 1 << 16
#: The white space of PATTERN, as its engine knows it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{WHITE}]+")
#: first: all of a token to the section of its first character; share: by the part of its bytes in each section.
RULES = ("first", "share")


@cache
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for token, rank in table.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


def encode(encoding, text: str) -> list[int]:
    """The tokens of encode_ordinary(text), for texts and runs of any length.

    No piece but white space reaches beyond a character that is followed by
    white space, and none looks back. So a text may be cut before a run of
    white space. Of such a run before another character, all but the last
    character are a piece; the last goes to what follows if it is a space, else
    it is a piece; at the end of the text the whole run is one.
    """
    if len(text) <= SPLIT:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    at = done = 0  # text[done:] is not encoded yet; text[at:] not searched
    while m := SPACES.search(text, at):
        start, end = m.span()
        if end - start > SPLIT:
            out += _part(encoding, text, done, start)
            if end == len(text):
                return out + encoding._encode_single_piece(text[start:end])
            out += encoding._encode_single_piece(text[start : end - 1])
            done = end - 1
            if text[done] != " ":
                out += encoding._encode_single_piece(text[done:end])
                done = end
        elif start - done >= SPLIT:
            out += _part(encoding, text, done, start)
            done = start
        at = end
    return out + _part(encoding, text, done, len(text))


def _part(encoding, text: str, start: int, end: int) -> list[int]:
    return encoding.encode_ordinary(text[start:end]) if end > start else []


def _line_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the lines of a text, each with its line end."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends


def _byte_places(data: bytes, chars: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    return np.append(begins, len(data))[np.clip(chars, 0, len(begins))]


def attribute(ends: np.ndarray, data: bytes, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that lie in more than one section or partly outside).

    ends: where each token ends, in bytes; sections must not overlap.
    """
    out = np.zeros(len(starts))
    if not len(ends) or not len(starts):
        return out, 0
    begin = np.concatenate([[0], ends[:-1]])
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], stops[order]
    whole = np.frombuffer(data, dtype=np.uint8)
    first = begin.copy()
    for _ in range(3):  # to the character that the token's first byte is part of
        first -= (whole[first] & 0xC0) == 0x80
    k = np.searchsorted(s, first, side="right") - 1
    inside = (k >= 0) & (first < e[np.maximum(k, 0)])
    crossing = int((inside & (ends > e[np.maximum(k, 0)])).sum() + (~inside & (ends > s[np.minimum(k + 1, len(s) - 1)]) & (k + 1 < len(s))).sum())
    if rule == "first":
        np.add.at(out, order[k[inside]], 1)
        return out, crossing
    # Tokens before each byte, with fractions: sections take differences.
    grid = np.concatenate([[0], ends])
    upto = lambda b: np.interp(b, grid, np.arange(len(grid)))
    out[order] = upto(e) - upto(s)
    return out, crossing


def count_tokens(docs: DataFrame, vocabulary: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens, outside_tokens for every row of docs(doc_id, text[, sections]).

    sections: a column of arrays of structs (start, end) in characters, not
    overlapping; without it, the lines of the text, each with its line end.
    section_tokens sums, with outside_tokens, to n_tokens. Null and empty texts
    have no tokens; null ids and repeated rows stay; texts of any length are
    encoded whole; other columns are ignored; an empty table gives no rows. vocabulary: a file of ranks that the driver reads; its
    size is fixed, and it is sent to the tasks.
    """
    if rule not in RULES:
        raise ValueError(rule)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(ranks.value)
        for batch in batches:
            spans = batch.column("sections").to_pylist() if sections else [None] * len(batch)
            rows: list[tuple] = []
            for doc_id, text, given in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), spans, strict=True):
                data = (text or "").encode()
                tokens = np.array(encode(encoding, text or ""), dtype=np.int64)
                ends = np.cumsum(lengths[tokens])
                if sections:
                    given = [x for x in given or [] if x and x["start"] is not None and x["end"] is not None]
                    starts, stops = (_byte_places(data, np.array([x[k] for x in given], dtype=np.int64)) for k in ("start", "end"))
                else:
                    starts, stops = _line_bounds(data)
                own, crossing = attribute(ends, data, starts, stops, rule)
                rows.append((doc_id, len(tokens), len(starts), crossing, own, len(tokens) - float(own.sum())))
            ids, n, m, c, own, out = zip(*rows, strict=True) if rows else ([], [], [], [], [], [])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *m]), pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(c, pa.int64()), lists, pa.array(out, pa.float64())], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "outside_tokens"])

    columns = ["doc_id", "text", F.col(sections).alias("sections")] if sections else ["doc_id", "text"]
    return docs.select(*columns).mapInArrow(kernel, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>, outside_tokens double")
