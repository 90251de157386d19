"""Token counts of sections and fields by offsets: a document is encoded once, its token spans are interval-joined to its sections.

Spans are in characters. A token's span begins at the character that holds its first byte and ends behind the one that holds its
last, so tokens that share a character overlap there. Sections tile a text: each line with its line feed, or each field with
the separator behind it. A token that crosses a boundary is allocated by an explicit rule: "start" gives it to the section of its
first character, "majority" to the section with most of its characters (the earlier one on a tie), "split" shares it in proportion
to characters. Sections of no characters get no tokens. A null or empty text has one empty section; null fields are empty. Rows
with a null id, repeated rows and rows that share an id are counted each by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_ids import ByteIds
from .common import as_bytes, map_arrow

RULES = ("start", "majority", "split")
COLUMNS = "first_char long, n_chars long, n_tokens double, n_crossing long"


def line_sections(text: bytes) -> list[int]:
    """First bytes of the sections of a text."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return [0, *at[at < len(text)].tolist()]


def character_spans(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and exclusive last characters of tokens with these exclusive last bytes, and the character of each byte and of the end."""
    begun = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    character = np.append(begun - 1, begun[-1] if len(begun) else 0)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return character[begins], character[ends - 1] + 1 if len(ends) else ends, character


def allocate(begins: np.ndarray, ends: np.ndarray, firsts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of the tokens in it cross a boundary. Tokens are spans, sections tile 0 to size."""
    n = len(firsts)
    if not len(ends):
        return np.zeros(n), np.zeros(n, np.int64)
    low = np.searchsorted(firsts, begins, "right") - 1
    high = np.searchsorted(firsts, ends - 1, "right") - 1
    crossing = np.flatnonzero(high > low)
    inside = np.ones(len(ends), bool)
    inside[crossing] = False
    counts = np.bincount(low[inside], minlength=n).astype(float)
    crossed = np.zeros(n, np.int64)
    limits = np.append(firsts[1:], size)
    for t in crossing:
        over = np.arange(low[t], high[t] + 1)
        share = np.minimum(limits[over], ends[t]) - np.maximum(firsts[over], begins[t])
        crossed[over[share > 0]] += 1
        if rule == "start":
            counts[low[t]] += 1
        elif rule == "majority":
            counts[over[np.argmax(share)]] += 1
        else:
            counts[over] += share / share.sum()
    return counts, crossed


def attribute(text: bytes, firsts: Sequence[int], ids: ByteIds, rule: str) -> list[np.ndarray]:
    """First character, characters, tokens and crossing tokens of the sections that begin at these bytes."""
    begins, ends, character = character_spans(text, np.cumsum(ids.lengths[ids.encode(text)]))
    places = character[np.asarray(firsts, np.int64)]
    counts, crossed = allocate(begins, ends, places, int(character[-1]), rule)
    return [places, np.diff(np.append(places, character[-1])), counts, crossed]


def checked(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return rule


def section_token_counts(docs: DataFrame, rule: str = "majority", path: str | None = None) -> DataFrame:
    """A row per line of each document, with the tokens that the rule allocates to it."""
    checked(rule)

    def make():
        ids = ByteIds(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, sizes = [], []
            for text in as_bytes(batch.column(1)):
                found = attribute(text, line_sections(text), ids, rule)
                sizes.append(len(found[0]))
                out.append([np.arange(sizes[-1]), *found])
            doc = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            return pa.record_batch([doc, *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], ["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, section long, " + COLUMNS)


def field_token_counts(docs: DataFrame, fields: Sequence[str], separator: str = "\n", rule: str = "majority", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row per field of each row, with the tokens that the rule allocates to it in the text of all fields, each but the last
    followed by the separator, which counts as part of the field."""
    checked(rule)
    kind, between = docs.select(key).dtypes[0][1], separator.encode()

    def make():
        ids = ByteIds(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for values in zip(*(as_bytes(batch.column(k + 1)) for k in range(len(fields))), strict=True):
                parts = [value + between for value in values[:-1]] + [values[-1]]
                firsts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
                out.append(attribute(b"".join(parts), firsts, ids, rule))
            row = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(fields))))
            names = pa.array(list(fields) * batch.num_rows, pa.string())
            return pa.record_batch([row, names, *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], [key, "field", "first_char", "n_chars", "n_tokens", "n_crossing"])

        return each

    # the values of each field as text, under names that cannot clash
    chosen = docs.select(key, *(docs[f].cast("string").alias(f"__field_{k}") for k, f in enumerate(fields)))
    return map_arrow(chosen, make, f"{key} {kind}, field string, " + COLUMNS)
