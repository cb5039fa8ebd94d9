"""Token counts per section: whole texts are encoded once, token spans are joined to section spans."""

from __future__ import annotations

import base64
import json
import re
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

RULES = ("start", "majority", "split")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizer file, which stand for themselves wherever a text holds them."""
    with open(path or vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as lines:
        text = lines.read()
    at = re.search(r'"added_tokens"\s*:\s*', text)  # every task reads this list, so the vocabulary beside it is not parsed
    return {t["content"]: t["id"] for t in json.JSONDecoder().raw_decode(text, at.end())[0]} if at else {}


class Encoder:
    """Byte-level encoder over a rank file; the length of a token in bytes gives its place in the text.

    ``added`` tokens, by default those of the tokenizer file with the same ranks, are found in texts before any merge.
    """

    def __init__(self, path: str | None = None, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = added_tokens() if added is None and path is None else added or {}
        self.sizes = np.zeros(max([*ranks.values(), *added.values()]) + 1, dtype=np.int64)
        for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.sizes[rank] = len(token)
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all")

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, byte after the last) of every token of the text."""
        ids = self.ids(text)
        ends = np.cumsum(self.sizes[ids])
        return ids, ends - self.sizes[ids], ends


def line_sections(text: str) -> np.ndarray:
    """First bytes of the lines of a text; a line owns its line feed."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], starts]) if not len(starts) or starts[-1] < len(data) else np.concatenate([[0], starts[:-1]])


def attribute(first: np.ndarray, after: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section [start, next start), by an interval join of sorted spans.

    A token that crosses a boundary goes to the section of its first byte
    ('start'), to the one with most of its bytes, the earlier one on a tie
    ('majority'), or in shares by bytes ('split'). It counts as crossing in
    the section that holds its first byte.
    """
    ends = np.append(starts[1:], size)
    left = np.searchsorted(starts, first, side="right") - 1
    right = np.searchsorted(starts, after - 1, side="right") - 1
    whole = left == right
    counts = np.bincount(left[whole], minlength=len(starts)).astype(float)
    crossing = np.bincount(left[~whole], minlength=len(starts))
    for i in np.flatnonzero(~whole):  # few: tokens rarely hold a boundary
        sections = np.arange(left[i], right[i] + 1)
        shares = np.minimum(ends[sections], after[i]) - np.maximum(starts[sections], first[i])
        if rule == "split":
            counts[sections] += shares / shares.sum()
        else:
            counts[left[i] if rule == "start" else sections[shares.argmax()]] += 1
    return counts, crossing


def section_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sections: Callable[[str], np.ndarray] = line_sections,
    rule: str = "start",
    vocabulary: str | None = None,
) -> DataFrame:
    """doc_id, section (from 0), start_byte, n_bytes, n_tokens (double), n_crossing of every section of every row.

    ``sections`` maps a text to the sorted first bytes of its sections, the
    first of them 0. A null or empty text is one empty section with no token.
    Sections sum to the tokens of the whole text. Repeated rows repeat.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count():
        encoder = Encoder(vocabulary)

        def work(batch):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = sections(body or "")
                _, first, after = encoder.spans(body or "")
                size = int(after[-1]) if len(after) else 0
                counts, crossing = attribute(first, after, starts, size, rule)
                yield doc, starts, np.append(starts[1:], size) - starts, counts, crossing

        def columns(batch):
            parts, rows = [], 0
            for part in work(batch):
                parts.append(part)
                rows += len(part[1])
                if rows > 50_000:
                    yield join(parts)
                    parts, rows = [], 0
            if parts:
                yield join(parts)

        def join(parts):
            return {
                "doc_id": [p[0] for p in parts for _ in p[1]],
                "section": np.concatenate([np.arange(len(p[1])) for p in parts]),
                **{name: np.concatenate([p[i] for p in parts]) for i, name in ((1, "start_byte"), (2, "n_bytes"), (3, "n_tokens"), (4, "n_crossing"))},
            }

        return columns

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return map_rows(
        rows, count, f"doc_id {kind}, section bigint, start_byte bigint, n_bytes bigint, n_tokens double, n_crossing bigint"
    )


@case("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token belongs to the line of its first byte."""
    return section_tokens(table(spark, sf_dir, "documents"))
