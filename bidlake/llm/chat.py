"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with offsets, and its sorted loss spans (the assistants' texts)
are intersected with the tokens' spans by binary search: the tokens of a span are one run, and each run carries the
characters that it shares with the span, so the mask is exact even where a token reaches over a span's end. Token ids and
masks stay flat arrays from the tokenizer to the table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import small_batches

#: A turn is OPEN, the role, MID, the text, CLOSE. Escaped texts hold neither OPEN nor CLOSE.
OPEN, MID, CLOSE = "### ", ":\n", "\n</turn>\n"
_CONTROL = re.compile(r"\\|(?<=#)#(?=#)|(?<=<)/(?=turn>)")
_ROLE_CONTROL = re.compile(r"\\|(?<=#)#(?=#)|(?<=<)/(?=turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_NAME = re.compile(r"(?:[^\\:]|\\.)*", re.S)
_tokenizers: dict = {}


def escape(text: str, role: bool = False) -> str:
    """A backslash before each backslash, the inner marks of ``###`` and the stroke of ``</turn>`` (and colons of roles)."""
    return (_ROLE_CONTROL if role else _CONTROL).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the texts of ``loss_role``, as code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}{MID}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Texts hold no CLOSE, so the first one ends a turn."""
    turns, at = [], 0
    while at < len(formatted):
        mid = _NAME.match(formatted, at + len(OPEN)).end()
        end = formatted.index(CLOSE, mid + len(MID))
        turns.append((unescape(formatted[at + len(OPEN) : mid]), unescape(formatted[mid + len(MID) : end])))
        at = end + len(CLOSE)
    return turns


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens' sorted ``starts`` and ``ends`` the mask, and of each run of tokens under it the characters that it
    shares with a span: rows ``(span, first token, token after the last, start, end)``. Where tokens leave characters out, a
    run ends."""
    mask, rows = np.zeros(len(starts), dtype=bool), []
    if len(starts):
        ends = np.maximum.accumulate(ends)
        first, last = np.searchsorted(ends, [a for a, _ in spans], side="right"), np.searchsorted(starts, [b for _, b in spans], side="left")
        for k, (a, b) in enumerate(spans):
            own = np.arange(first[k], max(first[k], last[k]))
            own = own[np.minimum(ends[own], b) > np.maximum(starts[own], a)]
            if not len(own):
                continue
            mask[own] = True
            cuts = np.flatnonzero((starts[own[1:]] > ends[own[:-1]]) | (own[1:] != own[:-1] + 1)) + 1
            rows += [(k, run[0], run[-1] + 1, max(starts[run[0]], a), min(ends[run[-1]], b)) for run in np.split(own, cuts)]
    return mask, np.array(rows, dtype=np.int64).reshape(-1, 5)


def masked_texts(formatted: str, parts: list[list[int]]) -> list[str]:
    """The text under the mask, span by span, unescaped. Tokens that share a character count it once."""
    out, at = {}, {}
    for k, _, _, s, e in parts:
        s = max(s, at.get(k, s))
        if s < e:
            out[k] = out.get(k, "") + formatted[s:e]
            at[k] = e
    return [unescape(out[k]) for k in sorted(out)]


def _lists(flat: np.ndarray, ends: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat, kind))


def format_chats(turns: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, n_turns, token_ids, loss_mask, loss_parts`` for ``turns(conv_id, turn, role, text, ...)``.

    Turns are in order of turn (nulls first; ties by role and text), null roles and texts are empty, rows of a null
    conv_id are one conversation, repeated rows are turns of their own, no rows give no rows. ``loss_parts`` lists
    ``span, first token, token after the last, start, end`` of the runs of tokens under the mask. A conversation, which is
    formatted as a whole, is gathered in one row; nothing larger is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = Tokenizer.from_file(tokenizer)
            _tokenizers[tokenizer].encode_special_tokens = True
        for b in batches:
            for lo in range(0, len(b), 64):
                conv, talks = b.column(0).slice(lo, 64), b.column(1).slice(lo, 64).to_pylist()
                done = [render([(t["role"], t["text"]) for t in ts], loss_role) for ts in talks]
                encoded = _tokenizers[tokenizer].encode_batch([f for f, _ in done], add_special_tokens=False)
                ids, masks, parts, token_ends = [], [], [], []
                for (_, spans), e in zip(done, encoded, strict=True):
                    own = e.ids
                    offsets = np.fromiter(chain.from_iterable(e.offsets), dtype=np.int64, count=2 * len(own))
                    mask, runs = align(offsets[::2], offsets[1::2], spans)
                    ids.append(np.array(own, dtype=np.int32))
                    masks.append(mask)
                    parts.append(runs.astype(np.int32).tolist())
                    token_ends.append(len(own) + (token_ends[-1] if token_ends else 0))
                columns = [
                    conv,
                    pa.array([f for f, _ in done], pa.string()),
                    pa.array([len(ts) for ts in talks], pa.int64()),
                    _lists(np.concatenate(ids), token_ends, pa.int32()),
                    _lists(np.concatenate(masks), token_ends, pa.bool_()),
                    pa.array(parts, pa.list_(pa.list_(pa.int32()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "n_turns", "token_ids", "loss_mask", "loss_parts"])

    small_batches(turns.sparkSession, 200)
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    whole = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, formatted string, n_turns long, token_ids array<int>, loss_mask array<boolean>, loss_parts array<array<int>>"
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")).mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Read the output back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, parts in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                turns = parse(text)
                loss = "".join(masked_texts(text, parts.as_py()))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n_turns, said, chars, loss, formatted_chars = zip(*rows, strict=True) if rows else ([],) * 5
            columns = [b.column(0), pa.array(n_turns, pa.int64()), pa.array(said, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(formatted_chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_parts").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
