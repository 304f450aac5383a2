r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once, and the sorted byte spans of its
turns are intersected with the byte spans of its tokens by binary search.

Template of a turn: `<turn ROLE>`, newline, text, newline, `</turn>`, newline.
In roles and texts each of `\`, `<` and `>` gets a backslash before it, so no
control string of a text survives as one, and dropping those backslashes gives
the text back.

Defined cases: null texts and roles are empty; turns go by (turn, role, text),
null turns first; repeated rows are repeated turns; a null conversation id is a
conversation of its own; an empty table gives no rows; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import base64
import re
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

#: Fixed value: the public pre-tokenizer pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ESCAPED = re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"[\\<>]")
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and the byte span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<turn {escape(role)}>\n", escape(text), "\n</turn>\n"
        start = at + len(head.encode())
        end = start + len(body.encode())
        spans.append((start, end))
        parts += (head, body, tail)
        at = end + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def token_overlaps(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """A mask of the tokens that share bytes with a span.

    ends: the tokens' ascending end offsets; tokens follow one another without gaps.
    """
    mask = np.zeros(len(ends), np.int8)
    starts = np.concatenate(([0], ends[:-1]))
    for a, b in spans:
        if a < b:
            first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
            mask[first:last] = 1
    return mask


def masked_bytes(ends: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of the spans that lie under masked tokens."""
    edge = np.flatnonzero(np.diff(mask, prepend=0, append=0))
    bounds = np.concatenate(([0], ends))
    runs = bounds[edge].reshape(-1, 2)
    out = []
    for a, b in spans:
        for i in range(int(np.searchsorted(runs[:, 1], a, side="right")), len(runs)):
            low, high = max(a, int(runs[i, 0])), min(b, int(runs[i, 1]))
            if low >= high:
                break
            out.append((low, high))
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


_encodings: dict[str, tuple] = {}


def _encoding(key: str, shared) -> tuple:
    """This worker's encoding of a broadcast vocabulary, and the bytes of each of its tokens."""
    import tiktoken

    if key not in _encodings:
        _encodings.clear()
        ranks = shared.value
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[key]


_vocabularies: dict[str, tuple[list[bytes], np.ndarray]] = {}


def _tokens(key: str, shared) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each token of a broadcast vocabulary and their number; all that decoding needs."""
    if key not in _vocabularies:
        _vocabularies.clear()
        tokens = [b""] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            tokens[rank] = token
        _vocabularies[key] = tokens, np.array([len(t) for t in tokens])
    return _vocabularies[key]


def format_chats(rows: DataFrame, *, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, token_ids, loss_mask (by token), loss_spans (bytes of the trained texts).

    The vocabulary is read on the driver and broadcast; its size does not depend on
    the data. A formatted conversation is one row, so its turns meet in one task.
    """
    shared, key = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary)), uuid.uuid4().hex
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def function(got):
        encoding, sizes = _encoding(key, shared)
        out = [[], [], [], [], []]
        for turns in got[0]:
            text, spans = render([(t["role"], t["text"]) for t in turns])
            ids = encoding.encode_ordinary(text)
            ends = np.cumsum(sizes[ids])
            trained = [s for s, t in zip(spans, turns) if t["role"] == train_role and s[0] < s[1]]
            for column, x in zip(out, (len(turns), text, ids, token_overlaps(ends, trained).tolist(), [{"start": a, "end": b} for a, b in trained])):
                column.append(x)
        return out

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    adds = T.StructType([T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType())), T.StructField("loss_spans", span)])
    return add_columns(grouped, ["turns"], adds, function).drop("turns")


def read_chats(formatted: DataFrame, *, vocabulary: str) -> DataFrame:
    """Add turns (role, text) and loss_text, read back from the token ids, their mask and the spans.

    The ids are decoded and must give the formatted text, else the job fails; turns are
    parsed from it. loss_text is what lies both under masked tokens and in loss_spans.
    """
    shared, key = formatted.sparkSession.sparkContext.broadcast(read_ranks(vocabulary)), uuid.uuid4().hex

    def function(got):
        tokens, sizes = _tokens(key, shared)
        turns, loss = [], []
        for text, ids, mask, spans in zip(*got):
            if len(ids) != len(mask) or b"".join([tokens[i] for i in ids]) != text:
                raise ValueError("the tokens do not give the formatted text")
            parts = masked_bytes(np.cumsum(sizes[np.asarray(ids, np.int64)]), np.asarray(mask, np.int8), [(s["start"], s["end"]) for s in spans])
            turns.append([{"role": r, "text": t} for r, t in parse(text.decode())])
            loss.append(unescape(b"".join(text[a:b] for a, b in parts).decode("utf-8", "replace")))
        return [turns, loss]

    turn = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    return add_columns(formatted, ["formatted", "token_ids", "loss_mask", "loss_spans"], T.StructType([T.StructField("turns", turn), T.StructField("loss_text", T.StringType())]), function)
