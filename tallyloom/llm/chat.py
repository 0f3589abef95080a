"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: A turn is OPEN, the role, BODY, the text and CLOSE. Each control string is one token of its own.
OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|done|>"
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|done\|>", re.S)
#: A conversation of more characters is handed to the tokenizer in runs of whole turns of about so many.
PART_CHARS = 1 << 19
#: A batch of formatted conversations is passed on when it holds this many tokens.
BATCH_TOKENS = 1 << 18


def escape(text: str) -> str:
    """No control string can occur in the result, and unescape() gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as text, and the span of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
        parts += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap one of the spans: both are sorted, so each span's tokens are found by binary search."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets):
        return mask
    starts, ends = offsets[:, 0], offsets[:, 1]
    for lo, hi in spans:
        mask[np.searchsorted(ends, lo, "right") : np.searchsorted(starts, hi, "left")] = hi > lo
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """For each span, the text that the masked tokens cover inside it, once, unescaped."""
    out = []
    for lo, hi in spans:
        first, last = np.searchsorted(offsets[:, 1], lo, "right"), np.searchsorted(offsets[:, 0], hi, "left")
        own = np.flatnonzero(mask[first:last]) + first
        out.append(unescape(formatted[max(lo, int(offsets[own[0], 0])) : min(hi, int(offsets[own[-1], 1]))]) if len(own) else "")
    return out


@cache
def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (OPEN, BODY, CLOSE)])
    return tokenizer


def encode(tokenizer, formatted: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a rendered conversation, every character encoded once.

    No token crosses a control string, so a long conversation is encoded in runs of whole turns and gives the
    same ids, while what the tokenizer holds at once is bounded by PART_CHARS and the longest turn.
    """
    ids, offsets, lo = [], [], 0
    for _, end in spans:
        hi = end + len(CLOSE)
        if hi - lo >= PART_CHARS or hi == len(formatted):
            code = tokenizer.encode(formatted[lo:hi], add_special_tokens=False)
            ids.append(np.array(code.ids, np.int32))
            offsets.append(np.array(code.offsets, np.int32).reshape(-1, 2) + np.int32(lo))
            lo = hi
    return (np.concatenate(ids), np.concatenate(offsets)) if ids else (np.zeros(0, np.int32), np.zeros((0, 2), np.int32))


FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays of numbers as one list column."""
    cuts = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts), kind))


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (conv_id, n_turns, formatted, ids, offsets, mask, spans) as one batch, without a Python number for each token."""
    conv, n, formatted, ids, offsets, mask, spans = zip(*rows, strict=True)
    edges = np.concatenate([np.array(s, np.int32).reshape(-1, 2) for s in spans])
    cuts = np.r_[0, np.cumsum([len(s) for s in spans])].astype(np.int32)
    learned = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], fields=list(_SPAN)))
    columns = [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(formatted, pa.string()), _lists(ids, pa.int32()), _lists([o[:, 0] for o in offsets], pa.int32()), _lists([o[:, 1] for o in offsets], pa.int32()), _lists(mask, pa.bool_()), learned]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FORMATTED.split(", ")])


def format_chats(turns: DataFrame, path: str, trained: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: rendered once, encoded once with offsets, and masked.

    loss_mask marks the tokens that overlap the text of a turn whose role is in `trained`; loss_spans are those
    texts' places in `formatted`. The control strings are added to the tokenizer as tokens of their own, so
    that no token crosses the edge of a text. Turns are in order of the turn number, nulls first; ties are in
    order of role, then text, and repeated rows stay. A null text is empty, a null role is empty, a null
    conversation id is a conversation. Other columns are dropped, whatever their names; an empty table gives an
    empty result. A conversation is one training sample and is held whole by one task, one at a time: what a
    worker holds is the longest conversation, not a batch of them.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = turns.select(F.col(conv).cast("long").alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _encoder(path)
        held, tokens = [], 0
        for b in batches:
            for conv_id, talk in zip(b.column("conv_id"), b.column("turns"), strict=True):
                talk = [(x["role"], x["text"]) for x in talk.as_py()]
                formatted, spans = render(talk)
                ids, offsets = encode(tokenizer, formatted, spans)
                learned = [s for s, (r, _) in zip(spans, talk, strict=True) if r in trained]
                held.append((conv_id.as_py(), len(talk), formatted, ids, offsets, mask_tokens(offsets, learned), learned))
                tokens += len(ids)
                if tokens >= BATCH_TOKENS:
                    yield _formatted(held)
                    held, tokens = [], 0
        if held:
            yield _formatted(held)

    return whole.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digests(chats: DataFrame) -> DataFrame:
    """Read format_chats() back: turns parsed from the formatted text, loss text from tokens under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda x: x.values.to_numpy(zero_copy_only=False)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                formatted = b.column("formatted")[i].as_py()
                offsets = np.stack([flat(b.column(c)[i]) for c in ("token_starts", "token_ends")], axis=1)
                mask = flat(b.column("loss_mask")[i]).astype(bool)
                spans = b.column("loss_spans")[i].values
                spans = list(zip(spans.field("start").to_pylist(), spans.field("end").to_pylist(), strict=True))
                turns = parse(formatted)
                said, loss = hashlib.sha256(), hashlib.sha256()
                for r, t in turns:
                    said.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                found = masked_text(formatted, offsets, mask, spans)
                for t in found:
                    loss.update(t.encode("utf-8", "surrogatepass"))
                out.append((b.column("conv_id")[i].as_py(), len(turns), said.hexdigest(), sum(map(len, found)), loss.hexdigest(), len(formatted), len(mask), int(mask.sum())))
            names = [c.split() for c in DIGESTS.split(", ")]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])

    return chats.mapInArrow(run, DIGESTS)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's formatting of `conversations` and conversation -7."""
    small_batches(spark)
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(more)
    return digests(format_chats(turns, public_tokenizers.path("byte_bpe_50k.json")))
