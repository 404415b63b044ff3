"""Chat formatting: segments are encoded one by one and spliced with reserved ids.

A turn becomes ``open ids + content ids + close ids``; the reserved ids lie above
the byte-level vocabulary, so no content can produce them. Control strings inside
content are broken by an escape character after their first character, and the
escape character itself is doubled, which is exactly reversible. Positions of all
segments are prefix sums of their id counts within the conversation, and the loss
mask covers the content of assistant turns.

Turns are encoded where they lie (no shuffle, no hot conversation); only order and
running positions need the rows of one conversation together, and those stream.

Defined cases: a null text or role is empty; a null conv_id or turn is an ordinary
value that sorts first; equal turn numbers go by role, then text; repeated rows are
repeated turns; an empty table gives an empty result; extra columns are ignored. A
very long text is one turn and is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.session import importable

#: The template's control strings; reserved ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|end|>")
ESCAPE = "␛"
_CONTROL = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")
#: Reserved strings that open and close the turns of each known role; other roles name themselves.
_FRAMES = {"user": ("<s>", "[INST]", "[/INST]"), "assistant": ("", "", "</s>"), "system": ("<s>", "<<SYS>>", "<</SYS>>")}


def escape(text: str) -> str:
    """Break control strings: ``[INST]`` becomes ``[␛INST]``, and ``␛`` is doubled."""
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@cache
def encoder(path: str):
    """The byte-level encoding with the control strings as reserved ids, one for each worker process."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = max(ranks.values()) + 2
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={c: first + i for i, c in enumerate(CONTROLS)})


def frame(role: str) -> tuple[list[str], list[str]]:
    """Control strings before and after a turn; an unknown role stands, escaped, between <|role|> marks."""
    if role in _FRAMES:
        first, opening, closing = _FRAMES[role]
        return [x for x in (first, opening) if x], [closing]
    return ["<|role|>", escape(role), "<|role|>"], ["<|end|>"]


def encode_turn(encoding, role: str, text: str) -> tuple[list[int], int, int]:
    """Ids of a turn and the half-open range of its content among them."""
    before, after = frame(role)

    def spliced(parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([encoding.encode_single_token(p)] if p in CONTROLS else encoding.encode_ordinary(p))]

    head, body = spliced(before), encoding.encode_ordinary(escape(text))
    return head + body + spliced(after), len(head), len(head) + len(body)


_TURNS = "conv_id long, turn long, role string, text string, ids binary, n_ids long, head long, tail long"


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        for batch in batches:
            ids, sizes, heads, tails = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turn, head, tail = encode_turn(encoding, role, text)
                ids.append(np.array(turn, "<u4").tobytes())
                sizes.append(len(turn))
                heads.append(head)
                tails.append(tail)
            new = [pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, heads, tails))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=["conv_id", "turn", "role", "text", "ids", "n_ids", "head", "tail"])

    return run


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Turns with their ids: place in the conversation, first position, and masked positions loss_start to loss_end."""
    importable(turns.sparkSession)
    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    coded = clean.mapInArrow(_encode_rows(tokenizer), _TURNS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = coded.withColumns({"place": F.row_number().over(order), "first_id": before})
    learns = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "place", "role", "ids", "n_ids", "first_id",
        F.when(learns, F.col("first_id") + F.col("head")).alias("loss_start"), F.when(learns, F.col("first_id") + F.col("tail")).alias("loss_end"),
    )


def splice_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, position, id, in_loss): every conversation's ids as one sequence with its loss mask, one row for each id."""
    turns = formatted.select("conv_id", "first_id", "loss_start", "loss_end", "n_ids", F.hex("ids").alias("hexed"))
    each = turns.select("conv_id", "loss_start", "loss_end", "first_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_ids").cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring("hexed", i * 8 + 1, F.lit(8)).alias("h")))).alias("x"))
    little = F.concat(*[F.substring("x.h", 7 - 2 * k, 2) for k in range(4)])
    position = F.col("first_id") + F.col("x.i")
    return each.select("conv_id", position.alias("position"), F.conv(little, 16, 10).cast("long").alias("id"), F.coalesce((position >= F.col("loss_start")) & (position < F.col("loss_end")), F.lit(False)).alias("in_loss"))


def read_turn(encoding, ids: list[int]) -> tuple[str, str]:
    """Role and text read back from a turn's ids."""
    controls = {encoding.encode_single_token(c): c for c in CONTROLS}
    marks = [(n, controls[i]) for n, i in enumerate(ids) if i in controls]
    text = lambda a, b: unescape(encoding.decode_bytes(ids[a:b]).decode())
    names = [m for _, m in marks]
    if names[:1] == ["<|role|>"]:
        return text(1, marks[1][0]), text(marks[1][0] + 1, len(ids) - 1)
    if names == ["</s>"]:
        return "assistant", text(0, len(ids) - 1)
    return ("user" if "[INST]" in names else "system"), text(2, len(ids) - 1)


def digest_chats(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation, read back from ``format_chats``; a task holds one turn and running hashes, never a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(tokenizer)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "loss_ids"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        state: list | None = None

        def flush(state: list) -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]]

        for batch in batches:
            done = []
            rows = batch.to_pydict()
            for conv_id, place, raw, lo, hi in zip(*(rows[c] for c in ("conv_id", "place", "ids", "loss_start", "loss_end")), strict=True):
                if place == 1:
                    if state is not None:
                        done.append(flush(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids = np.frombuffer(raw, "<u4").tolist()
                # Where this turn begins in the conversation's spliced ids, counted here and not taken from the prefix sums.
                at = state[6]
                role, text = read_turn(encoding, ids)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(encoding.decode_bytes(ids).decode())
                state[6] += len(ids)
                if lo is not None:
                    if not at <= lo <= hi <= at + len(ids):
                        raise ValueError(f"conversation {conv_id}: masked positions {lo} to {hi} lie outside turn {place}")
                    masked = unescape(encoding.decode_bytes(ids[lo - at : hi - at]).decode())
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                    state[7] += hi - lo
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
        if state is not None:
            last = flush(state)
            yield pa.RecordBatch.from_arrays([pa.array([last[i]], k) for i, k in enumerate(kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, loss_ids long"
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, schema)
