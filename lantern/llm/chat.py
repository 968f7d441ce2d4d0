"""Chat formatting by token-level assembly.

Role and text of a turn are encoded on their own by a public byte-level vocabulary, and the template's
control tokens, reserved ids that no text can reach, are spliced between them:

    TURN role BODY text END

Positions come from prefix sums of the segments' lengths over the turns of a conversation, and so does
the loss mask: the interval of each assistant text, without control tokens. Strings that look like a
control token inside a role or text are escaped, reversibly: ``<``, any backslashes and ``|`` get one
more backslash, so the rendered form of the tokens can be parsed too.

Rows of a conversation stand by turn (null first), then role, then text; repeated rows are turns of their
own. Null role or text: empty. Null conv_id: a conversation of its own. A conversation's turns are never
gathered: they are sorted and read as a stream, however many there are. Turns tied in all three stand in any order, as they are equal.
Very long texts are encoded whole. An empty table gives no rows. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import in_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TURN, BODY, END = 50256, 50257, 50258
CONTROL = {TURN: "<|turn|>", BODY: "<|body|>", END: "<|end|>"}
LEARNED = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_TURN_SCHEMA = "ids array<int>, n_tokens long, body_from long, body_to long"


def _encoder(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(vocabulary).encode_ordinary
        for batch in batches:
            roles = {r: code(escape(r)) for r in set(batch.column("role").to_pylist())}
            ids, sizes, start, stop = [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head, body = roles[role], code(escape(text))
                ids.append([TURN, *head, BODY, *body, END])
                sizes.append(len(ids[-1]))
                start.append(len(head) + 2)
                stop.append(len(head) + 2 + len(body))
            arrays = [*batch.columns[:3], pa.array(ids, pa.list_(pa.int32())), *(pa.array(x, pa.int64()) for x in (sizes, start, stop)), batch.column("text_order")]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "ids", "n_tokens", "body_from", "body_to", "text_order"])

    return run


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a turn: conv_id, turn_no (from 0), ids, first_token (its place in the conversation's tokens),
    loss_from and loss_to (places under the loss mask, equal for turns without loss)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    turn = turns.schema["turn"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("text_order"))
    rows = in_arrow(rows, _encoder(vocabulary), f"conv_id {kind}, turn {turn}, role string, {_TURN_SCHEMA}, text_order string")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text_order")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    learned = F.col("role") == LEARNED
    placed = rows.withColumn("turn_no", F.row_number().over(order).cast("long") - 1).withColumn("first_token", before)
    return placed.select(
        "conv_id", "turn_no", "ids", "first_token",
        (F.col("first_token") + F.col("body_from")).alias("loss_from"),
        (F.col("first_token") + F.when(learned, F.col("body_to")).otherwise(F.col("body_from"))).alias("loss_to"),
    )


class _Reader:
    """Reads the formatted turns of one conversation after another and digests them."""

    def __init__(self, vocabulary: str):
        self.decode, self.out = encoding(vocabulary).decode, []
        self.conv, self.open = None, False

    def feed(self, conv, ids: list[int], first: int, loss_from: int, loss_to: int) -> None:
        if not self.open or conv != self.conv:
            self.close()
            self.conv, self.open = conv, True
            self.turns, self.all, self.loss, self.loss_chars, self.chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        if ids[0] != TURN or ids[-1] != END:
            raise ValueError(f"not a turn in conversation {conv}")
        middle = ids.index(BODY)
        role, body = self.decode(ids[1:middle]), self.decode(ids[middle + 1 : -1])
        self.chars += len(role) + len(body) + sum(map(len, CONTROL.values()))
        self.turns += 1
        self.all.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        if loss_to > loss_from:
            learned = unescape(self.decode(ids[loss_from - first : loss_to - first]))
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def close(self) -> None:
        if self.open:
            self.out.append((self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars))
        self.open = False


def _digester(vocabulary: str, kind: str):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def emit(reader: _Reader, schema: pa.DataType) -> Iterator[pa.RecordBatch]:
        if reader.out:
            columns = list(zip(*reader.out, strict=True))
            types = [schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            reader.out = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, schema = _Reader(vocabulary), pa.int64()
        for batch in batches:
            schema = batch.schema.field("conv_id").type
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for row in zip(*(part.column(c).to_pylist() for c in ("conv_id", "ids", "first_token", "loss_from", "loss_to")), strict=True):
                    reader.feed(*row)
            yield from emit(reader, schema)
        reader.close()
        yield from emit(reader, schema)

    return run


def digests(output: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Reads formatted turns back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = output.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = output.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return in_arrow(ordered, _digester(vocabulary, kind), schema)


def rendered(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """Tokens as text, control tokens as their strings."""
    out, run = [], []
    for i in chain(ids, [None]):
        if i is None or i in CONTROL:
            out.append(encoding(vocabulary).decode(run))
            out.append(CONTROL.get(i, ""))
            run = []
        else:
            run.append(i)
    return "".join(out)
