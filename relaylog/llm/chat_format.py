"""Chat formatting at the level of tokens: turns become ids with control ids between segments and a loss mask.

Each turn is a chain of segments. A segment is a control string, which is one reserved id beyond the vocabulary, or a
piece of content, which is encoded by itself, so no token ever spans a border between the two. All segments of a
slice are laid out in one flat array of ids; where the loss begins and ends is marked with +1 and -1, and the mask is
the prefix sum of the marks. The template:

    system      [SYS] text [/SYS]
    user        [INST] text [/INST]
    assistant   text </s>                       text is under the loss
    any other   [TURN] role [SAYS] text [/TURN]

(blanks are for reading only). Control strings that occur in a role or a text are escaped, so that the formatted text
can be told from its template too: a backslash comes after the first character, one more where there are some already
(``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``). Control strings hold their first character only once, so
matches never overlap and none arises at a border. Taking one backslash away again restores the text.

``read_back`` goes the other way, from ids and masks alone. Digests of a conversation need its turns in order: rows
are dealt by conversation, sorted, and streamed through running digests; nothing is gathered, whatever a
conversation's length. (A digest is sequential, so one conversation's rows pass through one task.)

Defined results: a null text or role is empty. Turns of a conversation are ordered by turn (null first), then role,
then text; repeated rows are repeated turns. Rows without ``conv_id`` are one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.llm.byte_bpe import Encoder, Vocabulary
from relaylog.llm.common import map_slices, slices

# Control strings in the order of their reserved ids. The first character of each comes nowhere else in it.
CONTROLS = ("</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[SAYS]", "[/TURN]")
END, INST, END_INST, SYS, END_SYS, TURN, SAYS, END_TURN = range(len(CONTROLS))
FRAMES = {"system": (SYS, END_SYS), "user": (INST, END_INST)}

# Places where the rest of a control string follows its first character, perhaps after backslashes.
_PLACE = regex.compile("|".join(rf"(?<={regex.escape(c[0])})(?=\\*{regex.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = regex.compile("|".join(rf"(?<={regex.escape(c[0])})\\(?=\\*{regex.escape(c[1:])})" for c in CONTROLS))

FORMATTED = "conv_id bigint, turn bigint, ids binary, loss binary, n_tokens bigint"


def escape(text: str) -> str:
    return _PLACE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


class Codec:
    """Content to ids and back; reserved ids begin at ``base``, after the last of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.encode = Encoder(vocabulary)
        self.base = len(self.encode.merger.tokens)

    def decode(self, ids: np.ndarray) -> str:
        return self.encode.merger.decode(ids.astype("<u4").tobytes()).decode()


def segments(role: str, text: str) -> list[tuple[int | str, bool]]:
    """Control numbers and escaped content of a turn, each with whether it is under the loss."""
    text = escape(text)
    if role == "assistant":
        return [(text, True), (END, False)]
    if role in FRAMES:
        before, after = FRAMES[role]
        return [(before, False), (text, False), (after, False)]
    return [(TURN, False), (escape(role), False), (SAYS, False), (text, False), (END_TURN, False)]


def assemble(turns: list[tuple[str, str]], codec: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the turns, whether each is under the loss, and the number of ids of each turn."""
    chain = [segments(role, text) for role, text in turns]
    flat = [s for segment in chain for s in segment]
    content = iter(codec.encode([s for s, _ in flat if isinstance(s, str)]))
    coded = [next(content) if isinstance(s, str) else (codec.base + s).to_bytes(4, "little") for s, _ in flat]
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    ends = np.cumsum(size)
    ids = np.frombuffer(b"".join(coded), "<u4")
    under = np.fromiter((loss for _, loss in flat), bool, len(flat))
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, (ends - size)[under], 1)
    np.add.at(marks, ends[under], -1)
    border = np.cumsum([len(segment) for segment in chain])
    n_tokens = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], border]).astype(np.int64)])
    return ids, np.cumsum(marks[:-1]).astype(bool), n_tokens


def format_turns(turns: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every row of ``conv_id, turn, role, text`` as ids (little-endian unsigned 32-bit) and loss (a byte 0 or 1 for each id)."""
    shared = turns.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        codec = Codec(shared.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)
            ids, loss, n_tokens = assemble([(role or "", text or "") for role, text in rows], codec)
            ends = np.concatenate([[0], np.cumsum(n_tokens)]).tolist()
            raw, mask = ids.astype("<u4").tobytes(), loss.astype(np.uint8).tobytes()
            cut = list(zip(ends[:-1], ends[1:], strict=True))
            return pa.record_batch([
                part.column("conv_id"), part.column("turn"), pa.array([raw[4 * a : 4 * b] for a, b in cut], pa.binary()),
                pa.array([mask[a:b] for a, b in cut], pa.binary()), pa.array(n_tokens, pa.int64()),
            ], ["conv_id", "turn", "ids", "loss", "n_tokens"])

        return step

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return map_slices(rows, "text", work, FORMATTED)


def parse(ids: np.ndarray, loss: np.ndarray, codec: Codec) -> Iterator[tuple[str, str, str, str]]:
    """Role, text, text under the loss and formatted text of each turn in a run of ids, by control ids and mask alone."""
    control = np.flatnonzero(ids >= codec.base)
    start, held, opened = 0, [], None
    for at in [*control.tolist(), len(ids)]:
        content = codec.decode(ids[start:at])
        scored = codec.decode(ids[start:at][loss[start:at]])
        held.append((content, scored))
        start = at + 1
        if at == len(ids):
            if opened is not None or content:
                raise ValueError("ids end inside a turn")
            return
        name = int(ids[at]) - codec.base
        if name in (INST, SYS, TURN):
            opened, held = name, []
        elif name != SAYS:
            role = {END: "assistant", END_INST: "user", END_SYS: "system"}.get(name) or unescape(held[0][0])
            shown = {END: "", END_INST: CONTROLS[INST], END_SYS: CONTROLS[SYS], END_TURN: CONTROLS[TURN]}[name]
            shown += CONTROLS[SAYS].join(c for c, _ in held) + CONTROLS[name]
            yield role, unescape(held[-1][0]), unescape("".join(s for _, s in held)), shown
            opened, held = None, []


def read_back(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``conv_id, turn, role, text, loss_text, formatted`` of every turn, from ids and masks."""
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        codec = Codec(shared.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            row, found = [], []
            for i, (ids, loss) in enumerate(zip(part.column("ids").to_pylist(), part.column("loss").to_pylist(), strict=True)):
                for turn in parse(np.frombuffer(ids or b"", "<u4"), np.frombuffer(loss or b"", np.uint8).astype(bool), codec):
                    row.append(i)
                    found.append(turn)
            columns = [part.column(c).take(pa.array(row, pa.int64())) for c in ("conv_id", "turn")]
            columns += [pa.array([turn[k] for turn in found], pa.string()) for k in range(4)]
            return pa.record_batch(columns, ["conv_id", "turn", "role", "text", "loss_text", "formatted"])

        return step

    schema = "conv_id bigint, turn bigint, role string, text string, loss_text string, formatted string"
    return map_slices(formatted.select("conv_id", "turn", "ids", "loss"), "ids", work, schema)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row for each conversation of ``read_back``: its turns, the text under the loss, and its formatted length."""
    scored = F.col("loss_text") != ""
    # Text under the loss is the text itself or nothing; the text need not travel twice.
    rows = read.select(
        "conv_id", "turn", "role", "text", F.when(scored & (F.col("loss_text") != F.col("text")), F.col("loss_text")).alias("other"),
        scored.alias("scored"), F.char_length("formatted").cast("bigint").alias("chars"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, any_row = None, False
        n_turns = loss_chars = chars = 0
        whole, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def made() -> pa.RecordBatch:
            names = [c.split()[0] for c in DIGEST.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array([row[i] for row in done], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for part in slices(batch, "text"):
                columns = [part.column(c).to_pylist() for c in ("conv_id", "role", "text", "other", "scored", "chars")]
                for conv_id, role, text, other, counts, n in zip(*columns, strict=True):
                    if any_row and conv_id != key:
                        done.append((key, n_turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                        n_turns = loss_chars = chars = 0
                        whole, loss = hashlib.sha256(), hashlib.sha256()
                    key, any_row = conv_id, True
                    n_turns += 1
                    chars += n
                    whole.update(f"{role}\n{text}\n".encode())
                    if counts:
                        scored_text = text if other is None else other
                        loss_chars += len(scored_text)
                        loss.update(scored_text.encode())
                if done:
                    yield made()
                    done.clear()
        if any_row:
            done.append((key, n_turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield made()

    return rows.mapInArrow(run, DIGEST)
