r"""Chat formatting in budgeted windows.

A turn is `### role\n` + text + `</turn>\n`. In texts and roles a backslash, `###` and
`</turn>` get a backslash before them (a line feed in a role becomes `\n`), so the output
can be read back exactly. Prefix sums of turn tokens choose spans of whole turns that fit the
budget. Every window keeps the leading system turn, repeats at most `history` earlier
turns, and only new assistant turns bear loss. A turn that alone exceeds the budget gets a
window of its own: nothing is dropped or cut.

Rows are dealt by conversation and stream in turn order, so memory is bounded by a window,
not by a conversation.

Defined cases: null text and null role are empty; a null conversation id is a conversation
of its own; null turns come first, equal turns are ordered by role and text, repeated rows are turns of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import small_batches

BUDGET, HISTORY, LOSS_ROLE, SYSTEM_ROLE = 1024, 2, "assistant", "system"
_SPECIAL = re.compile(r"\\|###|</turn>")
_BACK = re.compile(r"\\(\\|###|</turn>|n)")
_TURN = re.compile(r"### ((?:[^\n\\]|\\.)*)\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head, body = f"### {_role(role)}\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_back(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a formatted window")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


_coders: dict[str, object] = {}


def _counter(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _coders:
        _coders[path] = Tokenizer.from_file(path)
        _coders[path].encode_special_tokens = True
    return _coders[path]


def windows(conversations: DataFrame, tokenizer_path: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, loss_spans (flat starts and ends), n_repeated, first_turn, over_budget; in order within a task."""
    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, window long, text string, loss_spans array<int>, n_repeated int, first_turn long, over_budget boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _counter(tokenizer_path)

        class Open:
            """The conversation being read: turns from the last window's history on."""

            def __init__(self, conv):
                self.conv, self.turns, self.tokens, self.base, self.window = conv, [], [], 0, 0
                self.system, self.at, self.old = None, 0, -1

            def flush(self, final: bool):
                """Emit the windows that later turns can't change."""
                while True:
                    lead = self.system is not None
                    turns, tokens = self.turns, self.tokens
                    local = self.at - self.base
                    if local >= len(turns):
                        return
                    kept = self.system[1] if lead and self.at else 0
                    low = max(local - history, 1 - self.base if lead else 0, 0)
                    back, total = local, kept + tokens[local]
                    while back > low and total + tokens[back - 1] <= budget:
                        back -= 1
                        total += tokens[back]
                    end = local + 1
                    while end < len(turns) and total + tokens[end] <= budget:
                        total += tokens[end]
                        end += 1
                    if end == len(turns) and not final:
                        return
                    parts = ([self.system[0]] if lead and self.at else []) + turns[back:end]
                    n_old = len(parts) - (end - local)
                    text, spans = "", []
                    pieces = []
                    size = 0
                    for k, (role, body) in enumerate(parts):
                        one, a, b = turn_text(role, body)
                        if k >= n_old and role == LOSS_ROLE:
                            spans += [size + a, size + b]
                        size += len(one)
                        pieces.append(one)
                    text = "".join(pieces)
                    yield (self.conv, self.window, text, spans, n_old, self.at, total > budget)
                    self.window += 1
                    self.at = self.base + end
                    drop = max(0, end - history)
                    self.turns, self.tokens, self.base = turns[drop:], tokens[drop:], self.base + drop

        now, started = None, False
        for b in batches:
            convs, roles, texts = (b.column(k).to_pylist() for k in (0, 2, 3))
            counts = [len(x.ids) for x in coder.encode_batch_fast([turn_text(r, t)[0] for r, t in zip(roles, texts)], add_special_tokens=False)]
            out = []
            for conv, role, text, n in zip(convs, roles, texts, counts):
                if not started or conv != now.conv:
                    if started:
                        out += now.flush(True)
                    now, started = Open(conv), True
                if not now.base and not now.turns and role == SYSTEM_ROLE:
                    now.system = ((role, text), n)
                now.turns.append((role, text))
                now.tokens.append(n)
                if sum(now.tokens) > 2 * budget:
                    out += now.flush(False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names)
        if started and (out := list(now.flush(True))):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names)

    return dealt.mapInArrow(go, schema)


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.bool_())


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows say when read back, per conversation. Windows must stream in order, as `windows` gives them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row(s):
            return {"conv_id": s["conv"], "n_turns": s["n"], "turns_sha256": s["all"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["size"]}

        for b in batches:
            out = []
            for conv, text, spans, old in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        out.append(row(now))
                    now = {"conv": conv, "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                now["size"] += len(text)
                for role, body, _, _ in read_back(text)[old:]:
                    now["n"] += 1
                    now["all"].update(f"{role}\n{body}\n".encode())
                for a, e in zip(spans[::2], spans[1::2]):
                    body = unescape(text[a:e])
                    now["chars"] += len(body)
                    now["loss"].update(body.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(_DIGEST))
        if now is not None:
            yield pa.RecordBatch.from_pylist([row(now)], pa.schema(_DIGEST))

    return formatted.mapInArrow(go, schema)


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
