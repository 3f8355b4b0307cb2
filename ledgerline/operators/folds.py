"""Ordered folds: semantics in which each row's outcome depends on earlier outcomes of its key.

``fold`` streams a key's rows in order through a small state machine; only the state is held, so a key may be long.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wake classes by rank. Fixed values.
RANKS = {"control": 8, "ask": 7, "task": 6, "answer": 5, "report": 4, "ack": 3, "expired": 2, "undeliverable": 1, "note": 0}


def fold(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """``step(state, row)`` gives output rows. Rows are hashed by key and sorted within tasks, then streamed in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                if row[key] != now:
                    now, state = row[key], start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


class WakeBudget:
    """At most ``most`` wakes in any ``window`` ms; ``control`` is exempt."""

    def __init__(self, most: int = 6, window: int = 60_000):
        self.most, self.window = most, window
        self.stamps: deque[int] = deque()

    def admit(self, now: int, kind: str) -> tuple[str, int | None]:
        while self.stamps and now - self.stamps[0] >= self.window:
            self.stamps.popleft()
        if kind == "note":
            return "SilentNote", None
        if kind != "control":
            if len(self.stamps) >= self.most:
                return "Throttled", self.window - (now - self.stamps[0])
            self.stamps.append(now)
        return "Wake", None


def wake_budget(rows: DataFrame, most: int = 6, window: int = 60_000) -> DataFrame:
    """rows: key, at, ms, kind. Each row's decision and, if throttled, the wait."""
    return fold(rows, "key", "at", lambda: WakeBudget(most, window), lambda s, r: [(r["key"], r["at"], *s.admit(r["ms"], r["kind"]))], "key long, at long, decision string, retry_ms long")


def leases(rows: DataFrame) -> DataFrame:
    """rows: node, at, worker, ms, ttl, commit. A claim takes a free or expired lease, its holder renews it; claims after the commit are ignored."""

    def step(state: dict, r: dict) -> list[tuple]:
        if state.get("done"):
            return [(r["node"], r["at"], state["worker"], False)]
        if r["commit"]:
            state["done"] = True
            state.setdefault("worker", r["worker"])
            return [(r["node"], r["at"], state["worker"], False)]
        if "worker" not in state or state["worker"] == r["worker"] or state["expiry"] <= r["ms"]:
            same = state.get("worker") == r["worker"]
            state["expiry"] = max(state.get("expiry", 0) if same else 0, r["ms"] + r["ttl"])
            state["worker"] = r["worker"]
            return [(r["node"], r["at"], r["worker"], True)]
        return [(r["node"], r["at"], state["worker"], False)]

    return fold(rows, "node", "at", dict, step, "node long, at long, holder long, granted boolean")


def control_token(rows: DataFrame) -> DataFrame:
    """rows: key, at, verb, by, to. ``claim`` always takes; ``grant`` only by the holder."""

    def step(state: dict, r: dict) -> list[tuple]:
        if r["verb"] == "claim":
            state["holder"] = r["by"]
        elif state.get("holder") == r["by"]:
            state["holder"] = r["to"]
        return [(r["key"], r["at"], state.get("holder"))]

    return fold(rows, "key", "at", dict, step, "key long, at long, holder long")


def sticky_fence(rows: DataFrame) -> DataFrame:
    """rows: producer, at, seq, verb (publish, refuse, commit). A refusal latches the lowest refused sequence; later ones are refused until a commit at or below it."""

    def step(state: dict, r: dict) -> list[tuple]:
        fence = state.get("fence")
        if r["verb"] == "refuse":
            state["fence"] = r["seq"] if fence is None else min(fence, r["seq"])
            return [(r["producer"], r["at"], False)]
        if r["verb"] == "commit" and fence is not None and r["seq"] <= fence:
            state["fence"] = None
            return [(r["producer"], r["at"], True)]
        return [(r["producer"], r["at"], fence is None or r["seq"] <= fence)]

    return fold(rows, "producer", "at", dict, step, "producer long, at long, accepted boolean")


def hash_chain(rows: DataFrame) -> DataFrame:
    """rows: key, at, body. Each row's hash covers its body and the hash before it."""

    def step(state: dict, r: dict) -> list[tuple]:
        state["h"] = hashlib.sha256((state.get("h", "") + "|" + r["body"]).encode()).hexdigest()
        return [(r["key"], r["at"], state["h"])]

    return fold(rows, "key", "at", dict, step, "key long, at long, hash string")


def commit_hash(parent: str | None, at: int, ts: int, tag: int, text: str, domain: bytes = b"ledgerline-node") -> str:
    """A commit's digest: domain, place and logical time (eight bytes each), the number of parents and the parent, the record's tag, length and bytes."""
    body = text.encode()
    parts = at.to_bytes(8, "little") + ts.to_bytes(8, "little") + (b"\x01" + bytes.fromhex(parent) if parent else b"\x00") + bytes([tag]) + len(body).to_bytes(8, "little")
    return hashlib.sha256(domain + parts + body).hexdigest()


def commit_chain(rows: DataFrame) -> DataFrame:
    """rows: key, at, ts, tag, text. The commit of each record over the one before it."""

    def step(state: dict, r: dict) -> list[tuple]:
        state["h"] = commit_hash(state.get("h"), r["at"], r["ts"], r["tag"], r["text"])
        return [(r["key"], r["at"], state["h"])]

    return fold(rows, "key", "at", dict, step, "key long, at long, hash string")


def verify_chain(rows: DataFrame) -> DataFrame:
    """rows: key, at, ts, tag, text, parent, hash. Each key's first fault by place, or Verified: a gap, another parent than the commit before, a digest that differs."""

    def step(state: dict, r: dict) -> list[tuple]:
        expected, before = state.get("n", 0), state.get("h")
        state["n"], state["h"] = expected + 1, r["hash"]
        parent = r["parent"] if isinstance(r["parent"], str) else None
        if r["at"] != expected:
            return [(r["key"], expected, "NonDenseOffset")]
        if parent != before:
            return [(r["key"], r["at"], "BrokenParentLink")]
        if commit_hash(parent, r["at"], r["ts"], r["tag"], r["text"]) != r["hash"]:
            return [(r["key"], r["at"], "HashMismatch")]
        return []

    faults = fold(rows, "key", "at", dict, step, "key long, at long, verdict string")
    first = faults.groupBy("key").agg(F.min_by(F.struct("at", "verdict"), "at").alias("f"))
    return rows.select("key").distinct().join(first, "key", "left").select("key", F.col("f.at").alias("at"), F.coalesce("f.verdict", F.lit("Verified")).alias("verdict"))


MARK = re.compile(r"\x1b\](?:133|633);([ACD])([^\x07\x1b]*)(?:\x07|\x1b\\)")
KINDS = {"A": "PromptReady", "C": "CommandStart", "D": "CommandEnd"}
CARRIED = 32


def scan_marks(carry: str, text: str) -> tuple[list[tuple[str, int | None]], str]:
    """(kind, exit) of the marks that end in ``text``, and what of a split one is carried on (at most 32 characters)."""
    text = carry + text
    out, end = [], 0
    for m in MARK.finditer(text):
        code = re.fullmatch(r";(-?\d{1,10})(?:;.*)?", m[2])
        out.append((KINDS[m[1]], int(code[1]) if m[1] == "D" and code and -(2**31) <= int(code[1]) < 2**31 else None))
        end = m.end()
    start = text.rfind("\x1b]", end)
    start = len(text) - 1 if start < 0 and text[end:].endswith("\x1b") else start
    return out, text[start:] if start >= 0 and len(text) - start <= CARRIED else ""


def osc_marks(rows: DataFrame) -> DataFrame:
    """rows: key, at, text. Shell marks in order; one that is split is carried and belongs to the record that ends it."""

    def step(state: dict, r: dict) -> list[tuple]:
        found, state["carry"] = scan_marks(state.get("carry", ""), r["text"])
        return [(r["key"], r["at"], *m) for m in found]

    return fold(rows, "key", "at", dict, step, "key long, at long, kind string, exit int")


def rate_bucket(rows: DataFrame, rate_ms: int = 1000, burst: int = 3) -> DataFrame:
    """rows: key, at, ms. A token comes every ``rate_ms``, up to ``burst``; a record takes one or is refused with the wait.

    The state is the instant at which the bucket would be full again: no fractions.
    """

    def step(state: dict, r: dict) -> list[tuple]:
        full = max(state.get("full", r["ms"]), r["ms"])
        wait = full + rate_ms - r["ms"] - burst * rate_ms
        if wait > 0:
            return [(r["key"], r["at"], False, wait)]
        state["full"] = full + rate_ms
        return [(r["key"], r["at"], True, 0)]

    return fold(rows, "key", "at", dict, step, "key long, at long, accepted boolean, wait_ms long")


#: What a line discipline shows for control input: carriage return and line feed as both, rubout as back, space, back. Fixed values.
ECHOES = {"\r": "\r\n", "\n": "\r\n", "\x7f": "\x08 \x08", "\x08": "\x08 \x08"}
#: Escape sequences of keys, which show nothing.
KEY_SEQUENCE = re.compile(r"\x1b(?:\[[ -?]*[@-~]|[\]PX^_].*?(?:\x07|\x1b\\\\)|[ -/]*[0-~])", re.S)


def echo_of(text: str) -> list[str]:
    """What each character of an input shows: itself, or a caret and a letter for control characters."""
    return [ECHOES.get(c) or (f"^{chr(ord(c) + 64)}" if c < " " and c != "\t" else c) for c in KEY_SEQUENCE.sub("", text)]


class EchoQueue:
    """Inputs whose echo is awaited, first in first out; output is matched to them character by character."""

    def __init__(self):
        self.waiting: deque[list] = deque()  # [offset of the input, what its character shows]
        self.newest: int | None = None

    def put(self, at: int, text: str) -> None:
        self.waiting += ([at, shown] for shown in echo_of(text))

    def answer(self, out: str) -> list[tuple[int, int, int]]:
        """(input, from, to) of the parts of an output that echo inputs; the rest is the program's own."""
        spans: list[tuple[int, int, int]] = []
        i = 0
        while i < len(out) and self.waiting:
            at, shown = self.waiting[0]
            if shown == "\x08 \x08" and out[i] == "^" and out[i + 1 : i + 2] in ("", "?"):
                self.waiting[0][1] = shown = "^?"  # rubouts may be shown so
            if out[i] == shown[0]:
                rest = shown[1:]
            elif shown == "\r\n" and out[i] == "\n":
                rest = ""  # a bare line feed will do
            else:
                break
            i += 1
            self.newest = at if self.newest is None else max(at, self.newest)
            spans = [*spans[:-1], (at, spans[-1][1], i)] if spans and spans[-1][0] == at and spans[-1][2] == i - 1 else [*spans, (at, i - 1, i)]
            if rest:
                self.waiting[0][1] = rest
            else:
                self.waiting.popleft()
        return spans


def attribute_echoes(rows: DataFrame) -> DataFrame:
    """rows: key, at, kind (In, Out), text. For each output that echoes inputs: the span of each, and the newest input seen so far."""

    def step(state: EchoQueue, r: dict) -> list[tuple]:
        if r["kind"] == "In":
            state.put(r["at"], r["text"])
            return []
        return [(r["key"], r["at"], at, a, b, state.newest) for at, a, b in state.answer(r["text"])] if r["kind"] == "Out" else []

    return fold(rows, "key", "at", EchoQueue, step, "key long, at long, input long, begin int, end int, newest long")


def predict(rows: DataFrame) -> DataFrame:
    """rows: key, at, kind (In, Out), text. Each input's echo is shown at once; the verdict on it comes with the output.

    Right: all of an input's echo came; wrong: the output went on otherwise, and what else was predicted is dropped.
    """

    def step(state: EchoQueue, r: dict) -> list[tuple]:
        if r["kind"] == "In":
            state.put(r["at"], r["text"])
            return []
        if r["kind"] != "Out" or not state.waiting:
            return []
        inputs = dict.fromkeys(at for at, _ in state.waiting)
        echoed = sum(b - a for _, a, b in state.answer(r["text"]))
        left = dict.fromkeys(at for at, _ in state.waiting)
        out = [(r["key"], at, r["at"], "Right") for at in inputs if at not in left]
        if echoed < len(r["text"]) and left:
            state.waiting.clear()
            out += [(r["key"], at, r["at"], "Wrong") for at in left]
        return out

    return fold(rows, "key", "at", EchoQueue, step, "key long, input long, at long, verdict string")
