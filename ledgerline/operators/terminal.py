"""A terminal screen folded from its output: printable text, control characters, cursor movement, erasing, scrolling."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"\x1b\[([?>=!]?)([0-9;:]*)([ -/]*)([@-~])|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[PX^_].*?\x1b\\|\x1b[()*+].|\x1b([78DEMc=>])|[\x00-\x1a\x1c-\x1f\x7f]|[^\x00-\x1f\x7f]+", re.S)
#: A sequence that goes on in the next record.
OPEN = re.compile(r"\x1b(?:\[[0-?]*[ -/]*|\][^\x07\x1b]*\x1b?|[PX^_][^\x1b]*\x1b?|[()*+])?\Z", re.S)
LONGEST = 4096


def width(c: str) -> int:
    """Columns of a character: none for marks, two for wide ones."""
    if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


class Screen:
    def __init__(self, cols: int, rows: int):
        self.cols, self.rows = max(cols, 1), max(rows, 1)
        self.reset()

    def reset(self) -> None:
        self.cells = [[" "] * self.cols for _ in range(self.rows)]
        self.row = self.col = 0
        self.top, self.bottom, self.wrap = 0, self.rows - 1, False
        self.saved, self.main, self.rest = (0, 0), None, ""

    def resize(self, cols: int, rows: int) -> None:
        """Columns are cut or filled at the right; rows that no longer fit go from the top."""
        cols, rows = max(cols, 1), max(rows, 1)
        cells = [(line + [" "] * cols)[:cols] for line in self.cells]
        gone = max(0, self.row - rows + 1)
        cells = (cells[gone : gone + rows] + [[" "] * cols for _ in range(rows)])[:rows]
        self.cells, self.cols, self.rows = cells, cols, rows
        self.row, self.col = self.row - gone, min(self.col, cols - 1)
        self.top, self.bottom, self.wrap = 0, rows - 1, False

    def down(self) -> None:
        if self.row == self.bottom:
            block = self.cells[self.top : self.bottom + 1]
            self.cells[self.top : self.bottom + 1] = block[1:] + [[" "] * self.cols]
        elif self.row < self.rows - 1:
            self.row += 1

    def up(self) -> None:
        if self.row == self.top:
            block = self.cells[self.top : self.bottom + 1]
            self.cells[self.top : self.bottom + 1] = [[" "] * self.cols] + block[:-1]
        elif self.row:
            self.row -= 1

    def write(self, text: str) -> None:
        for c in text:
            w = width(c)
            if not w:
                at = self.col if self.wrap else self.col - 1
                if at >= 0:
                    self.cells[self.row][at] += c
                continue
            if self.wrap or self.col + w > self.cols:
                self.col, self.wrap = 0, False
                self.down()
            self.cells[self.row][self.col] = c
            if w == 2 and self.col + 1 < self.cols:
                self.cells[self.row][self.col + 1] = ""
            if self.col + w >= self.cols:
                self.col, self.wrap = self.cols - 1, True
            else:
                self.col += w

    def feed(self, text: str) -> None:
        text, self.rest = self.rest + text, ""
        if (m := OPEN.search(text)) and len(m[0]) < LONGEST:
            text, self.rest = text[: m.start()], m[0]
        for m in TOKEN.finditer(text):
            t = m[0]
            if m[4]:
                self.csi(m[1], [int(x) if x.isdigit() else 0 for x in re.split("[;:]", m[2])] if m[2] else [], m[4])
            elif m[5]:
                self.escape(m[5])
            elif t[0] >= " " and t[0] != "\x7f":
                self.write(t)
            elif t in "\n\x0b\x0c":
                self.wrap = False
                self.down()
            elif t == "\r":
                self.col, self.wrap = 0, False
            elif t == "\x08":
                self.col, self.wrap = max(0, self.col - 1), False
            elif t == "\t":
                self.col = min(self.cols - 1, (self.col // 8 + 1) * 8)

    def escape(self, c: str) -> None:
        if c == "7":
            self.saved = self.row, self.col
        elif c == "8":
            self.row, self.col = min(self.saved[0], self.rows - 1), min(self.saved[1], self.cols - 1)
        elif c == "D":
            self.down()
        elif c == "E":
            self.col = 0
            self.down()
        elif c == "M":
            self.up()
        elif c == "c":
            self.reset()

    def csi(self, private: str, p: list[int], final: str) -> None:
        n = max(1, p[0] if p else 1)
        self.wrap = False
        line = self.cells[self.row]
        if private:
            if private == "?" and final in "hl" and p and p[0] in (47, 1047, 1049):
                if final == "h" and self.main is None:
                    self.main = ([list(x) for x in self.cells], self.row, self.col)
                    self.cells = [[" "] * self.cols for _ in range(self.rows)]
                elif final == "l" and self.main is not None:
                    cells, self.row, self.col = self.main
                    self.cells, self.main = [(x + [" "] * self.cols)[: self.cols] for x in cells[: self.rows]], None
                    self.cells += [[" "] * self.cols for _ in range(self.rows - len(self.cells))]
                    self.row, self.col = min(self.row, self.rows - 1), min(self.col, self.cols - 1)
        elif final in "Hf":
            self.row = min(self.rows, max(1, p[0] if p else 1)) - 1
            self.col = min(self.cols, max(1, p[1] if len(p) > 1 else 1)) - 1
        elif final in "ABCD":
            d = {"A": (-n, 0), "B": (n, 0), "C": (0, n), "D": (0, -n)}[final]
            self.row = min(self.rows - 1, max(0, self.row + d[0]))
            self.col = min(self.cols - 1, max(0, self.col + d[1]))
        elif final in "G`":
            self.col = min(self.cols, n) - 1
        elif final == "d":
            self.row = min(self.rows, n) - 1
        elif final in "EF":
            self.col, self.row = 0, min(self.rows - 1, max(0, self.row + (n if final == "E" else -n)))
        elif final in "JK":
            kind = p[0] if p else 0
            lo, hi = {0: (self.col, self.cols), 1: (0, self.col + 1)}.get(kind, (0, self.cols))
            line[lo:hi] = [" "] * (hi - lo)
            if final == "J":
                for r in {0: range(self.row + 1, self.rows), 1: range(self.row)}.get(kind, range(self.rows)):
                    self.cells[r] = [" "] * self.cols
        elif final == "X":
            hi = min(self.cols, self.col + n)
            line[self.col : hi] = [" "] * (hi - self.col)
        elif final == "P":
            line[self.col :] = (line[self.col + n :] + [" "] * self.cols)[: self.cols - self.col]
        elif final == "@":
            line[self.col :] = ([" "] * n + line[self.col :])[: self.cols - self.col]
        elif final in "LM" and self.top <= self.row <= self.bottom:
            block, n = self.cells[self.row : self.bottom + 1], min(n, self.bottom - self.row + 1)
            blank = [[" "] * self.cols for _ in range(n)]
            self.cells[self.row : self.bottom + 1] = blank + block[: len(block) - n] if final == "L" else block[n:] + blank
            self.col = 0
        elif final in "ST":
            block, n = self.cells[self.top : self.bottom + 1], min(n, self.bottom - self.top + 1)
            blank = [[" "] * self.cols for _ in range(n)]
            self.cells[self.top : self.bottom + 1] = block[n:] + blank if final == "S" else blank + block[: len(block) - n]
        elif final == "r":
            top, bottom = (p[0] or 1 if p else 1), (p[1] or self.rows if len(p) > 1 else self.rows)
            if 1 <= top < bottom <= self.rows:
                self.top, self.bottom, self.row, self.col = top - 1, bottom - 1, 0, 0
        elif final == "s":
            self.saved = self.row, self.col
        elif final == "u":
            self.row, self.col = min(self.saved[0], self.rows - 1), min(self.saved[1], self.cols - 1)

    def text(self) -> list[str]:
        return ["".join(line).rstrip() for line in self.cells]

    def dump(self) -> str:
        """All state as text; ``load`` goes on from there."""
        return json.dumps([self.cols, self.rows, self.cells, self.row, self.col, self.top, self.bottom, self.wrap, self.saved, self.main, self.rest])

    @classmethod
    def load(cls, text: str) -> Screen:
        cols, rows, *rest = json.loads(text)
        out = cls(cols, rows)
        out.cells, out.row, out.col, out.top, out.bottom, out.wrap, out.saved, out.main, out.rest = rest
        return out

    def apply(self, r) -> None:
        if r.kind == "Out":
            self.feed(r.text)
        elif r.kind == "Resize":
            self.resize(int(r.cols), int(r.rows))

    def hash(self) -> str:
        """Of what is shown: size, cells and cursor."""
        return f"{xxhash.xxh3_64_intdigest(json.dumps([self.cols, self.rows, self.cells, self.row, self.col])):016x}"


def _each(batches: Iterator[pd.DataFrame], cols: int, rows: int) -> Iterator[tuple]:
    """(row, screen after it, whether the key ends there is told by the next) of sorted records; a Snapshot record sets the state."""
    key = screen = None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if screen is None or r.key != key:
                key, screen = r.key, Screen(cols, rows)
            if r.kind == "Snapshot":
                screen = Screen.load(r.text)
            else:
                screen.apply(r)
            yield r, screen


def _folded(records: DataFrame, cols: int, rows: int, schema: str, row: Callable[[object, Screen], tuple], last_only: bool) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, before = [], None
        for r, screen in _each(batches, cols, rows):
            if last_only:
                if before is not None and before[0].key != r.key:
                    out.append(row(*before))
                before = r, screen
            elif r.kind != "Snapshot":
                out.append(row(r, screen))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if before is not None:
            out.append(row(*before))
        if out:
            yield pd.DataFrame(out, columns=names)

    return records.repartition("key").sortWithinPartitions("key", "at").mapInPandas(fold, schema)


def fold_screens(records: DataFrame, cols: int = 80, rows: int = 24) -> DataFrame:
    """records: key, at, kind (Out, Resize, others paint nothing), text, cols, rows. Each key's final screen, rows streamed in order."""
    return _folded(records, cols, rows, "key long, screen string, row int, col int", lambda r, s: (r.key, "\n".join(s.text()).rstrip("\n"), s.row, s.col), True)


def frames(records: DataFrame, cols: int = 80, rows: int = 24) -> DataFrame:
    """(key, at, hash, last_line) after each record: a hash of what is shown, and the last line with text."""
    return _folded(records, cols, rows, "key long, at long, hash string, last_line string", lambda r, s: (r.key, r.at, s.hash(), next((t for t in reversed(s.text()) if t), "")), False)


def materialize(records: DataFrame, cut: DataFrame | None = None, cols: int = 80, rows: int = 24) -> DataFrame:
    """Snapshots (key, folded_through, state, screen) of each key's records up to its offset in ``cut`` (key, upto); all without one."""
    part = records if cut is None else records.join(cut.select(F.col("key").alias("__k"), "upto"), F.col("key") == F.col("__k")).where("at <= upto").drop("__k", "upto")
    return _folded(part, cols, rows, "key long, folded_through long, state string, screen string", lambda r, s: (r.key, r.at, s.dump(), "\n".join(s.text()).rstrip("\n")), True)


def resume(snapshots: DataFrame, records: DataFrame, cols: int = 80, rows: int = 24) -> DataFrame:
    """Each key's final screen from its snapshot and the records after it; equal to the fold of all. A key without a snapshot starts anew."""
    known = snapshots.select(F.col("key").alias("__k"), "folded_through")
    rest = records.join(known, F.col("key") == F.col("__k"), "left").where("folded_through IS NULL OR at > folded_through").drop("__k", "folded_through")
    first = snapshots.select("key", F.col("folded_through").alias("at"), F.lit("Snapshot").alias("kind"), F.col("state").alias("text"), F.lit(cols).alias("cols"), F.lit(rows).alias("rows"))
    return fold_screens(rest.select(*first.columns).union(first), cols, rows)


#: Ends of a line that mean that a program waits, by profile. Fixed values.
PROFILES = {
    "common": ["❯", ">>>", "$", "%", "#"],
    "claude": ["❯"],
    "codex": [],
    "repl": [">>>", "...", "irb>", "iex>", "sqlite>"],
    "emacs": ["ELISP>", "Eval:", "M-x", "eshell>"],
    "shell": ["$", "%", "#"],
    "none": [],
}


def settled(records: DataFrame, profile: str = "common", cols: int = 80, rows: int = 24) -> DataFrame:
    """(key, quiesced, prompt): the last record that changed a key's screen, and whether the last line with text there ends like a prompt of the profile."""
    shown = frames(records, cols, rows)
    before = F.lag("hash").over(Window.partitionBy("key").orderBy("at"))
    changed = shown.withColumn("before", before).where("NOT (before <=> hash)")
    marks = PROFILES[profile]
    ends = F.lit(False)
    for m in marks:
        ends = ends | F.endswith(F.rtrim("last_line"), F.lit(m))
    return changed.groupBy("key").agg(F.max(F.struct("at", "last_line")).alias("l")).select("key", F.col("l.at").alias("quiesced"), F.col("l.last_line").alias("last_line")).select("key", "quiesced", ends.alias("prompt"))
