"""URL filters: glob rules packed into multiword Shift-And masks and simulated together over each canonical URL.

A glob's `*` stands for any run of characters but "/", `**` for any run at all, `?` for one character but "/".
Every pattern owns a run of bits, one for each number of literals matched so far; a step over a character shifts
all bits at once, keeps those that the character allows, and keeps the self-loops of the stars.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, ship, slices, utf8

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the start of the path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        def plain(x: str) -> str:
            return "".join("\\" + c if c in "*?\\" else c for c in x)

        return [f"{plain(self.name)}**", f"*.{plain(self.name)}**"]


class ShiftAnd:
    """Masks for a list of byte-wise glob patterns; matches(data, offsets) gives a matrix texts x patterns."""

    def __init__(self, patterns: list[str]):
        lay: list[tuple[int, list]] = []
        bit = 0
        for pattern in patterns:
            tokens, raw, k = [], pattern.encode(), 0
            while k < len(raw):
                c = raw[k : k + 1]
                if c == b"\\" and k + 1 < len(raw):
                    tokens.append(raw[k + 1])
                    k += 2
                elif c == b"*":
                    both = raw[k : k + 2] == b"**"
                    tokens.append("**" if both else "*")
                    k += 1 + both
                elif c == b"?":
                    tokens.append("?")
                    k += 1
                else:
                    tokens.append(raw[k])
                    k += 1
            lay.append((bit, tokens))
            bit += 1 + sum(t not in ("*", "**") for t in tokens)
        self.words = max(1, -(-bit // 64))
        self.still = np.zeros(self.words, np.uint64)  # last states with a loop over all characters: they stay for good
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[int] = []
        others = [c for c in range(256) if c != 47]
        for at, tokens in lay:
            self._set(self.start, at)
            state = at
            for t in tokens:
                if t in ("*", "**"):
                    self._set_rows(self.loop, range(256) if t == "**" else others, state)
                else:
                    state += 1
                    self._set_rows(self.step, others if t == "?" else [t], state)
            self.accept.append(state)
            if tokens and tokens[-1] == "**":
                self._set(self.still, state)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= U64(1) << U64(bit & 63)

    def _set_rows(self, table: np.ndarray, rows, bit: int) -> None:
        table[list(rows), bit >> 6] |= U64(1) << U64(bit & 63)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A text is followed until it ends or until only states that stay for good are left, however long it is."""
        at, end = offsets[:-1].copy(), offsets[1:]
        state = np.tile(self.start, (len(at), 1))
        live, k = np.flatnonzero(at < end), 0
        while len(live):
            c, now = data[at[live]], state[live]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            now = (moved & self.step[c]) | (now & self.loop[c])
            state[live] = now
            at[live] += 1
            k += 1
            open_ = at[live] < end[live]
            if k % 16 == 0:
                open_ &= (now & ~self.still).any(axis=1)
            live = live[open_]
        out = np.zeros((len(at), len(self.accept)), bool)
        for p, bit in enumerate(self.accept):
            out[:, p] = (state[:, bit >> 6] >> U64(bit & 63)) & U64(1) == U64(1)
        return out


def url_parts(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without "://"."""
    known = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(known, URL_PARTS, 1), _ASCII_UPPER, _ASCII_LOWER), F.regexp_extract(known, URL_PARTS, 2)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule (the longest that fits, else null) and verdict (the rule's, else default).

    Null urls and urls without "://" have an empty host and path and fit no rule.  Ties in length go to the earlier
    rule.  Repeated rows each get a result; other columns are ignored.  One narrow stage, no shuffle.  A long url costs
    no more than the part of it that decides: after that the automaton stands still.
    """
    ship(pages.sparkSession)
    machine = ShiftAnd([g for r in rules for g in r.globs()])
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    names = np.array([r.name for r in rules] + [None], object)
    says = np.array([r.verdict for r in rules] + [default], object)
    host, path = url_parts(url)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            canonical, offsets = utf8(batch.column("canonical"))
            for a, b in slices(offsets, 1 << 20):
                fits = machine.matches(canonical[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                fits = fits[:, 0::2] | fits[:, 1::2]
                best = np.full(b - a, len(rules))
                for i in reversed(ranked):
                    best[fits[:, i]] = i
                own = [batch.column(c).slice(a, b - a) for c in (key, "host", "path")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[best], pa.string()), pa.array(says[best], pa.string())], [key, "host", "path", "rule", "verdict"])

    # Rules name a path that starts with "/", so the joined text splits in one way only.
    parts = pages.select(key, host.alias("host"), path.alias("path")).withColumn("canonical", F.concat("host", "path"))
    return parts.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
