"""URL rules, matched all at once by a bit-parallel wildcard automaton.

Each rule (host, path) is the glob ``*.host`` + ``path**`` over the canonical url ``"." + host + path``;
``*`` runs over anything but "/", ``**`` over anything and ``?`` takes one byte.  The globs' states are
packed into 64-bit words, and one Shift-And step a byte moves every state of every rule for a whole
batch of urls.  Nothing is shuffled; what is broadcast are the rules' masks.

Null urls, and those without "://", have an empty host and path and fit no rule.  Of several rules that
fit, the longest wins, and of equally long ones the first.  Urls are whole, however long; repeated rows get equal
verdicts, an empty table gives an empty one.  Columns of the new names are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.shared import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BITS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


class ShiftAnd:
    """Globs as one automaton. State k of a glob: its first k literals are matched; a star is a loop on a state."""

    def __init__(self, globs: list[str]):
        literals: list[list[int]] = []
        loops: list[dict[int, bool]] = []
        for glob in globs:
            own, loop, at, raw = [], {}, 0, glob.encode()
            while at < len(raw):
                if raw[at] == 42:
                    every = raw[at : at + 2] == b"**"
                    loop[len(own)] = every or loop.get(len(own), False)
                    at += 1 + every
                else:
                    own.append(-1 if raw[at] == 63 else raw[at])
                    at += 1
            literals.append(own)
            loops.append(loop)
        n = sum(len(x) + 1 for x in literals)
        self.words = max(1, -(-n // WORD_BITS))
        step, stay = np.zeros((256, n), bool), np.zeros((256, n), bool)
        start, accept, absorb, at = np.zeros(n, bool), [], np.zeros(n, bool), 0
        for own, loop in zip(literals, loops):
            start[at] = True
            for k, byte in enumerate(own, 1):
                step[slice(None) if byte < 0 else byte, at + k] = True
            for k, every in loop.items():
                stay[:, at + k] = True
                stay[47, at + k] = every
                absorb[at + k] |= every and k == len(own)
            accept.append(at + len(own))
            at += len(own) + 1
        self.step, self.stay = self._pack(step), self._pack(stay)
        self.start, self.live = self._pack(start[None])[0], ~self._pack(absorb[None])[0]
        self.accept = np.array(accept, np.int64)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((bits.shape[0], self.words * WORD_BITS), bool)
        out[:, : bits.shape[1]] = bits
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs): which whole text fits which glob."""
        out = np.zeros((len(texts), len(self.accept)), bool)
        sizes = np.array([len(t) for t in texts], np.int64)
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            stop = at + 1  # urls of like length together, so that the padding stays small
            while stop < len(order) and (stop - at) * sizes[order[stop]] < 1 << 21 and sizes[order[stop]] <= 2 * sizes[order[at]] + 16:
                stop += 1
            out[order[at:stop]] = self._run([texts[i] for i in order[at:stop]], sizes[order[at:stop]])
            at = stop
        return out

    def _run(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        width = int(sizes[-1])
        chars = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
        state, first = np.tile(self.start, (len(texts), 1)), 0
        for k in range(width):
            first = int(np.searchsorted(sizes, k, side="right"))  # texts before it have ended
            now, c = state[first:], chars[first:, k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[first:] = (moved & self.step[c]) | (now & self.stay[c])
            if k % 32 == 31 and not (state[first:] & self.live).any():
                break  # only final states are left, and they stay
        return (state[:, self.accept >> 6] >> (self.accept & 63).astype(np.uint64)) & np.uint64(1) > 0


def longest_rule(urls: Column, rules: list[Rule]) -> Column:
    """The index of the rule that decides a canonical url, or null."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), k))
    globs = [rules[k].glob for k in order]

    @F.pandas_udf("int")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, index = ShiftAnd(globs), np.array(order)
        for batch in batches:
            fits = automaton.run([x.encode("utf-8", "surrogatepass") for x in batch])
            best = index[fits.argmax(axis=1)]
            yield pd.Series(pd.array(best, dtype="Int32")).where(pd.Series(fits.any(axis=1)), None)

    return match(urls)


def judge(urls: DataFrame, rules: list[Rule], column: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null: none fits) and verdict; columns of these names are replaced."""
    if not rules:
        raise ValueError("no rules")
    names = F.array(*[F.lit(r.text) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    own = fresh([*urls.columns, "host", "path", "rule", "verdict"], "number")
    url = F.col(f"`{column}`")
    out = urls.withColumn(own, longest_rule(F.concat(F.lit("."), host_of(url), path_of(url)), rules))
    return out.withColumns({"host": host_of(url), "path": path_of(url), "rule": F.get(names, F.col(own)), "verdict": F.coalesce(F.get(verdicts, F.col(own)), F.lit(default))}).drop(own)
