"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after the other into a Shift-And automaton over several 64-bit words:
one bit per pattern position. A step shifts all patterns by one symbol and masks them with the
positions that accept the symbol; positions behind a wildcard stay set while it may run on. All
patterns run together over each canonical URL, and a batch of URLs runs together symbol by symbol.

Glob syntax over the bytes of `host` + `path`: `*` any run without `/`, `**` any run, `?` one
byte but `/`; everything else stands for itself. A host rule `example.com/en/` is the two globs
`example.com/en/**` and `*.example.com/en/**`.

Rows: null url or one without `://` has empty host and path, fits no rule, and is allowed. Rows
that repeat are judged each; an empty table gives an empty result. Long URLs are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): host suffix and path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: The method's own globs, for URLs that no rule fits: hosts that sell or farm links.
GLOBS = ("*spam*/**", "*spam*", "*cheap-pills*/**", "*cheap-pills*", "*casino*/**", "*casino*")


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_rule(rule: str) -> list[str]:
    """The globs of a host rule: the host itself and all its subdomains, and the path's start."""
    return [f"{rule}**", f"*.{rule}**"]


class Automaton:
    """Shift-And over all patterns. A pattern of m symbols has the states 0..m, state 0 on at the start."""

    def __init__(self, globs: list[str]):
        self.globs, states = globs, []  # per state: symbols that lead into it from the one before, symbols it stays on
        self.first, self.last = [], []
        slash = np.ones(256, bool)
        slash[ord("/")] = False
        for glob in globs:
            self.first.append(len(states))
            states.append([None, None])
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    wide = raw[i + 1 : i + 2] == b"*"
                    i += 2 if wide else 1
                    may = np.ones(256, bool) if wide else slash
                    states[-1][1] = may if states[-1][1] is None else states[-1][1] | may
                    continue
                into = slash.copy() if raw[i : i + 1] == b"?" else np.arange(256) == raw[i]
                states.append([into, None])
                i += 1
            self.last.append(len(states) - 1)
        self.words = -(-len(states) // 64)
        self.start = np.zeros(self.words, np.uint64)
        self.into = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        bit = lambda s: (s // 64, np.uint64(1 << (s % 64)))
        for s in self.first:
            w, b = bit(s)
            self.start[w] |= b
        for s, (into, stay) in enumerate(states):
            w, b = bit(s)
            if into is not None:
                self.into[into, w] |= b
            if stay is not None:
                self.stay[stay, w] |= b

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text and glob whether the glob fits the whole text."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for at in range(0, len(texts), 4096):  # texts of about one length together
            part = order[at : at + 4096]
            size = np.array([len(texts[i]) for i in part])
            data = np.zeros((len(part), max(1, size[0])), np.uint8)
            for r, i in enumerate(part):
                data[r, : size[r]] = np.frombuffer(texts[i], np.uint8)
            state = np.repeat(self.start[None], len(part), axis=0)
            for k in range(size[0]):
                n = int(np.searchsorted(-size, -k, "left"))  # rows longer than k
                d, c = state[:n], data[:n, k]
                up = d << np.uint64(1)
                up[:, 1:] |= d[:, :-1] >> np.uint64(63)  # carry into the next word
                state[:n] = up & self.into[c] | d & self.stay[c]
            for g, s in enumerate(self.last):
                out[part, g] = state[:, s // 64] >> np.uint64(s % 64) & np.uint64(1) == 1
        return out


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. Of the rules that fit the longest wins."""
    patterns = [g for r, _ in rules for g in host_rule(r)] + list(globs)
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(patterns)
        for b in batches:
            hit = automaton.match([(h + p).encode() for h, p in zip(b["host"], b["path"])])
            rule, verdict = np.full(len(b), None, object), np.where(hit[:, 2 * len(rules) :].any(1), "block", "allow").astype(object)
            for i in reversed(order):
                fits = hit[:, 2 * i] | hit[:, 2 * i + 1]
                rule[fits], verdict[fits] = rules[i]
            yield b.assign(rule=rule, verdict=verdict)

    host, path = canonical(F.col(url_col))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
