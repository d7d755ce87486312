"""URL rules with wildcards, matched all at once by a bit-parallel automaton.

All globs are packed side by side into the bits of a few 64-bit words, a bit for
each state. One step of the extended Shift-And automaton advances every pattern
for every URL of a block. Patterns see the canonical form of a URL, host rules
also the form in which it was given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. Host rules (globs without `//`) win over patterns; the longest name wins."""

    name: str
    verdict: str
    glob: str
    host: bool


def host_rule(verdict: str, name: str) -> Rule:
    """`host/path`: that host and its subdomains, and paths that start so."""
    return Rule(name, verdict, f"*.{name}**", True)


def pattern(verdict: str, glob: str) -> Rule:
    """A glob over `.host/path`; `*` stands for anything but `/`, `**` for anything, `?` for one character."""
    return Rule(glob, verdict, glob, False)


#: Words in hosts that the default patterns block.
BAD_HOSTS = (
    "casino", "spam", "cheap-pills", "poker", "sportsbet", "betting", "payday-loan", "torrent", "warez", "porn", "xxx-", "escort", "viagra", "replica-watch",
    "adserver", "doubleclick", "adclick", "malware", "phishing", "keygen", "cracked-", "free-ringtone", "linkfarm", "parked-domain",
)
RULES = (
    host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"), host_rule("block", "net/fr/"),
    *(pattern("block", f"*{w}*{rest}") for w in BAD_HOSTS for rest in ("", "/**")),
)
DEFAULT = "allow"
#: Symbols of URLs that are matched at once.
_CELLS = 1 << 22
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _decoded(m: re.Match) -> str:
    """Escapes of unreserved characters as those characters, others with capital digits."""
    return "".join(c if (c := chr(int(x, 16))) in _UNRESERVED else f"%{x.upper()}" for x in m[0].split("%")[1:])


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host without user, default port and final dot; path without dot segments and needless escapes, `/` if empty."""
    host = _ESCAPED.sub(_decoded, host.rpartition("@")[2]).lower()
    name, colon, port = host.rpartition(":")
    if colon and port in ("", "80", "443"):
        host = name
    out: list[str] = []
    parts = _ESCAPED.sub(_decoded, path).split("/")[1:]
    for i, p in enumerate(parts):
        if p == "..":
            del out[-1:]
        elif p != ".":
            out.append(p)
        if p in (".", "..") and i == len(parts) - 1:
            out.append("")
    return host.rstrip("."), "/" + "/".join(out)


class Automaton:
    """Shift-And over all globs: `step[c]` are the states that symbol c leads into, `stay[c]` those it stays in."""

    def __init__(self, globs: list[str]) -> None:
        symbols = sorted({c for g in globs for c in g if c not in "*?"} | {"/"})
        self.symbols = {c: i + 1 for i, c in enumerate(symbols)}
        size = len(symbols) + 1
        moves: list[tuple[int, int | None]] = []
        stays: list[tuple[int, bool]] = []
        self.first, self.last = [], []
        bit = 0
        for g in globs:
            self.first.append(bit)
            i = 0
            while i < len(g):
                if g[i] == "*":
                    deep = g[i : i + 2] == "**"
                    stays.append((bit, deep))
                    i += 1 + deep
                else:
                    bit += 1
                    moves.append((bit, None if g[i] == "?" else self.symbols[g[i]]))
                    i += 1
            self.last.append(bit)
            bit += 1
        self.words = -(-bit // 64)
        step = np.zeros((size, bit), bool)
        stay = np.zeros((size, bit), bool)
        for b, c in moves:
            step[slice(None) if c is None else c, b] = True
        slash = self.symbols["/"]
        for b, deep in stays:
            stay[:, b] = True
            stay[slash, b] &= deep
        self.step, self.stay = self._packed(step), self._packed(stay)
        start = np.zeros((1, bit), bool)
        start[0, self.first] = True
        self.start = self._packed(start)[0]

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide.reshape(len(bits), self.words, 64), axis=2, bitorder="little").view("<u8")[:, :, 0].astype(np.uint64)

    def match(self, strings: list[str]) -> np.ndarray:
        """A row for each string: which globs match all of it. Strings of like length go together, so that memory is bounded by the longest."""
        out, last = np.zeros((len(strings), len(self.last)), bool), np.array(self.last)
        order = np.argsort([-len(s) for s in strings], kind="stable")
        table_ = np.zeros(0x110000, np.uint8)
        for c, i in self.symbols.items():
            table_[ord(c)] = i
        at = 0
        while at < len(order):
            longest = max(1, len(strings[order[at]]))
            own = order[at : at + max(1, _CELLS // longest)]
            at += len(own)
            size = np.array([len(strings[i]) for i in own])
            coded = np.zeros((len(own), longest), np.uint8)
            coded[np.arange(longest) < size[:, None]] = table_[np.frombuffer("".join(strings[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)]
            state, columns = np.tile(self.start, (len(own), 1)), np.ascontiguousarray(coded.T)
            left = np.searchsorted(-size, -np.arange(longest), side="left")
            for n, symbols in zip(left.tolist(), columns, strict=True):
                c, now = symbols[:n], state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.step[c]) | (now & self.stay[c])
            out[own] = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1)
        return out


def _verdicts(rules: tuple[Rule, ...], default: str):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([r.glob for r in rules])
        rank = sorted(range(len(rules)), key=lambda i: (not rules[i].host, -len(rules[i].name), i))
        ordered = [rules[i] for i in rank]
        of_host = np.array([r.host for r in ordered], bool)
        for hosts, paths in batches:
            names, verdicts = [], []
            given = [f".{h}{p}" if h else "" for h, p in zip(hosts, paths, strict=True)]
            plain = [".{}{}".format(*canonical(h, p)) if h else "" for h, p in zip(hosts, paths, strict=True)]
            places = {u: i for i, u in enumerate(dict.fromkeys(given + plain))}
            hit = automaton.match(list(places))[:, rank]
            hit = np.where(of_host, hit[[places[u] for u in given]], hit[[places[u] for u in plain]])
            for row, any_ in zip(hit.argmax(1), hit.any(1), strict=True):
                r = ordered[row] if any_ else None
                names.append(r.name if r and r.host else None)
                verdicts.append(r.verdict if r else default)
            yield pd.DataFrame({"rule": names, "verdict": verdicts})

    return run


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (null if none) and verdict (allow or block) of each url.

    host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased;
    path: from there up to `?`, `#` or the end. A null url, or one without `://`,
    has both empty and the default verdict. Of the host rules that fit, the
    longest wins, the earlier of equal ones; without any, the longest pattern
    that fits the canonical URL gives the verdict, and without that the default.
    Repeated rows are the same each, however long; an empty table gives none.
    Columns of these names are replaced; rows and other columns stay.
    """
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    verdict = F.pandas_udf(_typed(_verdicts(rules, default)), "rule string, verdict string")
    out = pages.withColumn("__host", host).withColumn("path", path).withColumn("host", F.col("__host")).drop("__host")
    return out.withColumn("__v", verdict("host", "path")).withColumn("rule", F.col("__v.rule")).withColumn("verdict", F.col("__v.verdict")).drop("__v")


def _typed(run):
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return run(batches)

    return verdicts


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with p as (select page_id, coalesce(url, '') as u, strpos(coalesce(url, ''), '://') as a from pages),
r as (select page_id, case when a > 0 then substr(u, a + 3) else '' end as rest from p),
h as (select page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
f as (select *, '.' || host as s, host || path as all_ from h)
select page_id, host, path,
       case when suffix(s, '.www.example.com') and prefix(path, '/en/') then 'www.example.com/en/'
            when suffix(s, '.example.com') and prefix(path, '/en/') then 'example.com/en/'
            when suffix(s, '.net') and prefix(path, '/es/') then 'net/es/'
            when suffix(s, '.net') and prefix(path, '/fr/') then 'net/fr/'
            when suffix(s, '.com') and prefix(path, '/') then 'com/' end as rule,
       case when suffix(s, '.www.example.com') and prefix(path, '/en/') then 'allow'
            when suffix(s, '.example.com') and prefix(path, '/en/') then 'block'
            when suffix(s, '.net') and (prefix(path, '/es/') or prefix(path, '/fr/')) then 'block'
            when suffix(s, '.com') and prefix(path, '/') then 'allow'
            when regexp_matches(regexp_replace(host, '^.*@', ''), '{bad}') then 'block' else 'allow' end as verdict
from f
""".replace("{bad}", "|".join(BAD_HOSTS))
