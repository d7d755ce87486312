"""Secrets in texts: fixed patterns, and formats inferred from the credentials they find.

From the values of each kind, a prefix tree is built over coarse symbols (a
letter or digit; each other character by itself), so that its states keep
support, and its statistically compatible states are merged: a Hoeffding bound
on the shares of endings, next symbols and characters, over all that follows.
What is left is a probabilistic automaton that knows lengths, fixed places
and the characters of each state. Every token that may be a credential, and
every value of a fixed pattern, is scored by its likelihood under the automata,
against that of ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_KEYWORD = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: The automaton of a kind is fitted on at most so many distinct values of at most LONGEST characters; the word model counts all texts.
VALUES = 400
#: Learned values have so many characters at most; joined parts of a run up to this are scored one by one, longer ones by a search.
LONGEST = 256
#: Significance of the Hoeffding test of a merge; kinds with fewer values, and states with fewer visits, than SUPPORT say nothing of a format.
ALPHA, SUPPORT = 0.005, 8
#: A candidate is a secret if its log likelihood ratio a character is at least RATIO, and its likelihood within SPAN deviations of those of the values.
RATIO, SPAN = 1.0, 3.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns; the length rules drop matches found without them."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORD):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CHARS = sorted(_ALNUM | set("+/_.=-"))
_END = ""
_SYMBOLS = (_END, "x", *"+/_.=-")
#: Weights of the kind's own shares in a state's, of characters that a kind has not shown, and of transitions that a state has not.
_SMOOTH, _UNSEEN, _NEW = 30.0, 0.02, 0.05


def symbols(value: str) -> str:
    """Letters and digits are one symbol; what they are is left to the characters of a state."""
    return "".join("x" if c in _ALNUM else c for c in value)


class Automaton:
    """A probabilistic automaton: for each state, counts and targets by symbol (`_END` counts endings) and counts of characters.

    The last state takes what has too little support; every symbol stays there.
    """

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.counts: list[Counter] = [Counter()]
        self.chars: list[Counter] = [Counter()]
        self.next: list[dict[str, int]] = [{}]
        for v in values:
            at = 0
            for c, s in zip(v, symbols(v), strict=True):
                self.counts[at][s] += 1
                self.chars[at][c] += 1
                if s not in self.next[at]:
                    self.next[at][s] = self._state()
                at = self.next[at][s]
            self.counts[at][_END] += 1
        self._merge()
        seen = sum(self.chars, Counter())
        whole = sum(seen[c] + _UNSEEN for c in _ALNUM)
        self.shares = {c: (seen[c] + _UNSEEN) / whole for c in sorted(_ALNUM)}
        states = range(len(self.next))
        #: log P of each character and of the end, by state.
        self.steps, self.ends = [{c: self._step(x, c, 0) for c in _CHARS} for x in states], [self._end(x, 0) for x in states]
        # The values score without what they add to the counts, as unseen ones do.
        scores = np.array([self.mean(v, 1) for v in values])
        self.least = float(scores.mean() - SPAN * scores.std())
        #: Tokens of 16 characters are always scored, shorter ones if they are as long as values are.
        self.shortest = min(16, sorted(map(len, values))[len(values) // 100])

    def _state(self) -> int:
        self.counts.append(Counter())
        self.chars.append(Counter())
        self.next.append({})
        return len(self.next) - 1

    def _apart(self, p: Counter, q: Counter) -> bool:
        n, m = p.total(), q.total()
        if not n or not m:
            return False
        most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return most < 1 and any(abs(p[c] / n - q[c] / m) > most for c in {*p, *q})

    def _alike(self, a: int, b: int) -> bool:
        """Whether all that follows a and b may have the same shares. Rows with a few visits say nothing, nor does what follows them."""
        todo, done = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in done or min(self.counts[x].total(), self.counts[y].total()) < 3:
                continue
            done.add((x, y))
            if self._apart(self.counts[x], self.counts[y]) or self._apart(self.chars[x], self.chars[y]):
                return False
            todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x] if c in self.next[y] and self.next[x][c] != self.next[y][c]]
        return True

    def _fold(self, parent: int, symbol: str, into: int) -> None:
        """The tree below parent's symbol is added to state `into`."""
        old = self.next[parent][symbol]
        self.next[parent][symbol] = into
        todo = [(old, into)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            self.counts[y] += self.counts[x]
            self.chars[y] += self.chars[x]
            for c, t in self.next[x].items():
                if c in self.next[y]:
                    todo.append((t, self.next[y][c]))
                else:
                    self.next[y][c] = t

    def _merge(self) -> None:
        red, rare = [0], self._state()
        self.next[rare] = dict.fromkeys(_SYMBOLS[1:], rare)
        while True:
            blue = sorted(((self.counts[t].total(), -t, s, c) for s in red for c, t in self.next[s].items() if t not in red and t != rare), reverse=True)
            if not blue:
                break
            n, t, s, c = blue[0]
            if n < SUPPORT:
                self._fold(s, c, rare)
                continue
            for r in red:
                if self._alike(r, -t):
                    self._fold(s, c, r)
                    break
            else:
                red.append(-t)
        place = {r: i for i, r in enumerate([*red, rare])}
        self.counts, self.chars = [self.counts[r] for r in place], [self.chars[r] for r in place]
        self.next = [{c: place[t] for c, t in self.next[r].items()} for r in place]

    def _share(self, at: int, symbol: str, less: int) -> float:
        own = self.counts[at]
        return (max(0, own[symbol] - less) + _NEW) / (max(0, own.total() - less) + _NEW * len(_SYMBOLS))

    def _step(self, at: int, c: str, less: int) -> float:
        if c not in _ALNUM:
            return math.log(self._share(at, c, less))
        m = max(0, self.counts[at]["x"] - less)
        return math.log(self._share(at, "x", less) * (max(0, self.chars[at][c] - less) + _SMOOTH * self.shares[c]) / (m + _SMOOTH))

    def _end(self, at: int, less: int) -> float:
        return math.log(self._share(at, _END, less))

    def mean(self, token: str, less: int = 0) -> float:
        """Log likelihood a character, the end included; less: visits that don't count."""
        at, total = 0, 0.0
        for c in token:
            total += self._step(at, c, less) if less else self.steps[at][c]
            at = self.next[at].get("x" if c in _ALNUM else c, len(self.next) - 1)
        return (total + (self._end(at, less) if less else self.ends[at])) / max(1, len(token))


def characters(texts: Iterable[str]) -> Counter:
    """How often each character occurs in the runs of texts; those of candidates count twice."""
    seen: Counter = Counter()
    for t in texts:
        for pattern in (_RUN, CANDIDATE):
            seen.update("".join(pattern.findall(t)))
    return seen


class FormatModel:
    """Automata by kind, and the character shares of ordinary words."""

    def __init__(self, values: dict[str, list[str]], words: Iterable[str] | Mapping[str, int]) -> None:
        """words: texts, or how often each of their characters occurs."""
        self.automata = {k: Automaton(own) for k, own in sorted(values.items()) if len(own) >= SUPPORT}
        seen = words if isinstance(words, Mapping) else characters(words)
        total = sum(seen.values()) + 70
        self.words = {c: math.log((seen.get(c, 0) + 1) / total) for c in _CHARS}
        self.shortest = min((a.shortest for a in self.automata.values()), default=0)
        #: By code point: 0 outside runs, 1 within, 2 what parts a run; and the most that a character can add to a score above RATIO.
        self.kind, self.most = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.float32)
        for c in _CHARS:
            self.kind[ord(c)] = 2 if c in "=/." else 1
            best = max((max(step[c] for step in a.steps) for a in self.automata.values()), default=-math.inf) - self.words[c] - RATIO
            self.most[ord(c)] = max(-100.0, best if c in _ALNUM else max(0.0, best))
        #: By kind and character: what each state adds to a score above RATIO, and the state after it.
        self.moves = {k: {c: (np.array([step[c] for step in a.steps]) - self.words[c] - RATIO, np.array([to.get("x" if c in _ALNUM else c, len(a.next) - 1) for to in a.next])) for c in _CHARS} for k, a in self.automata.items()}
        self._seen: dict[str, list[tuple[int, int, float]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def runs(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the runs of a text of which some part can reach RATIO: no other part does."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        edge = np.flatnonzero(np.diff(np.r_[0, kind > 0, 0].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= max(1, self.shortest)
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        gain = np.r_[0.0, np.cumsum(self.most[points], dtype=np.float64)]
        parting = np.r_[0, np.cumsum(kind == 2)]
        whole = gain[ends] - gain[starts] >= -1e-3
        several = parting[ends] > parting[starts]
        out = []
        for a, b, w, s in zip(starts.tolist(), ends.tolist(), whole.tolist(), several.tolist(), strict=True):
            if w:
                out.append((a, b))
            elif s:  # with one part that can reach it; joined parts can't if none can and what parts them adds nothing
                cut = [a, *(a + i + 1 for i, c in enumerate(text[a:b]) if c in "=/."), b + 1]
                if any(y - x - 1 and gain[y - 1] - gain[x] >= -1e-3 for x, y in zip(cut, cut[1:], strict=False)) or any(self.most[ord(c)] > 0 for c in "=/." if c in text[a:b]):
                    out.append((a, b))
        return out

    def values_of(self, run: str) -> list[tuple[int, int, float]]:
        """The likely values of a run; words come again and again."""
        if (found := self._seen.get(run)) is None:
            found = inferred(run, self)
            if len(run) <= 64:
                if len(self._seen) >= 1 << 16:
                    self._seen.clear()
                self._seen[run] = found
        return found

    def ratio(self, token: str, strict: bool = False) -> float:
        """Log likelihood ratio a character of the best kind; strict: of those that find the token as likely as their own, else -inf."""
        own = max((m for a in self.automata.values() if (not strict or len(token) >= a.shortest) and ((m := a.mean(token)) >= a.least or not strict)), default=-math.inf)
        return own - sum(map(self.words.__getitem__, token)) / len(token)


def _edges(run: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts of a run between `=`, `/` and `.`; it also ends before punctuation at its end."""
    at = [i for i, c in enumerate(run) if c in "=/."]
    return [0, *(i + 1 for i in at)], sorted({*at, len(run), len(run.rstrip("+/_.=-"))})


def _cuts(run: str) -> tuple[tuple[int, int], ...]:
    """(start, end) of a run and of its joined parts up to LONGEST; `_longer` has the rest."""
    starts, ends = _edges(run)
    out = {(0, len(run))}
    for start in starts:
        for end in ends[bisect_right(ends, start) :]:
            if end - start > LONGEST:
                break
            out.add((start, end))
    return tuple(sorted(out))


def _longer(run: str, model: FormatModel) -> dict[tuple[int, int], float]:
    """(start, end) and score of all joined parts above LONGEST that reach RATIO, the whole run aside.

    Backwards over the run, the most that any end from here on can add, by state of
    an automaton; a walk from a start goes on only while that reaches RATIO. What it
    passes on is scored as shorter parts are, so that no value is missed or scored otherwise.
    """
    starts, ends = _edges(run)
    found: dict[tuple[int, int], float] = {}
    edges, last = {*starts, *ends}, set(ends)
    for kind, a in model.automata.items():
        moves, stops = model.moves[kind], np.array(a.ends)
        best, most = np.full(len(stops), -np.inf), {}
        for p in range(len(run), -1, -1):
            if p < len(run):
                gain, to = moves[run[p]]
                best = gain + best[to]
            if p in last:
                best = np.maximum(best, stops)
            if p in edges:
                most[p] = best
        for start in starts:
            if start not in most or most[start][0] < -1e-3:
                continue
            state, total, words = 0, 0.0, 0.0
            for p in range(start, len(run) + 1):
                n = p - start
                if p in last:
                    if LONGEST < n < len(run) and n >= a.shortest and (start, p) not in found and (total + a.ends[state]) / n >= a.least and total + a.ends[state] - words - RATIO * n >= -1e-3 and (s := model.ratio(run[start:p], True)) >= RATIO:
                        found[start, p] = s
                    if total - words - RATIO * n + most[p][state] < -1e-3:
                        break
                if p < len(run):
                    c = run[p]
                    total, words = total + a.steps[state][c], words + model.words[c]
                    state = a.next[state].get("x" if c in _ALNUM else c, len(a.next) - 1)
    return found


def inferred(run: str, model: FormatModel) -> list[tuple[int, int, float]]:
    """(start, end, score) of the likely values of a run that don't overlap, those with most evidence first chosen."""
    found = []
    for a, b in _cuts(run):
        if b - a >= model.shortest and (s := model.ratio(run[a:b], True)) >= RATIO:
            found.append((-s * (b - a), a, b, s))
    if len(run) > LONGEST:
        found += [(-s * (b - a), a, b, s) for (a, b), s in _longer(run, model).items()]
    out: list[tuple[int, int, float]] = []
    for _, a, b, s in sorted(found):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, s))
    return out


def spans(text: str | None, model: FormatModel | None) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, score) of all secrets of a text, by start, then kind as listed; code points, end exclusive."""
    if not isinstance(text, str):
        return []
    base = base_spans(text)
    if not model or not model.automata:
        return sorted(((a, b, k, None) for a, b, k, _ in base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    out = [(a, b, k, model.ratio(v)) for a, b, k, v in base]
    # What lies between fixed patterns; a run that goes into one is clipped.
    taken = sorted((a, b) for a, b, _, _ in base)
    first = 0
    for a, b in model.runs(text):
        while first < len(taken) and taken[first][1] <= a:
            first += 1
        at, i = a, first
        while at < b:
            x, y = taken[i] if i < len(taken) else (b, b)
            if min(x, b) - at >= model.shortest:
                out += [(at + p, at + q, "format", s) for p, q, s in model.values_of(text[at : min(x, b)])]
            at, i = max(at, y), i + 1
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def train(docs: DataFrame) -> FormatModel:
    """A model from a bounded, hash-chosen sample of the distinct values that the fixed patterns find in all of docs, and the characters of all texts.

    Null texts count for nothing; a repeated value counts once, repeated texts
    each time in the background. An empty table gives a model without automata.
    """

    small_batches(docs.sparkSession)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({(k, v) for t in pdf["text"] for _, _, k, v in base_spans(t)}, columns=["kind", "value"])

    found = stored(docs.where("text is not null").select("text").mapInPandas(values, "kind string, value string").distinct(), "credentials")
    counts = dict(found.groupBy("kind").count().collect())
    own: dict[str, list[str]] = {}
    if counts:
        share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2 * VALUES / n))])
        draw = F.pmod(F.xxhash64("value"), F.lit(1 << 30))
        rows = found.withColumn("draw", draw).where(F.col("draw") / F.lit(1 << 30) < share[F.col("kind")]).where(F.length("value") <= LONGEST)
        for r in rows.orderBy("kind", "draw", "value").limit(8 * VALUES).collect():
            if len(own.setdefault(r["kind"], [])) < VALUES:
                own[r["kind"]].append(r["value"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            seen += characters(pdf["text"])
        yield pd.DataFrame(list(seen.items()), columns=["char", "n"])

    parts = docs.where("text is not null").select("text").mapInPandas(counted, "char string, n long")
    return FormatModel(own, {r["char"]: r["n"] for r in parts.groupBy("char").agg(F.sum("n").alias("n")).collect()})


def scan(docs: DataFrame, model: FormatModel | None) -> DataFrame:
    """docs with `secrets`: array of (kind, start, end, score), empty for null texts.

    Spans count code points, end exclusive, by start, then kind as listed in
    KINDS. Fixed patterns are always kept, whatever their score; inferred ones
    ("format") don't overlap them and need a model with automata, which there is
    not where few credentials were found; then scores are null. Of equally likely
    overlapping values, the first stays. Repeated rows have the same spans each;
    an empty table gives none. A column of this name is replaced; rows and other
    columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in spans(t, shared.value)] for t in texts])

    return docs.withColumn("secrets", find("text"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs whose texts have a mark in place of each secret (overlapping ones share it); n_chars follows the text.

    A null text stays null, one without secrets as it is; repeated rows and other
    columns stay, an empty table is empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def clean(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        out, at = [], 0
        for a, b, _, _ in spans(text, shared.value):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)  # one that begins within the last shares its mark, what sticks out of it too
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(clean)

    out = docs.withColumn("__text", cleaned("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__text").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("__text")).select(docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs)).select("doc_id", "secrets")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def digest(text: str | None) -> tuple[int, int, int, str]:
    """(n_assign, n_access, n_hex, base_sha256) of a text, without Spark."""
    own = sorted(base_spans(text or ""), key=lambda x: (x[0], KINDS.index(x[2])))
    n = Counter(k for _, _, k, _ in own)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in own).encode()).hexdigest()
