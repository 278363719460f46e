"""Secret scans: stated patterns, and formats learned as probabilistic automata.

1. ``scan`` reads each text once. It stores the spans that the base patterns find,
   with their values, and the candidates: runs of ``[A-Za-z0-9+/_-]``, with up to two
   ``=`` behind, of ``MIN_CHARS`` or more that no base span touches.
2. The labelled credentials are the base spans' values, by kind. ``sample`` takes the
   ``SAMPLE`` distinct ones of each kind with the smallest hashes, and as many
   candidates as ``NEGATIVES`` for what is no credential. Only these are bounded, and
   only strings of ``MAX_LEARNED`` characters or fewer are learned from.
3. ``infer`` makes a prefix tree of a kind's strings and merges its states, the commonest first,
   as in the ALERGIA algorithm: two states are compatible if the frequencies of their
   endings and symbols, and those of their successors, differ by no more than
   Hoeffding's bound. Of several compatible states the one under which the strings of
   the merged subtree are likeliest is taken. A state that fewer than ``RARE`` strings
   reach may also be given up for the overall use of symbols, and is never kept by
   itself, so that no odd string is learned by heart. One task infers one automaton.
4. Each candidate's log-likelihood under every kind's automaton is compared with that
   under the automaton of the other candidates. With the stated prior odds, those
   whose odds are even or better become spans of kind ``like_<kind>``. The strings of
   a batch walk the automata together, a character a step.

Positions are code points, ends exclusive. Base spans always stay.

Defined results: a null text is empty; empty texts have no spans; very long texts and
runs are searched and scored whole; repeated rows and ids are rows of their own; a
kind with fewer than ``MIN_LABELLED`` different labelled strings, or a corpus without
candidates, has no automaton and adds no span; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .words import buffer_of

KINDS = ("assign", "access", "hex")
#: On text with A-Z lower-cased; group 2 is the value.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{12,}={0,2}")
MIN_CHARS = 12
#: Bounds of what is learned from.
SAMPLE, NEGATIVES, MAX_LEARNED, MIN_LABELLED = 400, 2000, 128, 20
#: Significance of Hoeffding's bound, count given to unused symbols, weight of the
#: overall use of symbols in a state, strings below which a state is not kept apart,
#: prior log odds.
ALPHA, UNSEEN, BACK_OFF, RARE, PRIOR = 0.3, 0.5, 2.0, 10, math.log(1e-6)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


# ---------------------------------------------------------------- spans


def base_spans(raw: bytes) -> list[tuple]:
    """(start, kind, end, value start) in bytes, in order. Leftmost matches without
    overlap, by kind; those that are too short are dropped after they were matched."""
    out = []
    for m in ASSIGN.finditer(raw.lower()):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end(), m.start(2)))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(raw):
            if m.end() - m.start() >= LEAST[KINDS[kind]]:
                out.append((m.start(), kind, m.end(), m.start()))
    return sorted(out)


def candidates(raw: bytes, taken: list[tuple]) -> list[tuple]:
    """(start, end) in bytes of the candidates that no span in ``taken`` touches."""
    out, at, ends = [], 0, -1
    for m in CANDIDATE.finditer(raw):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            ends = max(ends, taken[at][2])
            at += 1
        if ends <= s:
            out.append((s, e))
    return out


def _points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Byte places of a text as code points."""
    if raw.isascii():
        return {p: p for p in places}
    heads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return {p: int(heads[p - 1]) if p else 0 for p in places}


def _scan(batches):
    for batch in batches:
        buf, offs = buffer_of(batch.column("text"))
        buf = buf.tobytes()
        base, cands = [], []
        for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
            raw = buf[s:e]
            found = base_spans(raw)
            rest = candidates(raw, found)
            at = _points(raw, [p for f in found for p in (f[0], f[2])] + [p for f in rest for p in f])
            base.append([{"kind": KINDS[k], "start": at[a], "end": at[b], "value": raw[v:b].decode()} for a, k, b, v in found])
            cands.append([{"kind": "", "start": at[a], "end": at[b], "value": raw[a:b].decode()} for a, b in rest])
        columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(base, _SPAN_TYPE), pa.array(cands, _SPAN_TYPE)], [n for n in batch.schema.names if n != "text"] + ["base", "cands"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, cands), stored: spans (kind, start, end, value) of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return runtime.stored(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, base {_SPAN}, cands {_SPAN}"), "spans")


# ---------------------------------------------------------------- sample


def _least(bounds: dict[str, int]):
    """The different strings of each kind with the smallest hashes, a task's share."""

    def run(batches):
        held: dict[str, dict[int, str]] = {k: {} for k in bounds}
        worst: dict[str, list[int]] = {k: [] for k in bounds}  # hashes, largest first
        for batch in batches:
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()):
                h = xxhash.xxh3_64_intdigest(value.encode()) >> 1
                mine, heap = held[kind], worst[kind]
                if h in mine or (len(heap) >= bounds[kind] and h >= -heap[0]):
                    continue
                mine[h] = value
                heapq.heappush(heap, -h)
                if len(heap) > bounds[kind]:
                    del mine[-heapq.heappop(heap)]
        rows = [(k, h, v) for k, mine in held.items() for h, v in mine.items()]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("kind", "h", "value"), map(list, zip(*rows)))))

    return run


def sample(spans: DataFrame, per_kind: int = SAMPLE, negatives: int = NEGATIVES) -> DataFrame:
    """(kind, value): the bounded sample of credentials, and of candidates under ''."""
    bounds = {**{k: per_kind for k in KINDS}, "": negatives}
    rows = spans.select(F.explode(F.concat("base", "cands")).alias("s")).select("s.kind", "s.value").where(F.length("value") <= MAX_LEARNED)
    least = rows.mapInArrow(_least(bounds), "kind string, h long, value string").distinct()
    least = runtime.stored(least, "least")
    out = None
    for kind, n in bounds.items():
        part = least.where(F.col("kind") == kind).orderBy("h").limit(n).select("kind", "value")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- automata


class Automaton:
    """Counts of a prefix tree's states while they are merged."""

    def __init__(self, strings: list[str]):
        self.n, self.final, self.to = [0], [0], [{}]  # to: symbol -> [state, count]
        for s in sorted(strings):
            at = 0
            self.n[0] += 1
            for c in s:
                step = self.to[at].get(c)
                if step is None:
                    step = self.to[at][c] = [len(self.n), 0]
                    self.n.append(0), self.final.append(0), self.to.append({})
                step[1] += 1
                at = step[0]
                self.n[at] += 1
            self.final[at] += 1
        # How often each symbol, and an end, is used at all: what a state backs off to.
        seen = Counter(c for s in strings for c in s)
        whole = sum(seen.values()) + len(strings) + UNSEEN * (len(SYMBOLS) + 1)
        self.use = {c: (seen[c] + UNSEEN) / whole for c in SYMBOLS} | {"": (len(strings) + UNSEEN) / whole}

    def compatible(self, p: int, q: int, alpha: float) -> bool:
        factor = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            m, n = self.n[p], self.n[q]
            bound = factor * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if bound >= 1:  # no frequencies differ by more, here and below
                continue
            if abs(self.final[p] / m - self.final[q] / n) > bound:
                return False
            a, b = self.to[p], self.to[q]
            for c in a.keys() | b.keys():
                x, y = a.get(c), b.get(c)
                if abs((x[1] if x else 0) / m - (y[1] if y else 0) / n) > bound:
                    return False
                if x and y and x[0] is not None:
                    todo.append((x[0], y[0]))
        return True

    def likelihood(self, p: int, q: int) -> float:
        """Of the strings below the tree state ``q``, read from ``p``."""
        out, todo, use = 0.0, [(p, q)], self.use
        while todo:
            p, q = todo.pop()
            size = BACK_OFF + (self.n[p] if p is not None else 0)
            if self.final[q]:
                out += self.final[q] * math.log(((self.final[p] if p is not None else 0) + BACK_OFF * use[""]) / size)
            for c, (t, n) in self.to[q].items():
                x = self.to[p].get(c) if p is not None else None
                out += n * math.log(((x[1] if x else 0) + BACK_OFF * use[c]) / size)
                todo.append((x[0] if x else None, t))
        return out

    def fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.n[p] += self.n[q]
            self.final[p] += self.final[q]
            for c, (t, n) in self.to[q].items():
                x = self.to[p].get(c)
                if x is None:
                    self.to[p][c] = [t, n]
                else:
                    x[1] += n
                    if x[0] is not None:
                        todo.append((x[0], t))


def infer(strings: list[str], alpha: float = ALPHA) -> dict[str, np.ndarray]:
    """The automaton of ``strings`` as tables: successor and log-probability by state
    and symbol, and of an end. The last state is where symbols that a state does not know lead: it
    stays there, with the overall use of symbols."""
    a = Automaton(strings)
    red, known = [0], {0}
    while True:
        blue = [(r, c) for r in red for c in sorted(a.to[r]) if a.to[r][c][0] is not None and a.to[r][c][0] not in known]
        if not blue:
            break
        p, c = max(blue, key=lambda x: a.n[a.to[x[0]][x[1]][0]])
        q = a.to[p][c][0]
        fits = [r for r in red if a.compatible(r, q, alpha)]
        if a.n[q] < RARE:
            fits.append(None)
        if fits:
            best = a.to[p][c][0] = max(fits, key=lambda r: a.likelihood(r, q))
            if best is not None:
                a.fold(best, q)
        else:
            red.append(q)
            known.add(q)
    place = {r: i for i, r in enumerate(red)}
    lost, k = len(red), len(SYMBOLS)
    use = np.array([a.use[c] for c in SYMBOLS])
    to = np.full((lost + 1, k), lost, np.int32)
    step, end = np.tile(use, (lost + 1, 1)), np.full(lost + 1, a.use[""])
    for r, i in place.items():
        size = a.n[r] + BACK_OFF
        step[i], end[i] = BACK_OFF * use / size, (a.final[r] + BACK_OFF * a.use[""]) / size
        for c, (t, n) in a.to[r].items():
            to[i, SYMBOLS.index(c)] = lost if t is None else place[t]
            step[i, SYMBOLS.index(c)] += n / size
    step, end = np.log(step), np.log(end)
    return {"to": to, "step": step, "end": end}


def likelihoods(col, automata: list[dict]) -> np.ndarray:
    """Log-likelihoods of strings, (n, automata). All strings step together, the
    shorter ones drop out as they end."""
    code = np.zeros(256, np.int16)
    code[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
    buf, offs = buffer_of(col)
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    begin, size = offs[:-1][order], n[order]
    out = np.zeros((len(n), len(automata)))
    for j, a in enumerate(automata):
        at, total = np.zeros(len(n), np.int32), np.zeros(len(n))
        for i in range(int(size[0]) if len(size) else 0):
            live = np.searchsorted(-size, -(i + 1), side="right")
            c = code[buf[begin[:live] + i]]
            total[:live] += a["step"][at[:live], c]
            at[:live] = a["to"][at[:live], c]
        out[order, j] = total + a["end"][at]
    return out


def learn(spans: DataFrame, alpha: float = ALPHA) -> dict[str, dict]:
    """Automata by kind, '' for other candidates; none where there is too little."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        kind, strings = rows["kind"].iloc[0], rows["value"].tolist()
        model = infer(strings, alpha) if len(strings) >= MIN_LABELLED else None
        return pd.DataFrame({"kind": [kind], "model": [pickle.dumps(model)]})

    models = sample(spans).groupBy("kind").applyInPandas(one, "kind string, model binary").collect()  # a few of bounded size
    found = {r.kind: m for r in models if (m := pickle.loads(bytes(r.model)))}
    return found if "" in found else {}


def _scored(held):
    def run(batches):
        automata = held.value
        kinds = [k for k in KINDS if k in automata]
        models = [automata[k] for k in kinds] + [automata[""]] if kinds else []
        for batch in batches:
            cands = batch.column("cands")
            flat = cands.flatten()
            size = np.diff(cands.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            out = [[] for _ in range(batch.num_rows)]
            if kinds and len(flat):
                all_ = likelihoods(flat.field("value"), models)
                odds = all_[:, :-1] - all_[:, -1:] + PRIOR
                best = odds.argmax(1)
                score = 1 / (1 + np.exp(-np.clip(odds[np.arange(len(odds)), best], -50, 50)))
                start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                for i in np.flatnonzero(odds[np.arange(len(odds)), best] >= 0):
                    out[row[i]].append({"kind": f"like_{kinds[best[i]]}", "start": int(start[i]), "end": int(end[i]), "score": float(score[i])})
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(out, kind)], ["doc_id", "base", "added"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): the spans (kind, start, end, value) of the patterns and
    (kind, start, end, score) of the learned formats in each (doc_id, text)."""
    spans = scan(docs)
    automata = learn(spans)
    held = docs.sparkSession.sparkContext.broadcast(automata)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spans.mapInArrow(_scored(held), f"doc_id {kind}, base {_SPAN}, added array<struct<kind:string,start:long,end:long,score:double>>")


def _joined(spans, order: tuple):
    """kind:start:end by start, then by ``order`` of the kinds."""
    rank = F.array(*[F.lit(k) for k in order])
    key = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(key, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find(runtime.read(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = (*KINDS, *(f"like_{k}" for k in KINDS))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base"), KINDS), 256).alias("base_sha256"), _joined(F.concat(plain("base"), plain("added")), order).alias("spans"))
