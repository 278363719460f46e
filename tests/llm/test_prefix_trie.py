import hashlib
import random
import zlib

import pytest

from quarry.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def ordered(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(x)] for c, x in out.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: convs.get(c - c % 100, [])[: h[c]] + x[h[c] :] for c, x in convs.items()}


def brute(convs):
    members, children = {}, {}
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), sum(q not in children for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.select(*NAMES).collect()), key=str)


def made():
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 140), 300, 301, 407]:
        text = [rnd.choice("ab") * rnd.choice([1, 1, 2]) for _ in range(rnd.randrange(1, 7))]
        rows += [(c, t, rnd.choice(["u", "u", None]), x, 1, "x") for t, x in enumerate(text)]
    rows += [(500 + i, t, "u", f"same {t}", 1, "x") for i in range(30) for t in range(4)]
    rows += [(7, None, "u", None, 1, "x"), (7, None, "u", "", 1, "x"), (7, 2, "v", "é𝄞", 1, "x"), (7, 2, "v", "é𝄞", 1, "x"), (None, 1, "u", "no", None, None)]
    rows += [(600, t, "u", f"long {t % 3}", 1, "x") for t in range(40)] + [(601, t, "u", f"long {t % 3}", 1, "x") for t in range(37)]
    rows += [(602, 0, "u", "w " * 200000, 1, "x")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_brute(spark, monkeypatch, small):
    if small:  # segments, pieces and joins of the large case
        monkeypatch.setattr(pt, "SEGMENT", 4)
        monkeypatch.setattr(pt, "PIECE", 3)
        monkeypatch.setattr(pt, "BROADCAST_ROWS", 10)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(pt.trie(*pt.grafted(*pt.numbered(df)))) == brute(rebuilt(ordered(rows)))
    nodes = pt.prefix_trie(df)
    assert run(nodes) == brute(ordered(rows))
    if small:
        assert run(pt.prefix_trie(df.limit(0))) == []
        texts = {(r.conv_id, r.depth): (r.role, r.text) for r in pt.with_turns(nodes, df).collect()}
        convs = ordered(rows)
        assert texts == {(c, d): convs[c][d - 1] if d else (None, None) for c, d in texts}


def test_chains_hang_below_their_owner(spark):
    df = spark.createDataFrame([(c, t, "u", f"{t if t < c else (c, t)}", 0, "") for c in range(20) for t in range(16)], SCHEMA)
    nodes = {(r.conv_id, r.depth): r.parent_conv_id for r in pt.prefix_trie(df).collect()}
    assert nodes[6, 6] == 5 and nodes[6, 7] == 6 and nodes[0, 0] is None
