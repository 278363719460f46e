import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quarry.llm import chat_format as cf
from quarry.llm import license_scan as ls
from quarry.llm import line_dedup as ld
from quarry.llm import quality as qu

DOCS = "doc_id long, text string, lang string, source string, n_words long, h string"
HARD = [None, "", " ", "\n\n", "a", "x " * 30000, "é\x85 ü w | b", "MIT License mit license\nMIT license", "gnu General public LICENSE cc-by CC BY", "|\n|\n> a > b", "the end.\nthe end.\nThe End.  \n\tTHE END."] * 2


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, 7, "h") for i, t in enumerate(texts)], DOCS)


def texts(spark, sf_dir):
    return HARD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_licenses(spark, sf_dir):
    all_ = texts(spark, sf_dir) + ["so: " + ls.TEMPLATES[0][1], " ".join(ls.TEMPLATES[7][1].split()[3:]), ls.TEMPLATES[0][1].replace("charge", "cost")]
    got = {r.doc_id: r for r in ls.scan_licenses(frame(spark, all_)).collect()}
    assert len(got) == len(all_)
    for i, t in enumerate(all_):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for p, label in ls.PHRASES.items():
            p = p.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[len(all_) - 3].labels == "mit" and got[len(all_) - 2].labels == "bsd" and got[len(all_) - 1].labels == "mit"


def test_license_with_foreign_words(spark):
    changed = []
    for label, t in ls.TEMPLATES:
        w = t.split()
        if len(w) >= 2 * ls.MIN_RUN + 1:
            m = len(w) // 2
            changed += [(label, " ".join(w[:m] + [f"Zyx{m}"] + w[m + k :])) for k in (0, 1)]
    w = ls.TEMPLATES[0][1].split()
    changed.append(("mit", " ".join(x + (" acme" if i % 10 == 9 else "") for i, x in enumerate(w))))
    far = " ".join(w[:24] + ["zyx"] * (ls.MAX_GAP + 1) + w[24:])
    twice = " ".join(w) + " . " + " ".join(w)
    rows = ls.scan_licenses(frame(spark, [t for _, t in changed] + [far, twice])).orderBy("doc_id").collect()
    for (label, _), r in zip(changed, rows):
        assert label in r.labels.split(",") and r.score > 0.6
    assert rows[-3].labels == "mit" and rows[-3].score == 1 and [s.first for s in rows[-3].spans] == [0]
    assert "mit" not in rows[-2].labels.split(",") and len([s for s in rows[-1].spans if s.label == "mit"]) == 2


def test_automaton():
    rnd = random.Random(3)
    seqs = [[rnd.randrange(4) for _ in range(40)] for _ in range(3)]
    a = ls.Automaton(seqs)
    held = {tuple(s[i:j]) for s in seqs for i in range(40) for j in range(i + 1, 41)}
    ids = [rnd.randrange(4) for _ in range(300)]
    want = []
    for e in range(1, 301):
        n = max((k for k in range(e + 1) if k == 0 or tuple(ids[e - k : e]) in held))
        want.append(n)
    ends = {(e, n) for e, n in zip(range(1, 301), want) if n >= ls.MIN_RUN and (e == 300 or want[e] != n + 1)}
    assert {(e, n) for e, n, _ in a.runs(ids)} == ends
    for e, n, places in a.runs(ids):
        run = ids[e - n : e]
        assert {t: sorted(at) for t, at in places.items()} == {t: at for t, s in enumerate(seqs) if (at := [i for i in range(n - 1, 40) if s[i + 1 - n : i + 1] == run])}


def test_runs_at_several_places(spark):
    one = ls.Scanner([("x", "a b c d e a b c d f g h i j")], {})
    row = one.scan(pa.array(["a b c d q a b c d f g h i j"]))[0]
    assert row["labels"] == "x" and abs(row["score"] - 13 / 14) < 1e-9 and [(s["first"], s["end"]) for s in row["spans"]] == [(0, 14)]
    for a in (ls.Automaton([[1, 2, 1, 2, 1], [2, 1, 3]]),):
        s = a.next[a.next[0][2]][1]
        assert a.places[s] == {0: [2, 4], 1: [1]}
    assert ls.scan_licenses(frame(spark, ["x"]).limit(0)).collect() == []
    long = "word " * 50000 + "released under the mit license"
    assert ls.scan_licenses(frame(spark, [long])).first().labels == "mit"


def test_whole_notices(spark):
    texts = [t for _, t in ls.WHOLE] + ["# " + t.replace("\n", "\n# ") + "\nint x;" for _, t in ls.WHOLE]
    texts += [" ".join(t.split()[len(t.split()) // 3 :]) for _, t in ls.WHOLE]
    rows = ls.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()
    for (label, t), whole, quoted, tail in zip(ls.WHOLE, rows, rows[len(ls.WHOLE) :], rows[2 * len(ls.WHOLE) :]):
        n = len(ls.template_words(t))
        for r, first in ((whole, 0), (quoted, 0)):
            mine = [(s.first, s.end, s.covered) for s in r.spans if s.label == label]
            assert mine == [(first, n, 1.0)] and r.score == 1
        assert label in tail.labels.split(",")


def test_overlapping_runs():
    # The second run repeats words of the first: it gives them up instead of its link.
    one = ls.Scanner([("x", "a b c d e f g h i j k l")], {})
    row = one.scan(pa.array(["a b c d e f d e f g h i j k l"]))[0]
    assert [(s["first"], s["end"]) for s in row["spans"]] == [(0, 15)] and row["score"] == 1
    # A run wholly inside the words before it is no part of the chain.
    row = one.scan(pa.array(["a b c d e f g h c d e f z i j k l"]))[0]
    assert [(s["first"], s["end"], s["covered"]) for s in row["spans"]] == [(0, 17, 1.0)]
    for parts in ([(0, 6, 0, 6), (6, 15, 3, 12)], [(0, 6, 0, 6), (4, 12, 4, 12)], [(0, 6, 0, 6), (4, 12, 6, 14)]):
        (first, end, covered), *_ = ls.chains(parts)
        assert (first, end, covered) == (0, parts[1][1], 12)


def test_templates_of_a_table(spark):
    rows = [("own", "Terms of the Quarry: do as you please, and say so."), ("own", "Terms of the Quarry: do as you please, and say so."), (None, "x"), ("y", None), ("z", " - ")]
    found = ls.templates_of(spark.createDataFrame(rows, "label string, text string"))
    assert found == [rows[0]]
    assert ls.scan_licenses(frame(spark, ["/* terms of the quarry do as you please and say so */"]), found).first().labels == "own"
    with pytest.raises(ValueError):
        ls.templates_of(spark.range(1).selectExpr("'a' AS label", f"repeat('w ', {ls.TEMPLATE_WORDS + 1}) AS text"))


def test_chat(spark):
    rnd = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "\\n", "\n", "<", "|", "é😀", "text", "<\\|", "assistant"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a\nb<|"]), rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randrange(9)))]), 1) for c in [None, *range(40)] for t in range(rnd.randrange(1, 8))]
    rows += [(7, 1, "assistant", "tie", 1), (7, 1, "assistant", "tie", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    got = {r.conv_id: r for r in cf.format_turns(df).mapInArrow(cf._digests, schema).collect()}
    whole = {r.conv_id: r for r in cf.format_conversations(df).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by) == set(whole)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[c].formatted))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == want
    assert cf.format_turns(df.limit(0)).mapInArrow(cf._digests, schema).collect() == []


def test_template_language():
    r = cf.compile_template("{{ 'a' | upper }}{% if 1 == 2 %}x{% elif not 0 %}y{% endif %}{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}-{% endfor %}")
    assert r([{"text": "q"}, {"text": None}]) == ("Ayq--", [(2, 3), (4, 4)])
    assert cf._parse("{{ 'a' | upper }}{% if 1 == 2 %}x{% else %}y{% endif %}") == [("text", "Ay")]
    for bad in ("{{ m.__class__ }}", "{{ x | eval }}", "{% import os %}", "{% if a %}", "{{ f() }}", "{{ a + b }}"):
        with pytest.raises(cf.TemplateError):
            cf.compile_template(bad)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(spark, sf_dir):
    all_ = texts(spark, sf_dir)
    got = {r.doc_id: r for r in qu.score(frame(spark, all_)).collect()}
    for i, t in enumerate(all_):
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        real = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(real) - len(set(real)), len(rep)), t[:50]
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.kept and r.base_failed)


def lost(text):
    """Characters of lines with words, and those on lines that the rules remove."""
    ends = tuple(".!?…؟।")
    lines_ = (text or "").split("\n")

    def marked(w):
        return re.sub("[\"'”’»)\\]]*$", "", w).endswith(ends) or any(c in w for c in "。！？")

    def item(x):
        w = words(x)
        return 0 < len(w) <= 5 and not any(re.search("[.!?…؟।。！？][\"'”’»)\\]]{0,2}$", v) for v in w)

    bad, run = set(), []
    for i, x in enumerate([*lines_, "an end of more than five words here"]):
        if item(x):
            run.append(i)
        elif words(x):
            bad |= set(run) if len(run) >= 4 else set()
            run = []
    phrases = ["cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript is required", "javascript is disabled", "enable javascript", "click here", "read more", "subscribe to", "sign up for", "log in to", "share this", "share on", "skip to content", "powered by", "advertisement"]
    for i, x in enumerate(lines_):
        n = sum(c in " \t" for c in x) + 1
        bars, signs = sum(c in "|>»·•" for c in x), sum(c in "#*$%&<>{}[]~^=" for c in x)
        w = words(x)
        endless = len(w) >= 10 and not any(marked(v) for v in w)
        if bars >= 2 and bars * 4 >= n or any(p in x.lower() for p in phrases) or n >= 4 and signs * 2 >= n or endless:
            bad.add(i)
    real = [i for i, x in enumerate(lines_) if words(x)]
    return sum(len(lines_[i]) for i in real), sum(len(lines_[i]) for i in real if i in bad)


def test_quality_verdict(spark, sf_dir):
    rnd = random.Random(8)
    bits = ["Home", "a|b", "»", "tag", "One two three.", "three little words", "click HERE", "Terms of Use", "* * # x", "\"Stop!\"", "x.y", "\n", "\n", "\n\n", " ", " \t", "so (yes.)", "many words on one line without any mark at all here", "完了。"]
    made = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(300)]
    made += [" ".join(f"w{rnd.randrange(30000)}" for _ in range(70000)) + " a b c d a b c"]  # beyond PACKED windows
    all_ = texts(spark, sf_dir) + made
    got = {r.doc_id: r for r in qu.score(frame(spark, all_)).collect()}
    for i, t in enumerate(all_):
        chars, gone = lost(t)
        share = gone / chars if chars else 1.0
        assert abs(got[i].lost_share - share) < 1e-9, t[:300]
        assert got[i].kept == (not got[i].base_failed and got[i].lost_share <= 0.5)
    w = made[-1].split()
    grams = Counter(zip(w, w[1:], w[2:]))
    assert got[len(all_) - 1].n_repeat_words == len({j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}) >= 6
    assert qu.score(frame(spark, ["x"]).limit(0)).collect() == []


def test_quality_lines(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(11)) + "." for i in range(8))
    keywords = "\n".join(" ".join(f"shoe{i}x{j}" for j in range(15)) for i in range(6))
    menu = "\n".join(f"Item number {i}" for i in range(40))
    sold = "version 2.0 from example.com and " + " ".join(f"tag{i}" for i in range(12))
    cases = [
        (prose, prose, True),
        (keywords, "", False),
        (menu, "", False),
        (f"Home\nOur shop\n\nAbout us\nContact\n{prose}\n{sold}\nclick here now.\nTwo words\n\nthree", f"{prose}\nTwo words\n\nthree", True),
        (f"Home\nShop\nAbout\n{prose}", f"Home\nShop\nAbout\n{prose}", True),  # three in a row stay
        (f"Yes.\nNo!\n\"Why?\"\nSo.\nWell...\n{prose}", f"Yes.\nNo!\n\"Why?\"\nSo.\nWell...\n{prose}", True),
        ("a  \t b" + " " * 60 + f"c\n{prose}", "a  \t b" + " " * 60 + f"c\n{prose}", True),  # spaces are no words
        ("\n".join(["x"] * 60000), "", False),
        (None, None, False),
        ("", "", False),
    ]
    got = qu.score(frame(spark, [t for t, _, _ in cases])).orderBy("doc_id").collect()
    for (t, clean, kept), r in zip(cases, got):
        assert (r.clean_text, r.kept) == (clean, kept), (t or "")[:60]
    assert got[1].lost_share == got[2].lost_share == 1 and got[0].lost_share == 0 and not (got[1].base_failed or got[2].base_failed)


def test_quality_filters_stay_above(spark):
    """A filter on the verdict does not take the lambdas into its condition."""
    plan = qu.score(frame(spark, ["a b c"])).where("kept AND lost_share < 0.3")._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.split("\n") if "Filter " in x)
    assert "xxhash64" not in line and "split(" not in line


def line_key(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))


@pytest.mark.parametrize("least,batches", [(10, 1), (3, 9)])
def test_lines(spark, sf_dir, least, batches):
    all_ = texts(spark, sf_dir) + ["Hot LINE é\nown %d" % (i % 3) for i in range(12)]
    df = frame(spark, all_)
    got = {r.doc_id: r for r in ld.drop_lines(df, least, batches).collect()}
    docs = Counter(k for t in all_ for k in {line_key(x) for x in (t or "").split("\n")})
    for i, t in enumerate(all_):
        ls_ = (t or "").split("\n")
        kept = [x for x in ls_ if not line_key(x) or docs[line_key(x)] < least]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(ls_), len(ls_) - len(kept), None if t is None else "\n".join(kept))
        assert got[i].h == "h" and got[i].n_words == 7
    assert ld.drop_lines(df.limit(0)).collect() == []


def test_line_index_anti_join(spark, monkeypatch):
    """Lines that a run has settled enter no further run, and are not lost."""
    batches = [spark.createDataFrame([(a, -a) for a in range(6) for _ in range(3 if a < 3 else 1)], "a long, b long") for _ in range(5)]

    def made():
        ix = ld.LineIndex(spark, 3)
        for i, batch in enumerate(batches):
            ix.add(batch)
            last = spark.table(ix.levels[0][-1] if ix.levels[0] else ix.levels[1][-1])
            yield i, ix, sorted((r.a, r.n) for r in last.collect())
        ix.close()

    for i, ix, last in made():
        want = {0: [(a, 3 if a < 3 else 1) for a in range(6)], 3: [(a, 3 if a < 3 else 4) for a in range(6)]}
        # The fourth compacts, so that the fifth finds all lines settled.
        assert last == want.get(i, [(a, 1) for a in range(3, 6)] if i < 4 else [])
        with ld.merging(spark):
            plan = ix.open_lines(spark.table(ix.runs()[0]))._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan  # sorted buckets meet as they lie
    assert [len(x) for x in ix.levels] == [0] or not [t.name for t in spark.catalog.listTables() if t.name.startswith("quarry_run")]
    # Without the anti-join settled lines go on being counted; turned around, they are lost.
    monkeypatch.setattr(ld.LineIndex, "open_lines", lambda self, counts: counts)
    assert [last for i, _, last in made()][4] == [(a, 3 if a < 3 else 1) for a in range(6)]
    df = frame(spark, [f"hot\nown {i}" for i in range(12)])
    monkeypatch.setattr(ld.LineIndex, "open_lines", lambda self, counts: counts.limit(0))
    assert {r.n_dropped for r in ld.drop_lines(df, batches=3).collect()} == {0}


def test_tables_go_when_a_step_fails(spark, monkeypatch):
    monkeypatch.setattr(ld.LineIndex, "_put", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ld.drop_lines(frame(spark, ["a\nb"] * 12)).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quarry_run")]


def test_one_document_of_many_hot_lines(spark):
    """50,000 hot lines in each of a dozen documents, each in linear time."""
    text = "\n".join(f"line {i % 40000}" for i in range(50000))
    df = frame(spark, [f"{text}\nown {i}" for i in range(12)])
    got = ld.drop_lines(df).collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in sorted(got, key=lambda r: r.doc_id)] == [(50001, 50000, f"own {i}") for i in range(12)]


def test_lines_with_clashing_names(spark):
    rows = [(i, "hot\nown %d" % i, "r", "t", "k", "h", 5, "A") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, _text string, _kept string, _hot string, N_LINES int, h string")
    got = ld.drop_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r._row, r._text, r._kept, r._hot, r.h, r.n_lines, r.n_dropped) for r in got] == [(f"own {i}", "r", "t", "k", "h", "A", 2, 1) for i in range(12)]


def test_lines_without_report(spark):
    df = spark.createDataFrame([(i, f"hot\nown {i}", "mine", 7) for i in range(12)], "doc_id long, text string, n_lines string, n_dropped int")
    got = ld.drop_lines(df, report=False)
    assert got.columns == df.columns and {(r.text[:3], r.n_lines, r.n_dropped) for r in got.collect()} == {("own", "mine", 7)}


def test_many_hot_lines(spark, monkeypatch):
    rows = [(i, "\n".join(["top"] + [f"l{(i + k) % 60}" for k in range(20)] + [f"own {i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ld, "BROADCAST_LINES", 40)
    got = ld.drop_lines(df).orderBy("doc_id").collect()
    assert [r.text for r in got] == [f"own {i}" for i in range(60)]
