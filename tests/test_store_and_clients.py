import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import clients as C
from quarry.operators import search as S
from quarry.sources import files, scratch, store


def test_calls_fall_back():
    waits = []

    def one(model, prompt):
        raise RuntimeError({"r": "429 retry in 1.5s", "d": "429 perday"}.get(prompt, "boom"))

    two = lambda model, prompt: f"{model}:{prompt}"
    client = {"a": one, "b": two}.__getitem__
    assert C.call("r", ["a", "b"], client, waits.append) == ("b:r", "b", None) and waits == [3.5, 3.5]
    assert C.call("d", ["a"], client, waits.append) == (None, None, "429 perday") and len(waits) == 2
    assert C.call("x", [], client) == (None, None, "no model")
    assert C.wait_seconds("busy") == 15 and C.provider_of("big-7", {"big": "p"}, "q") == "p" and C.provider_of("x", {}, "q") == "q"


def test_roles_are_required(spark):
    df = spark.createDataFrame([("user",), ("robot",)], "role string")
    assert store.require_role(df.where("role = 'user'")).count() == 1
    with pytest.raises(Exception, match="role not allowed: robot"):
        store.require_role(df).collect()


def test_repeated_changes_count_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    assert sorted(map(str, store.update(old, new, ["k"], ["v"]).collect())) == sorted(["Row(k=1, v='y')", "Row(k=2, v=None)", "Row(k=None, v='n')"])


@pytest.mark.parametrize("x,n", [(2.675, 2), (0.125, 2), (0.375, 2), (-2.5, 0), (1.005, 2), (12345.6785, 3), (0.0, 1), (-0.15, 1)])
def test_exact_round(spark, x, n):
    assert spark.range(1).select(T.exact_round(F.lit(x), n).alias("r")).first().r == round(x, n)


def test_exact_mean(spark):
    """The mean is that of the exact sum, for any partitioning, and rounded as Python does."""
    import math
    import random

    rnd = random.Random(1)
    rows = [(g, x) for g in range(30) for x in [rnd.choice([1e15, -1e15, 1e-9, 0.1, 2.675, rnd.random(), rnd.gauss(0, 1e6)]) for _ in range(rnd.randrange(1, 200))]]
    rows += [(100, 2.675), (101, None), (102, float("nan")), (102, 1.0), (103, 0.125), (104, 1e300), (105, -0.0625)]
    want = {}
    for g in {g for g, _ in rows}:
        xs = [x for h, x in rows if h == g and x is not None]
        want[g] = round(math.fsum(xs) / len(xs), 3) if xs and not any(math.isnan(x) for x in xs) else None
    for n in (1, 7):
        df = spark.createDataFrame(rows, "g int, x double").repartition(n, F.rand())
        got = {r.g: r.m for r in df.groupBy("g").agg(T.exact_mean(F.col("x"), 3).alias("m")).collect()}
        assert math.isnan(got.pop(102)) and got == {g: m for g, m in want.items() if g != 102}
    assert spark.range(0).agg(T.exact_mean(F.col("id"), 2).alias("m")).first().m is None


def test_scratch(spark, tmp_path):
    df = scratch.stored(spark.range(5), "t")
    path = df.inputFiles()[0]
    assert scratch.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    scratch.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_best_prefers_small_ids():
    import numpy as np
    import pyarrow as pa

    ids = pa.array(["d", "c", "b", "a", "e"])
    none = np.zeros(5, int)
    got = S.kept_places(none, none, ids, np.array([1.0, 1.0, 2.0, 1.0, 0.5]), 2)
    assert [ids[i].as_py() for i in got] == ["b", "a"]
    assert len(S.kept_places(none[:0], none[:0], ids[:0], np.zeros(0), 2)) == 0


def test_a_change_counts_whole(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "z", None, 1), (1, None, 9, 2), (2, None, None, 1)], "k int, v string, n int, at int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.update(old, new, ["k"], ["v", "n"], "at")) == [(1, "a", 9), (2, "b", 2), (3, "c", 3)]
    assert [tuple(r) for r in store.update(old, new, ["k"], ["v", "n"], "at", nulls=True).orderBy("k").collect()] == [(1, None, 9), (2, None, None), (3, "c", 3)]


def test_numbers_by_part(spark):
    new = spark.range(1000).selectExpr("hash(id) AS h", "id AS v").repartition(7)
    last = spark.range(1).selectExpr("100L AS last")
    got = store.numbered(new, ["h", "v"], last).orderBy("id").collect()
    assert [r.id for r in got] == [*range(101, 1101)] and [(r.h, r.v) for r in got] == sorted((r.h, r.v) for r in got)
    plan = store.numbered(new, ["h", "v"], last)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and store.numbered(new.limit(0), ["h"], last).collect() == []


def rows_read(df):
    """What the scan below a collected frame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_lookups_read_one_row_group_of_many(spark, tmp_path):
    df = spark.range(60000).selectExpr("format_string('c%06d', id) AS chunk_id", "sha2(string(id % 20000), 256) AS session", "repeat(sha2(string(id), 512), 4) AS text").repartition(9)
    path = str(tmp_path / "t")
    store.write_sorted(df, path, "chunk_id", ("session",), row_group=1 << 18, files=3)
    back = spark.read.parquet(path)
    session = df.where("chunk_id = 'c000077'").first().session
    for want, n, part in ((store.matching(back, chunk_id="c012345"), 1, 20), (store.matching(back, chunk_id="none"), 0, 20), (store.matching(back, session=session), 3, 4)):
        assert len(want.collect()) == n and rows_read(want) < 60000 / part
    plain = str(tmp_path / "plain")
    df.write.parquet(plain)
    all_ = store.matching(spark.read.parquet(plain), session=session)
    assert len(all_.collect()) == 3 and rows_read(all_) >= 20000


def test_calls_in_flight(spark, tmp_path):
    """1,000 calls of 100 ms in pools of 16, 8 tasks: about a second, not 100."""
    log = tmp_path / "calls"

    def client(model, prompt):
        import os
        import time

        fd = os.open(log, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
        os.write(fd, b"x")
        os.close(fd)
        time.sleep(0.1)
        if prompt.startswith("limit") and not hasattr(client, prompt):
            setattr(client, prompt, 1)
            raise RuntimeError("RESOURCE_EXHAUSTED, retry in 0s")
        return prompt.upper()

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(1000)] + [(2000 + i, "equal") for i in range(300)] + [(3000, "limit a"), (3001, None)], "query_id long, prompt string")
    start = __import__("time").perf_counter()
    df = C.replies(prompts, ["m"], {"x": client}, {}, "x", sleep=lambda s: None)
    took = __import__("time").perf_counter() - start
    got = {r.query_id: r for r in df.collect()}
    assert len(got) == 1302 and took < 30
    assert got[7].reply == "P7" and got[2005].reply == "EQUAL" and got[3000].attempts == 2 and got[3001].reply == ""
    df.collect()  # stored: nothing is asked twice
    assert log.stat().st_size == 1000 + 1 + 2 + 1


def test_pace():
    now, slept = [0.0], []
    pace = C.Pace(2, lambda s: slept.append(round(s, 3)), lambda: now[0])
    for _ in range(3):
        pace.start("m")
    assert slept == [0.5, 1.0]
    pace.hold("m", 60)
    pace.start("m")
    assert slept[-1] == 60


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda a, b: [len(x or "") + len(y or "") / 100 for x, y in zip(a, b)]

    score = C.task_model(load, "double")
    df = spark.range(30000, numPartitions=2).selectExpr("repeat('a', int(id % 3)) AS a", "if(id = 0, NULL, 'bc') AS b")
    assert {round(r.s, 2) for r in df.select(score("a", "b").alias("s")).collect()} == {0.0, 0.02, 1.02, 2.02}
    assert log.stat().st_size == 2


def test_dense_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    v = spark.createDataFrame([("x", "a", [1.0, 0.0]), ("x", "b", [0.0, 1.0]), ("x", "n", None), ("y", "c", [1.0, 0.0])], "domain string, chunk_id string, vector array<double>")
    got = [(r.domain, r.chunk_id, r.score, r["rank"]) for r in S.dense(q, v, 1).orderBy("domain").collect()]
    assert got == [("x", "a", 1.0, 1), ("y", "c", 1.0, 1)]
    wanted = spark.createDataFrame([(1, "y")], "query_id long, domain string")
    assert [r.chunk_id for r in S.dense(q, v, 5, wanted).collect()] == ["c"]
    assert S.dense(q.where("query_id = 2"), v, 5).collect() == []


def test_file_kinds(spark, tmp_path):
    for name in ("b.TXT", "a.md", "z.txt", "k.pdf", "e.docx", "x.bin"):
        (tmp_path / name).write_bytes(b"some text")
    found = files.in_order(files.scan(spark, str(tmp_path))).collect()
    assert [r.source_file.rsplit("/", 1)[1] for r in found] == ["k.pdf", "b.TXT", "z.txt", "a.md", "e.docx"]
    assert files.segments_of("e.docx", b"broken") == []


def test_pdf_pages(monkeypatch):
    """With a parser: numbered pages, blank ones left out; a broken file has none."""
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    class Reader:
        def __init__(self, data):
            if data.read() == b"broken":
                raise ValueError("no PDF")
            self.pages = [Page("first"), Page(" "), Page(None), Page("last")]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files.segments_of("x.PDF", b"fine") == [("first", 1), ("last", 4)]
    assert files.segments_of("x.pdf", b"broken") == []


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_table(spark.range(3), path)
    store.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    with pytest.raises(Exception):
        store.replace_table(spark.range(2).select(F.raise_error(F.lit("stop"))), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_served_names(spark):
    held = spark.createDataFrame([("/kb/a.txt",), ("/other/a.txt",)], "source_file string")
    asked = spark.createDataFrame([("a.txt",), ("../a.txt",), ("..",), ("",), (None,), ("b.txt",)], "name string")
    got = {r.name: (r.status, r.source_file) for r in files.served(asked, held).collect()}
    assert got == {"a.txt": (200, "/kb/a.txt"), "../a.txt": (403, None), "..": (403, None), "": (403, None), None: (403, None), "b.txt": (404, None)}


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [(1, ' a "b", c '), (2, "x\ny\r\nz"), (3, None)]
    store.write_csv(spark.createDataFrame(rows, "k int, v string"), str(tmp_path / "csv"), 1)
    assert sorted(tuple(r) for r in store.read_csv(spark, str(tmp_path / "csv"), "k int, v string").collect()) == rows


def test_sizes_and_escapes(spark):
    got = spark.createDataFrame([(1023, None), (1280, '<"&">'), (3 << 20, "")], "n long, v string").select(T.size_label(F.col("n")), T.size_label(F.col("n"), 0), T.escape_html(F.col("v")))
    assert [tuple(r) for r in got.collect()] == [("1023 B", "1023 B", ""), ("1.3 KB", "1 KB", "&lt;&quot;&amp;&quot;&gt;"), ("3.0 MB", "3.0 MB", "")]


def test_indexes_are_made_once(spark):
    held, made = S.Indexes(), []
    chunks = spark.createDataFrame([("d", "c1", "some words")], "domain string, chunk_id string, text string")
    for _ in range(2):
        assert held.of("d", lambda: made.append(1) or chunks).count() == 1
    held.evict("d")
    held.evict("none")
    assert made == [1] and held.of("d", lambda: made.append(2) or chunks).count() == 1 and made == [1, 2]
