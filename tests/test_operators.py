import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import jsonx
from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import evaluation as E
from quarry.operators import routing as R
from quarry.operators import search as S
from quarry.plans import hybrid
from quarry.sources import files, store
from quarry.streaming import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_clean_and_tokens(spark):
    assert one(spark, T.clean(F.lit(" a\x00b\n\n\n\nc \t d\x0c"))) == "a b\n\nc d"
    assert one(spark, T.tokens(F.lit("Été n'est _x２３ ß!"))) == ["été", "n", "est", "_x２３", "ß"]


@pytest.mark.parametrize("n,starts", [(0, []), (1, [0]), (800, [0]), (801, [0, 650]), (1450, [0, 650]), (1451, [0, 650, 1300]), (2000, [0, 650, 1300])])
def test_chunk_windows(spark, n, starts):
    w = [f"w{i:05d}xxxxxxxxxxxxxxxxxxxxx" for i in range(n)]
    df = spark.createDataFrame([("D", "kb/a.b.txt", None, " ".join(w))], "domain string, source_file string, page int, text string")
    got = T.chunks(df).orderBy("chunk_index").collect()
    assert [r.text.split()[0] for r in got] == [w[s] for s in starts]
    assert [r.chunk_id for r in got] == [f"D_a.b_{i:04d}" for i in range(len(starts))]
    if n:
        assert {x for r in got for x in r.text.split()} == set(w)


def test_short_chunks_are_dropped_without_a_number(spark):
    df = spark.createDataFrame([("D", "a.txt", 1, "tiny"), ("D", "a.txt", 2, "long enough to be kept here"), ("D", "a.txt", 3, "and this one is kept as well")], "domain string, source_file string, page int, text string")
    assert [(r.page, r.chunk_index) for r in T.chunks(df).orderBy("page").collect()] == [(2, 0), (3, 1)]
    with pytest.raises(ValueError):
        T.chunks(df, 10, 10)


def test_labels(spark):
    for path, page, want in [("kb/LLMs_intro-notes.pdf", 3, "LLMs Intro Notes, p.3"), ("a.b.pdf", 0, "A.b"), ("x/fooBAR.txt", None, "Foobar")]:
        assert one(spark, T.citation_label(F.lit(path), F.lit(page).cast("int"))) == want


def test_json(spark):
    assert one(spark, jsonx.salvage(F.lit("```json\n{\"a\": 1}\n```"))) == '{"a": 1}'
    assert one(spark, jsonx.salvage(F.lit("so {\"a\": {\"b\": 2}} ok"))) == '{"a": {"b": 2}}'
    assert one(spark, jsonx.salvage(F.lit("{broken"))) == "{}"
    v = one(spark, jsonx.verdict(F.lit("nonsense")))
    assert (v.is_satisfactory, v.quality, v.revised_answer) == (True, 0.7, None)


def test_bm25_one_chunk_is_empty(spark):
    ch = spark.createDataFrame([("d", "c1", "alpha beta")], "domain string, chunk_id string, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert S.bm25(q, ch, 5).collect() == []


def test_fusion_bounds_and_ties(spark):
    s = spark.createDataFrame([(1, "d", "a", 0.9, 1), (1, "d", "b", 0.8, 2)], "query_id int, domain string, chunk_id string, score double, rank int")
    b = spark.createDataFrame([(1, "d", "b", 4.0, 1), (1, "d", "c", 2.0, 2)], s.schema)
    got = S.fuse(s, b, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and all(0 < r.rrf <= round(1 / 61, 9) for r in got)
    assert [r.bm25_score for r in got] == [1.0, 0.0, 0.5]


def test_rerank_keeps_the_best_one(spark):
    rows = [(1, "d", f"c{i}", "kb/f.txt", "alpha beta gamma", t, 0.01, i) for i, t in enumerate(["alpha beta gamma", "alpha", "none of it"])]
    hits = spark.createDataFrame(rows, "query_id int, domain string, chunk_id string, source_file string, query string, text string, rrf double, rank int")
    assert [r.chunk_id for r in S.rerank(hits).orderBy("rerank_rank").collect()] == ["c0"]
    assert [r.chunk_id for r in S.rerank(hits, threshold=5.0).collect()] == ["c0"]
    assert S.rerank(hits, threshold=0.0).count() == 3
    assert "[Source 1] — F" in S.prompt_context(S.rerank(hits)).first().context
    assert one(spark, S.overlap(F.lit(""), F.lit("x"))) == 0.0


def test_file_filter(spark):
    h = spark.createDataFrame([(1, "kb/a.pdf"), (1, "kb/b.pdf"), (2, "kb/b.pdf")], "query_id int, source_file string")
    assert S.file_filter(h, F.array(F.lit("a.pdf"))).count() == 2 and S.file_filter(h, F.array(F.lit("a.pdf")), strict=True).count() == 1


def test_routing(spark):
    kw = {"A": ["learn"], "B": ["vari", "stat"], "C": ["zz"]}
    q = spark.createDataFrame([(1, "Machine learning. And variance? Stats"), (2, "hi"), (3, "zz")], "query_id int, query string")
    r = {x.query_id: x for x in R.route(q, kw).collect()}
    assert r[1].domains == ["A", "B"] and r[1].intent_type == "multi" and r[2].needs_clarification and not r[3].needs_clarification
    s = sorted((x.query_id, x.pos, x.question, x.domain) for x in R.split(R.route(q, kw), kw).collect())
    assert s[:3] == [(1, 0, "Machine learning.", "A"), (1, 1, "And variance?", "B"), (1, 2, "Stats", "A")] and s[3][3] == "A" and s[4][3] == "C"


def test_answers(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    a = spark.createDataFrame([(1, "X", "one"), (2, "X", "p"), (2, "Y", "q")], "query_id int, domain string, answer string")
    assert {r.query_id: r.answer for r in A.synthesize(a, q).collect()} == {1: "one", 2: "**X**\np\n\n**Y**\nq", 3: A.NO_EVIDENCE}
    assert one(spark, A.failed_verdict()).quality == 0.7


def test_metrics(spark):
    assert one(spark, E.hit_rate(F.array(), F.array(F.lit("x")))) == 0.0
    a = spark.createDataFrame([(1, "Gravity bends light [Source 1]. Nothing [Source 9]."), (2, "no citation"), (3, "x [Source 1]")], "answer_id int, answer string")
    s = spark.createDataFrame([(1, 1, 0, "about GRAVITY"), (1, 1, 1, "other"), (2, 1, 0, "y")], "answer_id int, source_num int, pos int, text string")
    assert {r.answer_id: r.citation_accuracy for r in E.citation_accuracy(a, s).collect()} == {1: 0.5, 2: 1.0, 3: 1.0}


def test_files(spark, tmp_path):
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "A.TXT").write_text("plain")
    (tmp_path / "n.csv").write_text("no")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(data.getvalue())
    found = files.scan(spark, str(tmp_path))
    assert [r.name for r in files.listing(found).collect()] == ["A.TXT", "b.md", "c.docx"]
    assert sorted(r.text for r in files.segments(found, "D").collect()) == ["bad  byte", "one\ntwo", "plain"]
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


def test_store(spark, tmp_path):
    store.create_all(spark, str(tmp_path / "db"))
    store.create_all(spark, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/chat_messages")).columns[0] == "id"
    new = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "k int, v string, n int")
    assert sorted(r.v for r in store.new_rows(new, new.where("k = 2"), ["k"], ["n"]).collect()) == ["b"]
    store.write_csv(new, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_stream_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("D", "a.txt", 1, "long enough to be kept here")], ingest.FILES)
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_plans(spark, sf_dir):
    from quarry import catalogue as c

    t = lambda n: c.table(spark, sf_dir, n)
    ch = c.chunks(t)
    qv, cv = c.vectors(t, ch)
    q = c.benchmark(t)
    assert hybrid.answer(q, qv, ch, cv, c.KEYWORDS).count() == q.count()
    assert "References" in hybrid.study(q, qv, ch, cv).where("stopped IS NULL").first().answer


def test_prompt_scores_are_shown_by_their_exact_value(spark):
    scores = [0.1245, 0.0625, 0.1255, 0.2, 0.999501, -1.0625, -5.0005]
    rows = [(i, "d", "src/a.txt", "t", x, 1) for i, x in enumerate(scores)]
    hits = spark.createDataFrame(rows, "query_id int, domain string, source_file string, text string, rerank_score double, rerank_rank int")
    got = {r.query_id: r.context for r in S.prompt_context(hits).collect()}
    assert [got[i] for i in range(len(scores))] == [f"[Source 1] — A  (domain: d, score: {x:.3f})\nt" for x in scores]


def test_files_are_read_in_slices_of_bytes(spark, monkeypatch):
    import pyarrow as pa

    sizes = [3, 9, 0, 0, 4, 4, 3, 30, None, 1]
    batch = pa.RecordBatch.from_pydict({"x": pa.array([None if n is None else b"a" * n for n in sizes], pa.binary())})
    parts = [p.column("x").to_pylist() for p in files.slices(batch, "x", 10)]
    assert [x for p in parts for x in p] == batch.column("x").to_pylist()
    assert all(len(p) == 1 or sum(len(x or b"") for x in p) <= 10 for p in parts) and len(parts) == 6
    assert list(files.slices(batch.slice(0, 0), "x")) == []
    rows = [(f"{i}.{'txt' if i % 2 else 'docx'}", bytes(f"text {i}", "utf-8") if i % 2 else files.docx_of(f"text {i}")) for i in range(40)]
    got = files.segments(spark.createDataFrame(rows, "source_file string, content binary"), "D").collect()
    assert sorted(r.text for r in got) == sorted(f"text {i}" for i in range(40))
