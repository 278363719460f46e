import re
from collections import Counter

import corpus_pipeline as cp
from quarry.llm import decontaminate as de
from tests.llm.test_mix_decon import check_mix, distance
from tests.llm.test_near_dedup import brute
from tests.llm.test_scans import line_key


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mix"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate([None, "", "12 34", "ok then"] * 2)] + [(None, "a null id", "en", "src0", 3)], docs.schema)
    docs = docs.unionByName(extra)
    kept = cp.language(spark, docs, sf_dir).collect()
    letter = re.compile(r"[^\W\d_]")
    known = {r.lang for r in docs.collect()} - {None}
    plain = lambda r: str((r.doc_id, r.text, r.source, r.n_chars))
    assert sorted(map(plain, kept)) == sorted(plain(r) for r in docs.collect() if r.text and letter.search(r.text))
    assert {r.lang for r in kept} == known
    one = spark.createDataFrame(kept, docs.schema)
    two = cp.lines(spark, one, sf_dir)
    assert two.columns == docs.columns
    held = Counter(k for r in kept for k in {line_key(x) for x in r.text.split("\n")})
    rows = two.collect()
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not line_key(x) or held[line_key(x)] < 10) for r in kept}
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    two = spark.createDataFrame(rows, docs.schema)
    three = cp.near_duplicates(spark, two, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in three) == sorted(str(i) for i, _, c in brute([(r.doc_id, r.text) for r in rows], 5, 80) if c is None or c == i)
    three_df = spark.createDataFrame(three, docs.schema)
    four = cp.benchmark(spark, three_df, sf_dir).collect()
    items = [re.findall("[0-9a-z]+|[^\x00-\x7f]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in three} - {r.doc_id for r in four}
    verbatim = {r.doc_id for r in three if any(" ".join(t.split()) in " ".join(r.text.split()) for t in (x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))}
    assert verbatim <= gone and gone and items and distance("ab", "b") == 1 and de.DISTANCE == 0.2
    check_mix([(r.doc_id, r.source, r.text) for r in four], cp.mix(spark, spark.createDataFrame(four, docs.schema), sf_dir).collect())


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []


def test_odd_columns_and_rows(spark, sf_dir):
    """Long texts, repeated rows and names that operators use inside."""
    rows = [(i, f"some words here {i} " + "and more of them " * 40 + str(i * i), "en", f"src{i % 3}", 3, "x", 1, "y") for i in range(20)]
    rows += [rows[0], rows[0], (50, "long " * 60000 + "end", None, None, None, "x", 1, "y"), (None, "no id at all", None, None, None, "x", 1, "y"), (51, None, "en", "src0", 0, "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _gone string, n_lines int, _row string")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[-3:] == ["_gone", "n_lines", "_row"]
    got = docs.collect()
    assert {(r._gone, r.n_lines, r._row) for r in got} == {("x", 1, "y")}
    assert sum(r.doc_id == 0 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1 and not [r for r in got if r.doc_id == 51]
    mixed = cp.mix(spark, docs, sf_dir).collect()
    check_mix([(i, r.source, r.text) for i, r in enumerate(got)], [type("R", (), dict(zip(("doc_id", "size", "source_size", "target", "taken"), (i, m.size, m.source_size, m.target, m.taken)))) for i, m in enumerate(_aligned(got, mixed))])


def _aligned(docs, mixed):
    """The mix's rows in the order of the documents: by id and size."""
    left = list(mixed)
    out = []
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        at = next(i for i, m in enumerate(left) if (m.doc_id, m.size) == (r.doc_id, n))
        out.append(left.pop(at))
    return out


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert rows and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(abs(sum(r.taken for r in rs) - t) <= 2 for (_, t), rs in by.items())
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r.size for r in rows)) < 50


def test_predicted_languages_reach_the_mix(spark):
    """A third of the documents has no label: what is predicted decides the mix."""
    said = {"en": "the end of that day and of the night with this", "de": "der und die das nicht ein haus mit dem hund"}
    rows = [(i, " ".join(said[x].split()[(i * j) % 10] for j in range(1, 33 + i % 7)), x if i % 3 else None, "s", 1) for i, x in ((i, "en" if i % 2 else "de") for i in range(120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.language(spark, docs, None)
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(i, "en" if i % 2 else "de") for i in range(120)]
    got = cp.mix(spark, kept, None).collect()
    check_mix([(r[0], r[3], r[1]) for r in rows], got)
    for odd in (0, 1):
        mine = [r for r in got if r.doc_id % 2 == odd]
        assert abs(sum(r.taken for r in mine) - 1.5 * sum(r.size for r in mine)) <= 2
    assert sorted(cp.mix(spark, docs, None).collect()) != sorted(got)
