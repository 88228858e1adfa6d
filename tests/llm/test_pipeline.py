import numpy as np

import corpus_pipeline
from trialspark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    read, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        counts.append(read.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    before = spark.read.parquet(str(tmp_path / "near_dedup")).toPandas().set_index("doc_id").text
    after = read.toPandas().set_index("doc_id").text
    changed = before[before != after.reindex(before.index)]
    assert 0 < len(changed) < 0.3 * len(before) and not after.str.contains(r"@[a-z0-9]+\.example", regex=True).any()
    pieces = corpus_pipeline.STAGES[-1][1](spark, read, SF)
    assert pieces.select("doc_id").distinct().count() == counts[-1]


def test_queries_and_sql_names():
    from trialspark.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def odd_documents(spark):
    """Good texts with columns named as results, repeats, null ids and odd texts."""
    rows = table(spark, SF, "documents").where("n_chars between 600 and 3000").orderBy("doc_id").limit(40).collect()
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "llr", "lang_pred", "node", "h", "n_words", "a.b", "predicted"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, llr string, lang_pred string, node string, h string, n_words string, `a.b` string, predicted string"
    own = lambda r, i: (i, r.text, r.lang, r.source, r.n_chars, *[f"{n}{r.doc_id}" for n in names[5:]])
    data = [own(r, r.doc_id) for r in rows] + [own(rows[0], rows[0].doc_id), own(rows[1], None), own(rows[2], rows[3].doc_id)]
    data += [(900_000, None, None, None, None, *["x"] * 9), (900_001, "", "en", "s", 0, *["x"] * 9), (None, None, None, None, None, *[None] * 9)]
    return spark.createDataFrame(data, kind)


def test_stages_keep_columns_named_as_results(spark, tmp_path):
    docs = odd_documents(spark)
    read, given = docs, {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        rows = read.collect()
        assert len(rows) >= 20, name
        for r in rows:
            if name != "pii":
                was = given[r.doc_id, r.text]
                assert all(r[c] == was[c] for c in ("score", "kept", "llr", "lang_pred", "node", "h", "n_words", "a.b", "predicted"))
    assert len({r.text for r in rows}) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, read, SF).count() >= len(rows)


def test_stages_of_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_dedup_stage_equals_brute_force(spark):
    from test_exact import brute_components

    docs = table(spark, SF, "documents")
    rows = docs.collect()
    groups = brute_components([r.text for r in rows], [r.doc_id for r in rows], 5, 80)
    want = sorted(d for d, (n, c) in groups.items() if n == 0 or d == c)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert sorted(np.array([r.doc_id for r in got.select("doc_id").collect()]).tolist()) == want
