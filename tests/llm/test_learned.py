"""Operators that learn: held-out accuracy and defined results for odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import language_id, quality_ranker, quality_rules, toxicity
from trialspark.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, score string, kept string"


def odd_rows(spark):
    """Null and empty fields, ties, repeats, a long text, columns named as results."""
    rows = [(1, None, None, "s", "k"), (2, "", "en", "s", "k"), (None, "the cat", "en", "s", "k"), (3, "12 34 !?", None, "s", "k"), (3, "12 34 !?", None, "s", "k"), (4, "ab " * 300_000, "fr", None, None)]
    return spark.createDataFrame(rows, ODD)


def test_held_out_follows_crc32(spark):
    d = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in d.collect())


def accuracy(spark, scored, label):
    rows = scored.join(table(spark, SF, "labels"), "doc_id").where(held_out()).select("score", label).toPandas()
    ranks = rows.score.rank().to_numpy()
    one = rows[label].to_numpy() == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / one.sum() / (~one).sum()


def test_quality_ranker(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_ranker.fit(docs, labels)
    assert accuracy(spark, quality_ranker.score(docs, model, ["doc_id"]), "quality") > 0.9
    out = quality_ranker.score(odd_rows(spark), model)
    assert out.columns.count("score") == 1 and out.count() == 6 and out.where("score between 0 and 1").count() == 6
    assert {r.score for r in quality_ranker.score(odd_rows(spark), quality_ranker.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_ranker.score(docs.limit(0), model).count() == 0


def test_pairs_learn_the_order():
    rng = np.random.RandomState(0)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    y = (x[:, 0] - 2 * x[:, 2] > -0.5).astype(int)
    model = quality_ranker.fit_pairs(x, y)
    assert ((model.score(x) >= quality_ranker.CUT) == y).mean() > 0.95


def test_threshold_keeps_the_population_share():
    rng = np.random.RandomState(3)
    y = (np.arange(20_000) % 20 > 2).astype(int)
    x = (rng.normal(size=(20_000, 3)) + y[:, None] * [1.0, 0.5, 0]).astype(np.float32)
    few = np.concatenate([np.flatnonzero(y == v)[:1500] for v in (0, 1)])
    whole, capped = quality_ranker.fit_pairs(x, y), quality_ranker.fit_pairs(x[few], y[few], bad_share=0.15)
    assert abs((whole.score(x) < quality_ranker.CUT).mean() - 0.15) < 0.001
    assert abs((capped.score(x) < quality_ranker.CUT).mean() - 0.15) < 0.03
    v = rng.normal(size=99)
    assert np.isclose(quality_ranker.weighted_quantile(v, np.ones(99), 0.3), np.quantile(v, 0.3))


def test_a_class_bound_leaves_the_bad_share(spark, monkeypatch):
    docs, labels, seen = table(spark, SF, "documents"), table(spark, SF, "labels"), []
    monkeypatch.setattr(quality_ranker, "fit_pairs", lambda x, y, **given: seen.append((y.mean(), given["bad_share"])))
    for bound in (20, 4000):
        quality_ranker.fit(docs, labels, per_class=bound)
    known = [r.quality for r in labels.unionByName(labels).dropDuplicates(["doc_id"]).where(~held_out()).collect() if r.quality in (0, 1)]
    assert seen[0] == (0.5, seen[1][1]) and abs(seen[1][1] - known.count(0) / len(known)) < 1e-9


def test_toxicity_finds_inserted_words():
    rng = np.random.RandomState(1)
    words = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(300)]
    insults = ["blockhead", "numbskull", "scoundrel"]

    def text(bad):
        ws = rng.choice(words, 120).tolist()
        if bad:
            for at in rng.choice(120, 4, False):
                ws[at] = rng.choice(insults)
        return " ".join(ws)

    y = np.array([i % 2 for i in range(400)])
    model = toxicity.fit_texts([text(v) for v in y], y, 0.5)
    of = toxicity.Distance(model.ordinary, model.toxic)
    score = lambda t: 1 / (1 + np.exp(-(np.array(of.features(toxicity.plain(t))) @ model.weights + model.bias)))
    assert np.mean([score(text(1)) > 0.5 for _ in range(60)]) > 0.9 and np.mean([score(text(0)) > 0.5 for _ in range(60)]) < 0.1
    # an insult far into a long text counts as well
    assert score(text(0) + " " + text(0) + " " + " ".join(insults * 3)) > 0.5


def test_toxicity_held_out():
    """Learnt from the learnable rows alone; rated on the others, by class."""
    import pandas as pd

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id").dropna(subset=["text"])
    out = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id])
    known = rows[~out & (rows.text.str.len() < toxicity.LONGEST)]
    model = toxicity.fit_texts(known.text.tolist(), known.toxic.to_numpy(), known.toxic.mean())
    of, held = toxicity.Distance(model.ordinary, model.toxic), rows[out]
    score = 1 / (1 + np.exp(-(np.array([of.features(toxicity.plain(t)) for t in held.text]) @ model.weights + model.bias)))
    toxic = held.toxic.to_numpy() == 1
    assert (score[toxic] >= toxicity.CUT).mean() >= 0.75 and (score[~toxic] >= toxicity.CUT).mean() <= 0.06


def test_dictionaries_are_the_trainers():
    toxic = [b" the " + b" ".join([b"scoundrel", b"x%d" % i, b"blockhead"]) + b" of " for i in range(300)]
    ordinary = [b" the fine x%d of all " % i for i in range(300)]
    told = toxicity.stretches(toxic, ordinary)
    assert told and all(b"scoundrel" in s or b"blockhead" in s for s in told) and not toxicity.stretches(toxic, toxic)
    assert b"scoundrel" in toxicity.train(told * 3, 512) and toxicity.train([b"a"], 512) == b""
    same = toxicity.distinct([b" " + b" ".join(b"w%d" % (i * j % 97) for i in range(80)) + b" " for j in (3, 3, 5)])
    assert len(same) == 2
    assert toxicity.windows(b"") == [b""] and b"".join(w[:112] for w in toxicity.windows(bytes(range(250)) * 3))[:750] == bytes(range(250)) * 3


def test_toxicity_of_odd_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert {r.score for r in toxicity.score(odd_rows(spark), toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    model = toxicity.fit(docs, labels)
    out = toxicity.score(odd_rows(spark), model)
    assert out.columns.count("score") == 1 and out.count() == 6 and out.where("score between 0 and 1").count() == 6
    empty = {r.score for r in out.where("coalesce(text, '') = ''").collect()}
    assert len(empty) == 1 and toxicity.score(docs.limit(0), model).count() == 0
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert toxicity.fit(docs, both) is None


def test_language_id(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs)
    held = language_id.identify(docs, model, ["doc_id", "lang"]).where(held_out())
    assert held.where("lang = lang_pred").count() > 0.97 * held.count()
    got = [(r.lang_pred, r.score) for r in language_id.identify(odd_rows(spark), model).collect()]
    assert [g[0] for g in got].count("und") == 4 and all(0 <= s <= 1 for _, s in got)
    assert language_id.fit(docs.limit(0)).names == []
    assert {r.lang_pred for r in language_id.identify(odd_rows(spark), language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_language_blocks_of_a_long_text(spark, monkeypatch):
    model = language_id.fit(table(spark, SF, "documents").limit(300))
    text = "le chat et la souris dans une maison " * 40
    whole = language_id.classify([text], model)
    monkeypatch.setattr(language_id, "BLOCK", 64)
    parts = language_id.classify([text, "", None], model)
    assert parts[0][0] == whole[0][0] and parts[0][1:] == ["und", "und"]
    total = lambda: sum(int(np.diff(b).sum()) for _, o, c in language_id._blocks([text]) for _, b in [next(language_id._hashed(c, o))])
    assert total() >= len(text)


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    mark = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(mark)


@pytest.mark.parametrize("text", ["", "a", "a b c a b c", "x x x x", "é ß\n\né ß\né ß \n", "# *|\n\r\n#\t*|", "one\x0btwo\x0cthree " * 5, "日本 語 x\n" * 3])
def test_base_rules_equal_brute_force(spark, text):
    from trialspark.llm.common import Words

    raw = np.frombuffer(("zz zz " + text).encode(), np.uint8)
    words = Words(raw, np.array([0, 6, len(raw), len(raw)]))
    got = quality_rules.base_rules(words)
    assert tuple(int(got[c][1]) for c in quality_rules._COUNTS) == brute_rules(text)
    assert tuple(int(got[c][2]) for c in quality_rules._COUNTS) == (0, 0, 0, 0, 0)


def test_quality_rules(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    ratio = quality_rules.fit(docs, labels)
    out = quality_rules.judge(docs, ratio, keep=["doc_id"]).join(labels, "doc_id").where("not base_failed")
    assert out.where("quality = 0 and kept").count() <= 0.1 * out.where("quality = 0").count()
    assert out.where("quality = 1 and kept").count() >= 0.95 * out.where("quality = 1").count()
    odd = quality_rules.judge(odd_rows(spark), ratio)
    assert odd.columns.count("kept") == 1 and odd.where("kept").count() == 0 and odd.where("n_words = 0").count() == 2
    assert not quality_rules.fit(docs.limit(0), labels).any()


def test_counts_equal_brute_force(spark):
    d = spark.createDataFrame([("abcd",), ("abcde",), (None,), ("",)], "text string")
    assert quality_rules.count_ngrams(d).sum() == (2 + 1) + (3 + 2)


def test_ratio_equals_brute_force(spark):
    from trialspark.llm.common import text_buffers
    import pyarrow as pa

    docs, labels = table(spark, SF, "documents").limit(120), table(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").where(~held_out()).collect()}

    def bucket(gram):
        return (int.from_bytes(bytes([len(gram)]) + gram, "big") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48

    def grams(text):
        data = (text or "").encode()
        return [bucket(data[i : i + n]) for n in quality_rules.ORDERS for i in range(len(data) - n + 1)]

    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, text in texts.items():
        np.add.at(raw, grams(text), 1)
        if i in good and text is not None and len(text.encode()) <= quality_rules.LONGEST:
            np.add.at(target, grams(text), 1)
    data, offsets = text_buffers(pa.array(["abcde"]))
    assert sorted(quality_rules.ngrams(data, offsets)[0].tolist()) == sorted(grams("abcde"))
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    mass = quality_rules.PRIOR * len(raw)
    want = np.log((target + mass * p) / (target.sum() + mass)) - np.log(p)
    assert np.allclose(quality_rules.fit(docs, labels), want)
    ratio = quality_rules.fit(docs, labels)
    for r in quality_rules.judge(docs, ratio, keep=["doc_id"]).collect():
        own = grams(texts[r.doc_id])
        llr = want[own].mean() if own else 0.0
        assert abs(llr - r.llr) < 1e-6 and r.kept == (not r.base_failed and llr >= quality_rules.THRESHOLD)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    d = spark.createDataFrame([(i, "some text here", f"l{min(i % 7, 4)}") for i in range(200)], "doc_id long, text string, lang string")
    assert len(language_id.fit(d).names) == 2
