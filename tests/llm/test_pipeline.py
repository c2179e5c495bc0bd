"""The pipeline's stages, each on its own input."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as p
from strata.llm import bpe, decontam, queries
from tests.llm.test_llm import brute_components, brute_lines
from tests.oracle import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"Clean words number {k} stand here alone with some more of them {k * 7} {k * 13}\nsecond line {k}", "en", "s", 1, 0.5, "k") for k in range(30)]
    rows += [(100 + k, "the shared line\n" + f"own line {k}", "en", "s", 1, 0.5, "k") for k in range(12)]
    rows += [(200, "You stupid idiot, worthless trash", "en", "s", 1, 0.5, "k"), (300, "", "en", "s", 0, 0.5, "k"), (301, None, None, None, None, None, None)]
    near = " ".join(f"w{j}" for j in range(60))
    rows += [(400, near, "en", "s", 1, 0.5, "k"), (401, near + " x", "en", "s", 1, 0.5, "k"), (402, near, "en", "s", 1, 0.5, "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_toxic_documents_go(spark, docs):
    out = p.drop_toxic(spark, docs, SF)
    assert out.columns == COLUMNS and ids(out) == [i for i in ids(docs) if i != 200]


def test_lines_stay_once(spark, docs):
    out = p.dedup_lines(spark, docs, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    order = sorted(rows)
    want = dict(zip(order, brute_lines([rows[i].text for i in order], 10, "first"), strict=True))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == COLUMNS and set(got) == set(order)
    assert all(got[i].text == want[i] and got[i].n_chars == len(want[i]) for i in order)


def test_one_of_each_group_stays(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted(i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c)
    out = p.dedup_documents(spark, docs, SF)
    assert out.columns == COLUMNS and ids(out) == want and 401 not in want


def test_leaks_go(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    leak = spark.createDataFrame([(500, "before " + item.upper() + " after", "en", "s", 1, 0.5, "k")], docs.schema)
    out = p.drop_leaks(spark, docs.union(leak), SF)
    assert out.columns == COLUMNS and ids(out) == ids(docs)


def test_leaks_with_repeated_and_null_ids_go_alone(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    more = [(500, "before " + item + " after", "en", "s", 1, 0.5, "k"), (500, "a clean text", "en", "s", 1, 0.5, "k"), (None, item, "en", "s", 1, 0.5, "k"), (None, "clean too", "en", "s", 1, 0.5, "k")]
    out = p.drop_leaks(spark, spark.createDataFrame(more, docs.schema), SF)
    assert out.columns == COLUMNS and {(r.doc_id, r.text) for r in out.collect()} == {(500, "a clean text"), (None, "clean too")}


def test_encoding(spark, docs):
    codec = bpe.Codec(bpe.Vocabulary.load(queries.tokenizer_path()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in p.encode(spark, docs, SF).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, codec.encode(texts[r.doc_id]))).encode()).hexdigest()


def test_empty_documents_pass_through(spark, docs):
    rows = docs.limit(0)
    for _, stage in p.STAGES:
        rows = stage(spark, rows, SF)
        assert rows.collect() == []


def test_whole_run(spark):
    assert p.run(spark, SF).count() > 0


def test_leaks_are_sought_in_a_space_of_all_passages(spark, tmp_path, monkeypatch):
    rng, made, fit = random.Random(4), [], decontam.randomised_svd
    words = [f"w{k}" for k in range(104)]
    texts = [" ".join(rng.choices([*words, *words[:20], "other"], k=rng.randrange(1, 90))) for _ in range(2000)]
    items = [(k, " ".join(words[k * 26 : k * 26 + 26])) for k in range(4)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(decontam, "randomised_svd", lambda *a: made.append((a[1], fit(*a))) or made[-1][1])
    docs = spark.createDataFrame([*enumerate(texts), (None, "a. " + items[2][1].upper())], "doc_id bigint, text string")
    assert p.drop_leaks(spark, docs, str(tmp_path)).where("doc_id is null").count() == 0
    [(idf, basis)], index = made, decontam.Index(items)
    exact = np.zeros((104, 104))
    for codes in map(index.codes_of, [*texts, "a. " + items[2][1], *(t for _, t in items)]):
        for at in decontam.passages(codes).tolist():
            place, value = decontam.tfidf(codes[at : at + decontam.WINDOW], idf)
            exact[np.ix_(place, place)] += np.outer(value, value)
    assert np.isclose(np.trace(basis.T @ exact @ basis), np.linalg.eigvalsh(exact)[-decontam.RANK :].sum(), rtol=1e-9)


def test_the_classifier_is_fitted_on_all_documents(spark, tmp_path, monkeypatch):
    """Its weights are the least over every document outside the held-out fold, with its label and without."""
    rng, made, score = random.Random(5), [], p.toxicity.score
    bad, plain = [f"{c}{c}zorg" for c in "abdefghikl"], [f"{a}{b}" for a in "mnprst" for b in "aeiou"]
    texts = [" ".join([*rng.choices(plain, k=8), *(w for w in bad if rng.random() < (0.4 if k % 2 else 0.02))]) for k in range(8000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spark.createDataFrame([(k, k % 2) for k in range(8000)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(p.toxicity, "score", lambda docs, model, **kw: made.append(model) or score(docs, model, **kw))
    assert p.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
    [model], own = made, [k for k in range(8000) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert {f"={w}" for w in bad} <= set(model.votes.voters)
    x = np.zeros((len(own), len(model.votes)))
    for row, k in enumerate(own):
        for v, n in model.votes.counts(texts[k]).items():
            if v >= 0:
                x[row, v] = p.toxicity.feature(n)
    twice, known = np.vstack([x, x]), np.append([k % 2 for k in own], np.full(len(own), -1))
    posterior, share = p.toxicity.label_model(twice > 0, known, balance=np.mean([k % 2 for k in own]))
    seen = x.any(axis=0)
    w = (model.weights / np.sqrt(share))[seen]
    error = (1 / (1 + np.exp(-model.bias - twice[:, seen] @ model.weights[seen])) - posterior) / len(twice)
    slope = (twice * np.sqrt(share))[:, seen].T @ error + 1e-4 * w
    assert abs(error.sum()) < 1e-5 and np.abs(slope[w > 0]).max() < 1e-5 and slope.min() > -1e-5
