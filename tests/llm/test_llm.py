"""The training-data operators against brute force, on odd rows, and on empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import ann, bpe, components, decontam, langid, linededup, minhash, pii, quality, queries, toxicity, urlfilter
from tests.oracle import SF, connect, rows_of_spark, rows_of_sql

SCHEMA = "doc_id bigint, text string, id string, key int, mark string, score double, kept string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ODD = ["", None, " \n\t", "one", "Same text here\nnow", "same  TEXT here\nnow", "é🙂 ß İ Σ", "x" * 20_000, LONG, LONG, "a\n" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "x", 1, "m", 0.5, "k") for k, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None, None), (3, "one", "x", 1, "m", 0.5, "k")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(), queries.ORACLE_SQL[name])


# --- MinHash -------------------------------------------------------------------------------------------------------------


def brute_components(texts: dict, size: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts(seed: int, n: int) -> dict:
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 120))] for _ in range(12)]
    out = {}
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(4000)}"
        out[i] = " ".join(words)
    return out | {n: "", n + 1: None, n + 2: " "}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    texts = near_texts(size, 300)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_in_chunks_lose_no_link(spark, monkeypatch):
    """Groups cut at 16 rows, hubs from 5 neighbours on, and broadcasts: with each way beyond them."""
    from strata.llm import common

    texts = near_texts(9, 200) | {1000 + k: "one and the same text of a large class" for k in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = {i: c for i, (_, c) in brute_components(texts, 3, 85).items()}
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(components, "HOT_ROWS", 5)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()} == want
    monkeypatch.setattr(minhash, "MAX_LISTED", 0)
    monkeypatch.setattr(minhash, "MAX_SHIPPED", 0)
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()} == want


def test_near_duplicates_of_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].kept and by[1].kept and by[2].kept and by[0].n_shingles == 0
    assert by[5].component_id == 4 and not by[5].kept and by[9].component_id == 8
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(empty).collect() == []


def test_visit_finds_chains():
    edges = minhash.visit(5, lambda p, rest: np.abs(rest - p) == 1)
    assert len(edges) == 4


def test_components_of_a_long_chain(spark):
    e = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(100, 101), (7, 7)], "a bigint, b bigint"))
    got = {r.id: r.component for r in components.components(e).collect()}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 101: 100}


# --- line dedup ----------------------------------------------------------------------------------------------------------


def brute_lines(texts: list, least: int, keep: str) -> list:
    keys = [[x.strip(b" \t\n\x0b\x0c\r") for x in (t or "").encode().lower().split(b"\n")] for t in texts]
    seen, first = {}, {}
    for i, own in enumerate(keys):
        for k in set(own) - {b""}:
            seen[k] = seen.get(k, 0) + 1
        for j, k in enumerate(own):
            first.setdefault(k, (i, j))
    out = []
    for i, own in enumerate(keys):
        gone = {j for j, k in enumerate(own) if k and seen[k] >= least and (keep == "none" or first[k] != (i, j))}
        out.append("\n".join(x for j, x in enumerate((texts[i] or "").split("\n")) if j not in gone))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("shipped", [200_000, 0])
def test_line_dedup_equals_brute_force(spark, keep, shipped):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["  Foo ", "foo", "bar\t", "", "only %d" % i, "É", "x %d" % rng.randrange(30)]) for _ in range(rng.randrange(1, 9))) for i in range(80)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df, 5, keep, max_shipped_keys=shipped).collect()}
    assert [got[i].kept for i in range(len(texts))] == brute_lines(texts, 5, keep)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got.values())


def test_a_full_filter_changes_no_result(documents):
    a = linededup.dedup_lines(documents, 3, max_filter_bytes=512).select("doc_id", "kept_sha256")
    assert rows_of_spark(a) == rows_of_spark(linededup.dedup_lines(documents, 3).select("doc_id", "kept_sha256"))


def test_line_dedup_of_odd_rows(odd, empty):
    got = linededup.dedup_lines(odd, 2).collect()
    assert len(got) == len(ODD) + 2 and {r.n_lines for r in got if r.doc_id in (0, 1)} == {1}
    assert linededup.dedup_lines(empty, 2).collect() == []


# --- decontamination -----------------------------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda s: " ".join(re.findall(r"\w+", (s or "").lower()))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    true = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if len(t.split()) >= 5 and t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(documents, bench).collect()} == true


def test_paraphrases_and_odd_rows(spark, odd):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion near old mills"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id bigint, text string")
    words = item.split()
    words[3], words[9] = "hound", "as"
    rows = [(100, "Intro words. " + " ".join(words).upper() + "! And more."), (101, "nothing of it"), (102, " ".join(sorted(item.split())))]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    docs = docs.union(spark.createDataFrame([(103, "first line\nToo SHORT!\nlast"), (104, "this is too short for that"), (105, " too\tshort ")], "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()) == [(100, 1), (103, 3), (105, 3)]
    assert decontam.leaks(docs, bench.limit(0)).collect() == [] and decontam.leaks(docs.limit(0), bench).collect() == []


def test_candidates_are_those_of_the_cosine(spark, documents):
    """Every passage and item that the cosine and the cover let pass, also where an item's rarest words are replaced."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = decontam.build_index(documents, [tuple(r) for r in bench.orderBy("item_id").collect()], "text")
    rows = [(k, r.text) for k, r in enumerate(documents.orderBy("doc_id").limit(60).collect())]
    for k, (_, words) in enumerate(index.words):
        rare = sorted(set(words), key=lambda w: (-index.idf[index.place[w]], w))
        for share in (0.2, 0.3, 0.38):
            gone, left = set(), int(share * len(words))
            for w in rare:
                if words.count(w) <= left:
                    left -= words.count(w)
                    gone.add(w)
            host = decontam.words_of(rows[k % 60][1])
            rows.append((len(rows), b" ".join([*host[:150], *(b"zzz" if w in gone else w for w in words), *host[150:300]]).decode()))
    true = set()
    for d, text in rows:
        codes = index.codes_of(text)
        for at in decontam.passages(codes).tolist():
            place, value = decontam.tfidf(codes[at : at + decontam.WINDOW], index.idf)
            v = value @ index.basis[place]
            for k in np.flatnonzero(index.latent @ v / max(1e-9, np.linalg.norm(v)) >= decontam.COSINE):
                own = index.codes[k].tolist()
                both, answer = decontam.common(own, codes[max(0, at - len(own)) : at + decontam.WINDOW + len(own)].tolist())
                cover, last = both / len(own), answer / min(decontam.ANSWER_WORDS, len(own))
                if cover >= decontam.FULL_COVER or cover >= decontam.COVER and last >= decontam.ANSWER_COVER:
                    true.add((d, index.words[k][0]))
    searcher = decontam.Searcher(index)
    assert {(d, leak[0]) for d, text in rows for leak in searcher.leaks(text)} == true
    assert len({d for d, _ in true if d >= 60}) >= 60


def test_latent_space_is_of_all_passages(spark):
    """Of 104 words the range is whole, so the basis is that of the 96 greatest singular values over every passage."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(104)]
    items = [(k, " ".join(words[k * 26 : k * 26 + 26])) for k in range(4)]
    texts = [" ".join(rng.choices([*words, *words[:20], "other"], k=rng.randrange(1, 90))) for _ in range(2000)]
    texts += [" ".join(["other"] * 30 + rng.choices(words[-2:], k=1) * 3 + ["other"] * 3000 + words[50:54]) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    index = decontam.build_index(docs, items, "text")
    rows = []
    for codes in [*map(index.codes_of, texts), *index.codes]:
        for at in decontam.passages(codes).tolist():
            place, value = decontam.tfidf(codes[at : at + decontam.WINDOW], index.idf)
            rows.append(np.zeros(104))
            rows[-1][place] = value
    exact = np.array(rows).T @ np.array(rows)
    assert np.isclose(np.trace(index.basis.T @ exact @ index.basis), np.linalg.eigvalsh(exact)[-decontam.RANK :].sum(), rtol=1e-9)
    assert decontam.build_index(docs.where("doc_id = 0"), [(1, texts[0])], "text").latent.shape == (1, min(96, len(set(texts[0].split()))))


def test_copies_cut_at_either_end(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion near old mills beside this quiet river"
    w = item.split()
    cuts = {1: w[:-4], 2: w[:-6], 3: w[4:], 4: w[6:], 5: w[:-7], 6: w[:-9], 7: w[9:], 8: w[:-11], 9: w[11:]}
    docs = spark.createDataFrame([(k, "Some words ahead: " + " ".join(c) + ". Others follow!") for k, c in cuts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    # 23 words: without 9 of them the cover is 0.61, which takes the answer; without 11 it is too little for any.
    assert len(w) == 23 and {r.doc_id for r in decontam.leaks(docs, bench).collect()} == {1, 2, 3, 4, 5, 7}


def test_texts_of_one_item_and_items_without_id(spark):
    one, two, three = ("red apples grow on the old tree behind our house", "blue rivers run past many quiet towns in spring", "seven green birds sing above that long stone wall")
    bench = spark.createDataFrame([(1, one), (1, two), (None, three)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, one), (2, two), (3, three), (4, one + ". " + two)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()) == [(1, 1), (2, 1), (3, None), (4, 1)]


def test_common_subsequence():
    rng = random.Random(1)

    def slow(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
            p = q
        return p[-1]

    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert decontam.common(a, b) == (slow(a, b), slow(a[-decontam.ANSWER_WORDS :], b))


# --- URL filter ----------------------------------------------------------------------------------------------------------


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://A.NET/x", "http://net", "http://net/", "http://notnet/", "https://example.net/en/1", "https://sub.example.com/de/?q#f", "http://x.org/fr/a", "http://x.org/FR/a", "ftp://example.com?/de/", "http://a.net/b://c", "http://é.net/"]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id int, url string, rule string").drop("rule").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([*queries.URL_RULES, ("NET/", "block"), (None, "block")], "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("net", "", None, "allow") and got[5][2] == "net/" and got[6][2] is None
    assert got[7][2:] == ("example.net/en/", "allow") and got[8] == ("sub.example.com", "/de/", "example.com/de/", "block")
    assert got[9][2] == "org/fr/" and got[10][2] is None and got[11] == ("example.com", "", None, "allow") and got[12][2] == "net/" and got[13][2] == "net/"
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0), rules).collect() == []


# --- classifiers ---------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, documents):
    got = langid_accuracy(spark, documents)
    assert got >= 0.97


def langid_accuracy(spark, documents):
    r = queries.op8_language_id(spark, SF).join(documents, "doc_id").where("held_out and lang is not null")
    return r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]


def test_language_cases(spark, odd, empty):
    train = spark.createDataFrame([(1, "the house and the dog", "en"), (2, "das haus und der hund", "de"), (3, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.train(train)
    got = {r.doc_id: r for r in langid.identify(odd.where("doc_id is not null"), model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[3].lang_pred in ("de", "en")
    asked = spark.createDataFrame([(1, "the housing"), (2, "hunde und"), (3, "12 !?")], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.identify(asked, model).orderBy("doc_id").collect()] == ["en", "de", "und"]
    assert {r.lang_pred for r in langid.identify(odd, langid.train(train.limit(0))).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


def test_toxicity_learns_words_that_no_lexicon_has(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdegilnorstu") for _ in range(rng.randrange(3, 8)))
    rows = [(k, " ".join([*(word() for _ in range(30)), *(["zorgblat"] * (k % 3 == 0 and rng.randrange(1, 3)))]), int(k % 3 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 300"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.where("doc_id >= 300"), model, keep=("toxic",)).collect()
    assert all(r.predicted == r.toxic for r in got)


def test_toxicity_cases(spark, odd, empty):
    labels = spark.createDataFrame([(0, None), (3, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels.limit(0))
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].predicted == 0 and got[0].score == got[1].score
    bad = spark.createDataFrame([(1, "You are an IDIOT")], "doc_id bigint, text string")
    assert toxicity.score(bad, model).first().predicted == 1
    assert len(toxicity.score(odd, toxicity.train(odd, labels)).collect()) == len(ODD) + 2
    assert toxicity.score(empty, model).collect() == []


def test_toxicity_of_all_documents_cases(spark, odd, empty, monkeypatch):
    labels = spark.createDataFrame([(0, None), (3, 0)], "doc_id bigint, toxic int")
    bad = spark.createDataFrame([(1, "You are an IDIOT")], "doc_id bigint, text string")
    for model in (toxicity.train_on_all(odd, labels), toxicity.train_on_all(odd, labels.limit(0)), toxicity.train_on_all(empty, labels)):
        got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
        assert all(0 <= r.score <= 1 for r in got.values()) and got[0].predicted == 0 and toxicity.score(bad, model).first().predicted == 1
    rng = random.Random(2)
    rows = [(k if k % 50 else None, " ".join([*rng.choices("abe dil nor stu gla".split(), k=9), *(["zorgblat"] * (k % 3 == 0))])) for k in range(300)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 300)] + [(1, None), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    shipped = toxicity.train_on_all(df, labels)
    assert shipped.score("abe zorgblat") > 0.9 and shipped.score("abe dil") < 0.1
    monkeypatch.setattr(toxicity, "MAX_SHIPPED", 0)  # the texts go to the labels
    shuffled = toxicity.train_on_all(df, labels)
    assert shuffled.votes.voters == shipped.votes.voters and np.allclose(shuffled.weights, shipped.weights, atol=1e-6) and np.isclose(shuffled.bias, shipped.bias, atol=1e-6)


def test_label_model_shares_votes_of_tied_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    one, other = (rng.random(4000) < np.where(y, 0.6, 0.02) for _ in range(2))
    _, share = toxicity.label_model(np.stack([one, one, other], axis=1), np.full(4000, -1))
    assert np.allclose(share, [0.5, 0.5, 1.0], atol=0.02)


def test_label_model_recovers_hidden_labels_better_than_a_majority():
    """Nine voters repeat one poor vote, five are good and independent; a few labels anchor the rates."""
    rng = np.random.default_rng(2)
    n = 6000
    y = rng.random(n) < 0.25
    poor = rng.random(n) < np.where(y, 0.55, 0.3)
    copies = [poor ^ (rng.random(n) < 0.01) for _ in range(9)]
    good = [rng.random(n) < np.where(y, 0.6, 0.03) for _ in range(5)]
    fired = np.stack([*copies, *good], axis=1)
    known = np.where(np.arange(n) < 300, y.astype(int), -1)
    post, share = toxicity.label_model(fired, known, balance=0.25)
    hidden = known < 0
    of_model = ((post > 0.5) == y)[hidden].mean()
    of_majority = max(((fired.sum(axis=1) >= k) == y)[hidden].mean() for k in range(1, 15))
    assert of_model > of_majority and of_model > 0.93, (of_model, of_majority)
    assert share[:9].max() < 0.2 < share[9:].min()
    # A label is no part of a row's own posterior: rows with equal votes have equal posteriors.
    _, group = np.unique(fired, axis=0, return_inverse=True)
    assert all(np.ptp(post[group == g]) < 1e-9 for g in np.unique(group)[:200])


def test_each_pattern_votes_alone(spark, odd):
    votes = toxicity.Votes([])
    for k, text in ((0, "so You're an idiot!"), (1, "what SCUM"), (2, "oh kill  yourself now"), (2, "Go\ndie"), (2, "shut up"), (2, "and DROP dead")):
        assert votes.counts(text).get(k), text
    assert set(votes.counts("die Frau go to the shop; he is dead, drop it")) == {-1}
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert model.score("why don't you go die") > model.score("why don't you go home")


def test_toxicity_on_held_out_documents(spark):
    """Over all documents: the score is that of the plain sum over voters, and held-out labels are told."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = docs.withColumn("held_out", queries.bucket_of("doc_id", 4) == 2)
    model = toxicity.train(kept.where("not held_out"), spark.read.parquet(f"{d}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op9_toxicity(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())
        if re.search(r"[\u0300-\u036f]", texts[r.doc_id] or ""):
            continue
        z = model.bias
        for v, name in enumerate(model.votes.voters):
            n = sum(w == name[1:] if name[0] == "=" else len(name) in toxicity.BEGINNINGS and w.startswith(name) for w in words) if model.weights[v] else 0
            z += model.weights[v] * (1 + np.log(n)) if n else 0.0
        for k, p in enumerate(toxicity.PATTERNS):
            n = len(re.findall(p, texts[r.doc_id] or ""))
            z += model.weights[len(model.votes.voters) + k] * (1 + np.log(n)) if n else 0.0
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    # About 30 toxic rows teach four languages' words here; 0.95 is measured (1.0 on 5,099 rows of a set 50 times as large).
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.9 * len(held)


def test_kept_columns_with_an_outputs_name_are_refused(spark, odd):
    model = toxicity.Model(toxicity.Votes([]), np.zeros(3), 0.0)
    for make in (lambda: toxicity.score(odd, model, keep=("score",)), lambda: quality.score(odd, quality.Model([], [], 0.0), keep=("score",)), lambda: langid.identify(odd, langid.Model([], {}), keep=("score",)), lambda: linededup.dedup_lines(odd, carry=("kept",))):
        with pytest.raises(ValueError, match="output's name"):
            make()


def test_quality_on_held_out_documents(spark):
    r = queries.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert r.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.8


def test_quality_cases(odd, empty, spark):
    labels = spark.createDataFrame([(3, 1), (7, 0), (4, None)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score(odd, quality.train(odd, known)).collect()
        assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, quality.Model([], [], 0.0)).collect() == []


def test_rules_mean_the_same_in_spark(spark, documents):
    rng = np.random.default_rng(0)
    rows = quality.with_statistics(documents.limit(150), ["doc_id"], "text").toPandas()
    x = rows[[f"__{n}" for n in quality.NAMES]].to_numpy()
    model = quality.train_on(x, (x[:, 6] > np.median(x[:, 6])).astype(int) ^ (rng.random(len(x)) < 0.02))
    z = model.bias + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    df = spark.createDataFrame(rows)
    got = np.array([r[0] for r in df.select(model.column().alias("s")).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


# --- nearest neighbours --------------------------------------------------------------------------------------------------


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.op6_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        own = got[ids[i]]
        assert sorted(own) == list(range(1, 21))
        hits += len({ids[k] for k in best} & {v for v, _ in own.values()})
        total += 20
        assert all(abs(score - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, score in own.values())
    assert hits / total >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0])]
    rows += [(k, [2.0, 0.0]) for k in range(50, 10, -1)] + [(60, [1.0, 1.0]), (60, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("id") == 0, 5).orderBy("rank").collect()]
    assert got == [(k + 1, 11 + k, 2.0) for k in range(5)]
    few = ann.nearest(df.where("vec_id in (0, 60)"), F.col("id") % 20 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few) == [(0, 1, 60, 1.0), (60, 1, 0, 1.0)]
    assert ann.nearest(df.limit(0), F.col("id") == 0).collect() == []


def test_leaves_in_chunks_give_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = rows_of_spark(ann.nearest(df, F.col("id") % 20 == 0, 5))
    monkeypatch.setattr(ann, "CHUNK", 7)
    assert rows_of_spark(ann.nearest(df, F.col("id") % 20 == 0, 5)) == one


def test_a_block_with_an_empty_side_has_no_best():
    some, none = np.ones((2, 3)), np.zeros((0, 3))
    ids, bits, no = np.array([1, 2]), np.array([1, 1]), np.zeros(0, np.int64)
    assert ann.best_of(ids, some, bits, no, none, no, 5).shape == (3, 0) == ann.best_of(no, none, no, ids, some, bits, 5).shape
    assert ann.best_of(ids, some, np.array([2, 2]), ids + 5, some, bits, 5).shape == (3, 0)


def test_queue_and_sorting_open_the_same_leaves():
    x = np.random.default_rng(3).normal(size=(3000, 16))
    f = ann.Forest(x, 3, 7)
    for budget in (0.01, 0.3, 1.1, 9.0):
        got = f.opened(x[:20], budget)
        assert [sorted(f.search(q, budget)) for q in x[:20]] == [sorted(g.tolist()) for g in got]
        for leaves in got:
            unit, bits = f.masks(leaves)
            back = [u << f.unit | b for u, m in zip(unit.tolist(), bits.view(np.uint64).tolist(), strict=True) for b in range(64) if m >> b & 1]
            assert back == sorted(leaves.tolist())


def forest_recall(x: np.ndarray, k: int = 20) -> tuple[float, float]:
    """Recall against brute force, and the share of distinct rows opened, for a twentieth of the rows."""
    fit = np.random.default_rng(1).permutation(x)[: ann.SAMPLE]
    f = ann.Forest(fit, ann.TREES, ann.depth_for(len(x), len(fit)))
    budget = ann.measured_budget(fit, len(x), k, ann.TREES) / len(x)
    own = np.stack([t * f.leaves + f.leaf(x, t) for t in range(ann.TREES)], axis=1)
    at = np.arange(0, len(x), 20)[:150]
    hits = seen = 0
    for q, leaves in zip(at, f.opened(x[at], budget), strict=True):
        s = x @ x[q]
        s[q] = -np.inf
        inside = np.isin(own, leaves).any(axis=1)
        hits += inside[np.argsort(-s)[:k]].sum()
        seen += inside.mean()
    return hits / len(at) / k, seen / len(at)


def test_recall_holds_and_the_opened_share_falls_as_tables_grow():
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for make, falls in ((lambda n: unit(rng.normal(size=(n, 64))), 0.97), (lambda n: unit(rng.normal(size=(60, 64))[rng.integers(60, size=n)] + 0.35 * rng.normal(size=(n, 64))), 0.8)):
        small, large = forest_recall(make(2000)), forest_recall(make(30_000))
        assert small[0] >= 0.9 and large[0] >= 0.9, (small, large)
        assert large[1] < falls * small[1], (small, large)


# --- BPE -----------------------------------------------------------------------------------------------------------------


def test_codec_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, codec = Tokenizer.from_file(path), bpe.Codec(bpe.Vocabulary.load(path))
    rng = random.Random(0)
    letters = "abcABC 'sS’tré́ÉΣσςİßñ\n\t\x1c\x85 123½漢字🙂</w>&#$_​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|startoftext|>", "a" * 5000, "ab" * 3000, "don't I'LL", "", " "]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids == want.ids, text
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_encode_rows(spark, odd, empty):
    got = bpe.encode(odd, queries.tokenizer_path(), keep_decoded=True).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ODD) + 2 and all(r.n_tokens == len(r.ids) for r in got)
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (0, 1, 2)} == {(0, none, none)}
    assert bpe.encode(empty, queries.tokenizer_path()).collect() == []


# --- personal data -------------------------------------------------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> str:
    out = []
    for rank, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(out))


def test_base_spans_equal_brute_force(spark, documents, odd, empty):
    rng = random.Random(6)
    parts = ["a@b.c", "_d@e.f-g", "1.2.3.4", "256.1.1.1", "0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (203) 555-8282", "+44 20", "é🙂", " ", ".", "-", "9", "\n", "@", "me (at) site (dot) com", "203-555-8282"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["1 " * 3000, "a" * 5000 + "@b.c"]
    df = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    df = df.union(documents.select("doc_id", "text")).union(odd.where("doc_id is not null").select(F.col("doc_id") + 90_000, "text"))
    model = pii.train(spark)
    known = {r.doc_id: r.text or "" for r in df.collect()}
    for r in pii.summary(pii.detect(df, model)).collect():
        want = brute_spans(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), known[r.doc_id][:200]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert r.n_email == want.count("email:")
    assert pii.detect(empty, model).collect() == []


def test_added_spans(spark):
    model = pii.train(spark)
    texts = ["write me: jane.doe (at) example (dot) com today", "call (203) 555-8282 now", "on 2024-01-02 at 12:30:45", "order 1234.5678.9012", "about 12.50 at the.end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in pii.detect(df, model).collect()}
    assert got == {0: ["jane.doe (at) example (dot) com"], 1: ["(203) 555-8282"], 2: [], 3: [], 4: []}


def test_added_spans_precision_recall_and_calibration(spark):
    """On lines of another seed: what is added, against the lines' labels; and each probability against the share it promises."""
    model = pii.train(spark)
    x, y, _ = pii.scored_lines(spark, pii.examples(77, 2400))
    score = pii.probability(model.steps, pii.margins(x, model.trees, model.bias))
    for k, kind in enumerate(pii.KINDS):
        own = x[:, 0] == k
        added = score[own] >= model.thresholds[kind]
        assert y[own][added].mean() >= 0.85, kind
        assert added[y[own] == 1].mean() >= (0.25 if kind == "phone" else 0.7), kind
    for low in np.arange(0, 1, 0.2):
        some = (score >= low) & (score < low + 0.2)
        assert some.sum() < 30 or abs(score[some].mean() - y[some].mean()) < 0.12
    assert len(set(model.thresholds.values())) > 1


def test_many_spans_take_linear_time(spark):
    import time

    model = pii.train(spark)

    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"203-555-{k % 9000 + 1000} a{k}@b.cc" for k in range(n)))], "doc_id bigint, text string")
        began = time.time()
        assert pii.detect(df, model).select(F.size("base")).first()[0] == n
        return time.time() - began

    took(100)
    small, large = took(2000), took(16_000)
    assert large < 4 * small + 5, (small, large)


def test_overlapping_spans_are_taken_by_score(spark):
    """Against a plain greedy choice, on chains of spans that interlock, in texts longer than a block."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        spans, at = [], 0
        for _ in range(rng.randrange(0, 150)):
            at += rng.randrange(0, 6)
            spans.append((at, at + rng.randrange(1, 9), rng.random() < 0.2))
        rows.append((k, spans))
    df = spark.createDataFrame(rows, "k int, all array<struct<start:int,end:int,base:boolean>>")
    got = {r.k: [[tuple(s) for s in run] for run in r.runs] for r in df.select("k", pii.runs(F.array_sort("all")).alias("runs")).collect()}
    for k, spans in rows:
        want, end = [], -1
        for s in sorted(spans):
            if s[0] < end:
                want[-1].append(s)
            else:
                want.append([s])
            end = max(end, s[1])
        assert [r for r in got[k] if r] == want
