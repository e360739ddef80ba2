"""Trained operators: gradients, tries, held-out accuracy, brute-force scores, rates; and the pipeline."""

import collections
import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmart.llm import boosting, gru, language, lm, mixing, queries, toxicity
from textmart.llm.elias_fano import EliasFano, PairTrie, quantise

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
LONG = "word " * 20_000


def small_docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "doc_id long, text string, lang string, id long, label string, scores long")


# --- language ---

def test_gru_gradients_are_those_of_the_loss():
    weights = {k: v.astype(np.float64) for k, v in gru.start(3, 2, 1).items()}
    ids, label = np.array([[97, 98, 99, 32], [98, 98, 100, 97]]), np.array([0, 1])
    _, found = gru.gradients(weights, ids, label)
    rng = np.random.default_rng(0)
    for name in weights:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weights[name].shape)
            if name[0] == "x":
                at = (int(rng.choice([97, 98, 99])), at[1])
            eps = 1e-3
            weights[name][at] += eps
            up = gru.gradients(weights, ids, label)[0]
            weights[name][at] -= 2 * eps
            down = gru.gradients(weights, ids, label)[0]
            weights[name][at] += eps
            assert abs((up - down) / (2 * eps) - found[name][at]) < 2e-3, (name, at)


def test_language_of_small_texts(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["bana", "nabab", "abban"], "zz": ["xyzz", "zyxo", "ozzy"]}
    rows = [(i, " ".join(rng.choice(words[k], 8)), k) for i in range(60) for k in (("aa",) if i % 2 else ("zz",))]
    rows += [(100, None, "aa"), (101, "", "zz"), (102, "12 34 !!", "aa"), (103, "BANA " + LONG.replace("word", "nabab"), None),
             (None, "ozzy xyzz", None), (5, "ozzy", None), (5, "ozzy", None)]
    docs = small_docs(spark, rows)
    model = language.fit(docs, epochs=30)
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows)
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert by[100] == by[101] == by[102] == [("und", 0.0)]
    assert by[103][0][0] == "aa" and by[None][0][0] == "zz"
    assert sorted(x for x, _ in by[5])[-2:] == ["zz", "zz"]
    assert all(0 <= s <= 1 for v in by.values() for _, s in v)
    spans = language.label_positions("bana ozzy", model)
    assert spans[0][0] == 0 and spans[-1][1] == 9 and {s[2] for s in spans} == {"aa", "zz"}
    assert language.predict(docs.limit(0), model).count() == 0
    nothing = language.fit(docs.where("doc_id < 0"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_remembered_pieces_give_the_same_result(monkeypatch):
    model = language.Model(["a", "b"], gru.start(4, 2, 3))
    texts = [f"w{i} shared x{i * 7} 9 {'long' * 20}".encode() for i in range(50)]
    want = language._Pool(model).predict(texts)
    monkeypatch.setattr(language, "CACHE", 3)
    pool = language._Pool(model)
    got = [pool.predict([t])[0] for t in texts]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
    rows = model.positions([b"shared"])[0]
    pool = language._Pool(model)
    pool.learn({b"shared"})
    assert rows.shape == (6, 2) and np.allclose(rows.mean(axis=0), pool.table[pool.row[b"shared"]], atol=1e-5)


@needs_tables
def test_language_held_out_accuracy(spark):
    found = queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


# --- language model ---

@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (6, 3), (1000, 10 ** 6), (5000, 2 ** 64 - 1), (5000, 6000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    coded = EliasFano(*EliasFano.encode(values))
    assert (coded[np.arange(n)] == values).all()
    wanted = rng.integers(0, top, 300, dtype=np.uint64, endpoint=True)
    low = rng.integers(0, n + 1, 300)
    high = np.minimum(n, low + rng.integers(0, n + 1, 300))
    want = np.minimum(np.maximum(np.searchsorted(values, wanted), low), high)
    assert (coded.successor(wanted, low, high) == want).all()


def test_pair_trie():
    rng = np.random.default_rng(2)
    pairs = {(int(a), int(b)): float(s) for a, b, s in zip(rng.integers(0, 50, 900), rng.integers(0, 400, 900), rng.random(900))}
    keys = np.array(sorted(pairs), np.uint64)
    contexts = np.unique(np.append(keys[:, 0], np.uint64(77)))  # one context without followers
    owner = np.searchsorted(contexts, keys[:, 0])
    trie = PairTrie.build(contexts, np.arange(len(contexts)) * 1.0, owner, keys[:, 1], np.array([pairs[tuple(k)] for k in keys.tolist()]))
    a, b = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(80), np.arange(401)))
    known, weight, paired, score = trie.lookup(a, b)
    for i in range(len(a)):
        pair = (int(a[i]), int(b[i]))
        assert known[i] == (a[i] in contexts) and paired[i] == (pair in pairs)
        assert not paired[i] or abs(score[i] - pairs[pair]) < 0.01
        assert not known[i] or weight[i] == np.searchsorted(contexts, a[i])
    empty = PairTrie.build(contexts[:0], np.zeros(0), np.zeros(0, int), contexts[:0], np.zeros(0))
    assert not empty.lookup(a, b)[0].any()


def test_quantised_values_are_near():
    values = np.random.default_rng(1).normal(size=5000)
    book, code = quantise(values)
    assert len(book) <= 256 and np.abs(book[code] - values).max() < 0.06


def brute_lm(texts, train, discount=lm.DISCOUNT):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(t or "").translate(lower).encode().split() + [None] for t in texts]
    counts = collections.Counter(w for ws, t in zip(tokens, train) if t for w in ws)
    n, v = sum(counts.values()), len(counts)
    pairs = collections.Counter(p for ws, t in zip(tokens, train) if t for p in zip(["<s>", *ws], ws))
    seen, followers = collections.Counter(), collections.Counter()
    for (a, _), k in pairs.items():
        seen[a] += k
        followers[a] += 1
    total = n + 0.5 * (v + 1)
    out = []
    for ws in tokens:
        score = 0.0
        for a, b in zip(["<s>", *ws], ws):
            p1 = (counts[b] + 0.5) / total
            weight = min(1, discount * followers[a] / seen[a]) if seen[a] else 1
            if pairs[a, b]:
                p = (pairs[a, b] - discount) / seen[a] + weight * p1
            else:
                p = weight * p1
            score += math.log10(p)
        out.append((len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / total) for w in ws), score))
    return out


def lm_rows():
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(["the", "The", "of", *[f"w{k}" for k in range(60)]], rng.integers(1, 40)))) for i in range(120)] + [
        (200, None), (201, ""), (202, LONG), (501, "the of w1"), (501, "the of w1"), (None, "of the")]


@pytest.mark.parametrize("shard_bytes,parts", [(lm.SHARD_BYTES, 1), (4_000, 3)])
def test_lm_scores_are_those_of_brute_force(spark, shard_bytes, parts):
    rows = lm_rows()
    docs = small_docs(spark, [(i, t, None) for i, t in rows]).coalesce(parts)
    train = F.pmod("doc_id", F.lit(3)) != 1
    found = lm.score(docs, train, shard_bytes=shard_bytes).collect()
    assert len(found) == len(rows)
    want = collections.defaultdict(list)
    learned = [i is None or i % 3 != 1 for i, _ in rows]
    for (i, _), w in zip(rows, brute_lm([t for _, t in rows], learned)):
        want[i].append(w)
    for r in found:
        w = want[r["id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and abs(r["base_score"] - w[3]) < 1e-6 * abs(w[3]) + 1e-9
        assert abs(r["score"] - w[4]) < 0.02 * abs(w[4]) + 0.02
        assert r["train"] == (r["id"] is None or r["id"] % 3 != 1)


@pytest.mark.parametrize("frequent", [0, 16])
def test_lm_gives_every_seen_pair_its_back_off_share(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    # A context of many followers, each seen once and then again in a text that is held out.
    rows = [(3 * i, f"the r{i} the of r{i}") for i in range(200)] + [(3 * i + 1, f"the r{i}") for i in range(200)]
    found = {r["id"]: r for r in lm.score(small_docs(spark, [(i, t, None) for i, t in rows]).coalesce(3),
                                          F.pmod("doc_id", F.lit(3)) != 1, shard_bytes=2_000).collect()}
    assert len(found) == len(rows)
    for (i, _), w in zip(rows, brute_lm([t for _, t in rows], [i % 3 != 1 for i, _ in rows])):
        assert found[i]["n_known"] == w[1] and abs(found[i]["score"] - w[4]) < 0.02 * abs(w[4]) + 0.02


def test_lm_counts_the_followers_of_split_contexts(spark):
    # "v" is split into many parts, of which one alone holds a training pair.
    rows = [(3 * i, "v a " * 50) for i in range(30)] + [(3 * i + 1, f"v b{i} v a v c{i}") for i in range(30)]
    found = {r["id"]: r["score"] for r in lm.score(small_docs(spark, [(i, t, None) for i, t in rows]).coalesce(3),
                                                   F.pmod("doc_id", F.lit(3)) != 1, shard_bytes=800).collect()}
    for (i, _), w in zip(rows, brute_lm([t for _, t in rows], [i % 3 != 1 for i, _ in rows])):
        assert abs(found[i] - w[4]) < 0.02 * abs(w[4]) + 0.02


def test_lm_is_as_near_when_contexts_are_split(spark):
    rows = lm_rows()
    found = lm.score(small_docs(spark, [(i, t, None) for i, t in rows]).coalesce(3), F.pmod("doc_id", F.lit(3)) != 1,
                     shard_bytes=4_000).collect()
    want = collections.defaultdict(list)
    for (i, _), w in zip(rows, brute_lm([t for _, t in rows], [i is None or i % 3 != 1 for i, _ in rows])):
        want[i].append(w[4])
    for r in found:
        assert abs(r["score"] - want[r["id"]][0]) < 0.02 * abs(want[r["id"]][0]) + 0.02


def test_lm_of_nothing(spark):
    docs = small_docs(spark, [(1, "a b", None)])
    row = lm.score(docs, F.lit(False)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert abs(row["base_score"] - 3 * math.log10(0.5 / 0.5)) < 1e-9 and abs(row["score"] - row["base_score"]) < 1e-9
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


# --- toxicity ---

def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x, y, np.ones(2000))
    raw = trees.raw(x)
    assert ((raw > 0) == y).mean() > 0.97
    knots, p = boosting.isotonic(raw, y, np.ones(2000))
    assert (np.diff(p) > 0).all() and (np.diff(knots) > 0).all() and 0 <= p[0] and p[-1] <= 1
    s, q = boosting.isotonic(np.array([1.0, 2, 3, 3]), np.array([1.0, 0, 0, 1]), np.ones(4))
    assert np.allclose(q, [1 / 3, 1.0]) or len(q) <= 2


def toxic_rows():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(240):
        words = list(rng.choice([f"plain{k}" for k in range(80)], 30))
        if i % 3 == 0:
            words[int(rng.integers(30))] = str(rng.choice(["vilething", "nastyword"]))
            words[3] = "you"
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_on_small_texts(spark):
    rows, labels = toxic_rows()
    rows += [(900, None, None), (901, "", None), (None, "plain1 nastyword you", None), (902, "plain1 V1leth!ng plain4 you", None), (903, LONG, None)]
    docs = small_docs(spark, rows)
    table = spark.createDataFrame([*labels, (0, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    assert {"vilething", "nastyword"} <= model.strong | model.medium
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.5) == bool(t) for i, t in labels]) > 0.97
    assert scores[900] == scores[901] < 0.5 and scores[903] < 0.5 <= scores[None]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in scores.values())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = small_docs(spark, [(1, "a", None), (2, None, None)])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).trees is None


def test_disguised_words():
    words = toxicity._Words({"vile"}, set())
    assert words["v1le!"] & toxicity.HIDDEN and words["vile"] & toxicity.STRONG and not words["v1la"] & toxicity.HIDDEN
    assert words["You,"] & toxicity.PERSON and words["SHOUT!"] & toxicity.CAPITALS


@needs_tables
def test_toxicity_held_out(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, SF).join(truth, "doc_id").where("held_out").collect()
    pairs = [(a["score"], b["score"]) for a in rows if a["toxic"] for b in rows if not b["toxic"]]
    assert np.mean([(a > b) + (a == b) / 2 for a, b in pairs]) > 0.9


# --- mixing ---

def mixed(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("WORD!!" if i % 4 == 0 else "word" for _ in range(int(rng.integers(5, 60)))), None) for i in range(200)]
    rows += [(300, None, None), (301, "", None), (None, "word word", None), (302, LONG, None), (302, LONG, None)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200, 3)] + [(None, 1), (1, None)], "doc_id long, quality int")
    return rows, small_docs(spark, rows), labels


@pytest.mark.parametrize("targets", [{"1": 0.5, "0": 0.5}, {"1": 1.0}, {"1": 0.999, "0": 0.001, "nobody": 3.0}])
def test_mixing_meets_targets_like_plain_projected_gradient(spark, targets):
    rows, docs, labels = mixed(spark)
    mixture = mixing.fit(docs, labels, targets)
    assert mixture.classifier.domains == ["0", "1"]
    rated = mixing.mix(docs, mixture, posteriors_col="p")
    assert rated.columns == [*docs.columns, "p", "rate"] and rated.count() == len(rows)
    found = rated.select("doc_id", mixing.tokens(F.col("text")).alias("n"), "p", "rate").collect()
    p, n, r = (np.array([x[c] for x in found], float) for c in ("p", "n", "rate"))
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    goal = np.array([targets.get("0", 0), targets.get("1", 0)])
    goal = goal / goal.sum() * n.sum()
    plain, inverse = np.ones(len(n)), np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(mixing.STEPS):
        plain = np.maximum(0, plain - p @ (inverse @ ((p * n[:, None]).T @ plain - goal)))
    assert np.allclose(r, plain, atol=1e-3)
    loss = lambda rate: np.abs((p * n[:, None]).T @ rate - goal).max() / n.sum()
    assert loss(r) <= loss(plain) + 1e-6 and loss(r) < 0.05


def test_mixing_meets_targets_that_need_rates_of_zero(spark):
    # Three kinds of texts: of domain 0, of either one, of domain 1. Without the limit at 0 the first kind's rate is negative.
    docs = small_docs(spark, [(i, ["WORD!! " * 9, "WORD!! word " * 5, "word " * 10][i % 3], None) for i in range(120)])
    labels = spark.createDataFrame([(i, i // 3 % 2 if i % 3 == 1 else i % 3 // 2) for i in range(120)], "doc_id long, quality int")
    mixture = mixing.fit(docs, labels, {"1": 0.95, "0": 0.05})
    found = mixing.mix(docs, mixture, posteriors_col="p").select(mixing.tokens(F.col("text")).alias("n"), "p", "rate").collect()
    p, n, r = (np.array([x[c] for x in found], float) for c in ("p", "n", "rate"))
    assert (r[n > 0] == 0).any() and len(mixture.steps) < mixing.STEPS and mixture.missed <= mixing.CLOSE
    assert np.allclose((p * n[:, None]).T @ r / n.sum(), [0.05, 0.95], atol=1e-8)


def test_mixing_tells_of_targets_out_of_reach(spark):
    docs = small_docs(spark, [(i, "word word", None) for i in range(40)])  # all alike: no rates can tell them apart
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="missed by"):
        mixture = mixing.fit(docs, labels, {"1": 1.0})
    assert abs(mixture.missed - 0.5) < 1e-6 and len(mixture.steps) < mixing.STEPS
    with pytest.warns(UserWarning, match="after 0 steps"):
        assert mixing.fit(docs, labels, {"1": 1.0}, steps=0).totals == [40.0, 40.0]


def test_mixing_without_labels_or_rows(spark):
    rows, docs, labels = mixed(spark)
    mixture = mixing.fit(docs, labels.limit(0))
    assert {x["rate"] for x in mixing.mix(docs, mixture).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), mixing.fit(docs.limit(0), labels)).count() == 0


# --- the whole ---

@needs_tables
def test_pipeline_stages_are_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == [*docs.columns, "rate"]
    kept = {r["doc_id"]: r for r in result.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert 600 < len(kept) < docs.count()
    assert sum(labels[i]["toxic"] for i in kept if i in labels) <= 10
    assert len({r["text"] for r in kept.values()}) == len(kept)
    assert all(r["n_chars"] == len(r["text"]) and r["rate"] >= 0 for r in kept.values())
    assert all(k in [n for n, _ in corpus_pipeline.STAGES] for k in ("toxicity", "line_dedup", "mixing"))


@needs_tables
def test_queries_are_named_by_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
