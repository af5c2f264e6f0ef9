"""Line dedup, Jaccard join, mixing, the classifiers and the pipeline against plain Python or held-out rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from taskloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, quality_mil, quality_rules, sharding

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def passages(docs, least=line_dedup.MIN_WORDS):
    """[(doc_id, text)] -> {(doc_id, start, stop, n_words, kept, kept_doc_id, kept_start, passage_start)}"""
    key = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    rows = {(doc, key(text)): text for doc, text in docs if doc is not None and text is not None}
    units, seen = defaultdict(list), defaultdict(set)
    for row, text in rows.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for m in re.finditer(r"[^.!?\n]*[.!?\n][\x00-\x2F\x3A-\x60\x7B-\x7F]*|[^.!?\n]+", low):
            if w := tuple(brute.words(m[0])):
                units[row].append((m.start(), m.end(), w))
                seen[w].add((*row, m.start()))
    out = set()
    for row, all_ in units.items():
        for again, run in itertools.groupby(all_, key=lambda u: len(seen[u[2]]) > 1):
            run = list(run)
            if again and sum(len(w) for _, _, w in run) >= least:
                for a, b, w in run:
                    first = min(seen[w])
                    out.add((row[0], a, b, len(w), first == (*row, a), first[0], first[2], run[0][0]))
    return out


COLUMNS = ["doc_id", "start", "stop", "n_words", "kept", "kept_doc_id", "kept_start", "passage_start"]


def jaccard_links(docs):
    """[(doc_id, text)] -> ({doc_id: number of linked documents}, {doc_id: class})"""
    sets = {}
    for doc, text in docs:
        w = brute.words(text)
        if w:
            sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    links, parent = Counter(), {doc: doc for doc, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return links, {doc: root(doc) for doc in parent}


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta omega river stone cloud seven table green horse paper light".split()) + str(rng.randrange(40)) for _ in range(n)]


LINE_CASES = {
    "nulls and blanks": [(1, None), (2, ""), (3, "\n\n"), (None, "a b c d e f"), (4, "a b c d e f")],
    "ties and repeated rows": [(5, "A b, c d e\nx\na B c d e\n"), (5, "A b, c d e\nx\na B c d e\n"), (6, "x y\n a b c d e ")],
    "code points": [(7, "😀 é one two three four five\nshort line"), (8, "head\n😀 É one two three four five\n😀 é one two three four five")],
}


@pytest.mark.parametrize("case", sorted(LINE_CASES))
def test_line_dedup_cases(spark, case):
    docs = LINE_CASES[case]
    got = [tuple(r) for r in line_dedup.occurrences(spark.createDataFrame(docs, "doc_id long, text string"), 5).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == passages(docs, 5)


def test_line_dedup_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = [tuple(r) for r in line_dedup.op6_line_dedup(spark, sf_dir).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == passages([tuple(r) for r in docs.collect()])


def test_line_dedup_finds_passages_in_lines_and_over_lines(spark):
    rng = random.Random(3)
    sentence = lambda n: " ".join(prose(rng, n)).capitalize() + "."
    passage = [sentence(18) for _ in range(3)]
    docs = [
        (1, sentence(9) + " " + " ".join(passage) + " " + sentence(7)), (2, sentence(5) + "\n" + "\n".join(passage)), (3, passage[0] + "\n\n" + sentence(30) + "\n" + passage[1]),
        (4, sentence(60)), (5, "no end of this"), (6, "no end of this"),
    ]
    out = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # 18 words alone are no passage, so 3 keeps its two sentences
    assert [out[k].text for k in (1, 3, 4, 5, 6)] == [docs[k - 1][1] for k in (1, 3, 4, 5, 6)]
    at = docs[1][1].index(passage[0])
    assert out[2].text == docs[1][1][:at] and [tuple(x) for x in out[2].removed] == [(at, len(docs[1][1]))]


def test_line_dedup_cuts_texts_and_keeps_offsets(spark):
    docs = [
        (1, "one two three four five\nkeep", "a", 1), (2, "top\nOne two three four five\nend", "b", 2), (3, None, "c", 3),
        (2, "other words\nend of this one here it is\nlast", "d", 4), (4, "end of this one here it is", "e", 5), (4, "end of this one here it is", "e", 5),
    ]
    rows = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string, _gone string, key int"), 5).collect()
    got = {(r.doc_id, r.key): r for r in rows}
    assert len(rows) == 6 and got[1, 1].text == docs[0][1] and got[3, 3].text is None
    assert got[2, 2].text == "top\nend" and [tuple(x) for x in got[2, 2].removed] == [(4, 28)]
    # another text of the same id loses only what it repeats itself
    assert got[2, 4].text == docs[3][1] and got[4, 5].text == ""
    assert got[2, 2]["_gone"] == "b"


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"line number {i} of the text" for i in range(30_000))
    got = line_dedup.units(spark.createDataFrame([(1, text)], "doc_id long, text string")).agg(F.count("*"), F.max("stop")).first()
    assert tuple(got) == (30_000, len(text))


def test_line_dedup_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, removed int")
    assert line_dedup.occurrences(none).count() == 0 and line_dedup.deduplicated(none).columns == ["doc_id", "text", "removed"]


def test_jaccard_classes(spark):
    rng = random.Random(5)
    docs = [(900, None), (901, ""), (902, "one"), (903, "One!"), (904, " ,. ")]
    for group in range(6):
        base = prose(rng, 120)
        for k in range(40 if group == 0 else 5):
            w = list(base)
            for at in rng.sample(range(len(w)), k % 5):
                w[at] = "changed" + str(rng.randrange(3))
            docs.append((100 * group + k, " ".join(w)))
    docs += [(950 + k, " ".join(prose(rng, 60))) for k in range(5)]
    docs += [(1000 + k, docs[5][1]) for k in range(300)]
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs + docs[5:9], "doc_id long, text string")).collect()
    links, classes = jaccard_links(docs)
    assert {r.doc_id: r.class_id for r in rows} == classes
    assert {r.doc_id: r.n_links for r in rows} == {doc: links[doc] for doc, _ in docs}


def test_jaccard_of_a_large_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 300)
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    rng = random.Random(7)
    base, docs = prose(rng, 100), []
    for k in range(2000):
        w = list(base)
        for at in rng.sample(range(len(w)), k % 9):
            w[at] = "new" + str(rng.randrange(4))
        docs.append((k, " ".join(w)))
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    grams = sorted({g for _, t in docs for g in zip(*[t.split()[d:] for d in range(5)])})
    at, m = {g: k for k, g in enumerate(grams)}, np.zeros((2000, len(grams)), np.float32)
    for doc, t in docs:
        m[doc, [at[g] for g in zip(*[t.split()[d:] for d in range(5)])]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    link = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    assert {r.doc_id: r.n_links for r in rows} == dict(enumerate(link.sum(axis=1).tolist()))
    near, before = np.arange(2000), None
    while before is None or (near != before).any():
        before, near = near, np.where(link | np.eye(2000, dtype=bool), near[None, :], 2000).min(axis=1)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(near.tolist()))


def test_jaccard_of_repeated_ids(spark):
    rng = random.Random(8)
    one, two = (" ".join(prose(rng, 200)) for _ in range(2))
    docs = [(1, one), (1, two), (2, two + " end"), (3, one + " end"), (3, one + " end"), (4, " ".join(prose(rng, 200)))]
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.first) for r in rows) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 4, 0, True)]


def test_jaccard_stage_keeps_one_of_each_class(spark):
    base = " ".join(prose(random.Random(6), 80))
    docs = [(3, base, "en", "a", 1, "x"), (1, base, "en", "a", 1, "y"), (1, base, "en", "a", 1, "y"), (2, base + " end", "en", "b", 1, None), (4, None, None, None, None, None), (None, base, None, None, None, None)]
    df = spark.createDataFrame(docs, SHAPE + ", key string")
    out = ngram_join.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 4, None]


def test_posteriors_equal_naive_bayes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "domain")
    found = mixing.groups(docs, docs)
    assert len(found) == mixing.GROUPS and not any(a in b for a in found for b in found if a != b)
    feats = mixing.features(docs, ["doc_id", "domain", "source"], found)
    model = mixing.learn(feats)
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    rows = feats.withColumn("p", mixing.posterior(model, F.col("_c"))).collect()
    sums = {d: np.ones(len(found) + 1) for d in model["domains"]}
    for r in rows:
        left, counts = texts[r.doc_id], []
        for g in found:
            counts.append(left.count(g))
            left = left.replace(g, "")
        assert r["_c"] == [*counts, len(left)]
        if r.domain is not None:
            sums[r.domain] += r["_c"]
    number = Counter(r.domain for r in rows if r.domain is not None)
    for r in rows:
        s = [np.log(number[d] / sum(number.values())) + mixing.TEMPER * np.dot(r["_c"], np.log(sums[d] / sums[d].sum())) for d in model["domains"]]
        want = np.exp(np.array(s) - max(s))
        assert np.allclose(r.p, want / want.sum(), atol=1e-9)


def test_rates_meet_the_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "domain")
    feats = mixing.features(docs, ["doc_id", "domain"], mixing.groups(docs, docs))
    rows = mixing.mix(feats, docs.select("doc_id"))(feats).collect()
    got, most = np.zeros(4), sum(r["_n"] for r in rows)
    for r in rows:
        assert r["_rate"] >= 0 and (r["_n"] or 0) >= 0
        got += r["_rate"] * r["_n"] * np.array(r["_p"])
    want = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    assert np.allclose(got / got.sum(), want, atol=0.005), (got / got.sum(), want)
    assert got.sum() >= most
    assert all(np.floor(r["_rate"]) <= r["_copies"] <= np.ceil(r["_rate"] + 1e-3) for r in rows)


def test_mixing_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (2, None, "en"), (None, "x", "en")], "doc_id long, text string, domain string")
    none = spark.createDataFrame([], LABELS)
    for rows in (docs, docs.limit(0)):
        assert mixing.groups(rows, none) == []
        feats = mixing.features(rows, ["doc_id", "domain"], [])
        assert all(r["_copies"] == 1 for r in mixing.mix(feats, none)(feats).collect())
    some = spark.createDataFrame([(2, 1, 0)], LABELS)
    feats = mixing.features(docs, ["doc_id", "domain"], mixing.groups(docs, some))
    assert mixing.mix(feats, some)(feats).count() == 4


def test_groups_of_other_scripts(spark):
    texts = {"ru": "москва слезам не верит никогда", "el": "η γλώσσα είναι ελληνική πάντα", "ja": "これは日本語の文です", "en": "this is the english one"}
    docs = spark.createDataFrame([(k, t, d) for k, (d, t) in enumerate(texts.items())], "doc_id long, text string, domain string")
    found = mixing.groups(docs, docs)
    assert all(any(g in t for g in found) for t in texts.values()) and len(found) == mixing.GROUPS
    feats = mixing.features(docs, ["doc_id", "domain"], found)
    model = mixing.learn(feats)
    rows = feats.withColumn("p", mixing.posterior(model, F.col("_c"))).collect()
    assert all(model["domains"][int(np.argmax(r.p))] == r.domain for r in rows)


def test_rates_against_least_squares(spark):
    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 400, 300).astype(float), rng.dirichlet([0.4, 0.4, 0.4], 300)
    rows = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "_n double, _p array<double>")
    aim = {"a": 0.7, "b": 0.2, "c": 0.1}
    found = mixing.fit(rows, sorted(aim), aim)
    rates = np.array([r[0] for r in rows.select(mixing.rate(found["directions"], found["start"], F.col("_p"))).collect()])
    # the same objective by coordinate descent
    a, t = (n[:, None] * p).T, found["wanted"]
    r, left = np.zeros(len(n)), -t.copy()
    for _ in range(200):
        for j in range(len(n)):
            step = max(-r[j], -(a[:, j] @ left) / (a[:, j] @ a[:, j]))
            r[j] += step
            left += step * a[:, j]
    ours = np.abs(a @ rates - t).max()
    assert (rates >= 0).all() and (rates == 0).any()
    assert np.abs(left).max() <= 1e-6 * t.sum() and ours <= 1e-3 * t.sum(), (ours, t)


def test_mixing_learns_from_every_labelled_row(spark, tmp_path):
    en, de = "the weather with thy wooden wheel why", "schön für die einen zwei kleinen schüler"
    docs = [(k, en if k % 2 else de, "en" if k % 2 else "de", "s", 40) for k in range(8)]
    spark.createDataFrame(docs, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (0, 0, 0), (2, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.domain for r in mixing.op5_soft_membership_mixing(spark, str(tmp_path)).collect()}
    assert got == {doc: lang for doc, _, lang, _, _ in docs}


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.op4_hierarchical_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    en, de = "the cat and the dog went with them", "der hund und die katze gingen mit ihnen schön"
    known = spark.createDataFrame([(k, en if k % 2 else de, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    cases = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ..."), (4, en), (4, en), (None, de), (5, en * 40_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.predicted(cases, language_id.train(known)).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "en"), ("None", "de")]
    empty = language_id.train(known.limit(0))
    assert {r.lang_pred for r in language_id.predicted(cases, empty).collect()} == {"und"}


def test_quality_held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = quality_mil.op10_attention_mil_quality(spark, sf_dir).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_quality_training_bags_have_every_passage():
    text = "some words " * 4_000
    batch = pa.RecordBatch.from_pydict({"y": [1], "text": [text]})
    (bag,) = (x for b in quality_mil._bags([batch]) for x in b.column(1).to_pylist())
    assert len(text) == 44_000 and bag == quality_mil.encode(text).tobytes() and len(quality_mil.encode(text)) == 110


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "fine words"), (4, "fine words"), (None, "more"), (5, "long text " * 60_000)], "doc_id long, text string")
    for rows, share in (([], 0.5), ([(4, 1)], 1.0), ([(4, 0), (None, None)], 0.0)):
        model = quality_mil.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        got = quality_mil.scored(docs, model).collect()
        assert len(got) == 7 and {r.score for r in got if r.doc_id in (4, 5, None)} == {share}
        assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, steps = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding")

    good = steps[0](spark, docs, sf_dir).cache()
    keeps = {r.doc_id for r in quality_rules.op7_quality_rules(spark, sf_dir).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == keeps and good.columns == docs.columns

    texts = [(r.doc_id, r.text) for r in good.collect()]
    unique = steps[1](spark, good, sf_dir).cache()
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(jaccard_links(texts)[1].values())) and unique.columns == docs.columns

    texts = [(r.doc_id, r.text) for r in unique.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = steps[2](spark, unique, sf_dir).cache()
    hit = {d for d, _, n, _ in brute.contamination(texts, items) if n}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert {d: t for d, t in texts if d not in hit}.items() <= after.items() and clean.columns == docs.columns
    assert not any(n for _, _, n, _ in brute.contamination(list(after.items()), items))

    mixed = steps[3](spark, clean, sf_dir).cache()
    assert set(r.doc_id for r in mixed.collect()) == set(after) and mixed.columns == docs.columns

    last = steps[4](spark, mixed, sf_dir).collect()
    sizes = Counter(r.shard for r in last)
    assert len(last) == mixed.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in last if r.shard == shard) == list(range(n))


@pytest.mark.parametrize("kind", ["no rows", "nulls and clashing names"])
def test_every_stage_takes_odd_tables(spark, tmp_path, kind):
    rows = [] if kind == "no rows" else [(None, None, None, None, None, 1, "k"), (1, "", "en", None, 0, 2, None), (1, "word " * 100, None, "s", 500, 3, "k"), (2, " ".join(prose(random.Random(9), 200)), "en", "s", 900, 4, "")]
    docs = spark.createDataFrame(rows, SHAPE + ", _n int, key string")
    spark.createDataFrame([("q1", None), ("q2", ""), ("q3", "one two")] if rows else [], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0), (None, None, None)] if rows else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for module in (quality_rules, ngram_join, decontaminate, mixing):
        out = module.stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.collect()
    assert sharding.stage(spark, docs, str(tmp_path)).count() == len(rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 2, None}
