"""Held-out accuracy of the compression classifier, and its defined cases."""

import zlib

import numpy as np

from lexalign.llm import compression_quality as q

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = np.random.default_rng(0)
    good = ["the", "of", "and", "river", "house", "walked", "slowly", "morning", "garden", "with"]
    bad = ["buy###", "NOW!!", "click***", "win%%%", "$$$", "FREE!!", "cash&&&", "| menu |"]
    rows, labels = [], []
    for i in range(n):
        y = int(i % 4 > 0)
        rows.append((i, " ".join(rng.choice(good if y else bad, int(rng.integers(20, 400)))), "x"))
        labels.append((i, y, 0))
    return rows, labels


def test_held_out_accuracy_and_isolation(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    sample = q.labelled_sample(docs, known)
    model = q.fit(sample)
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out} == set(out)
    right = [got[i].predicted == labels[i][1] for i in out]
    assert np.mean(right) >= 0.95
    flipped = spark.createDataFrame([(i, 1 - y if i in set(out) else y, 1) for i, y, _ in labels], LABELS)
    assert q.labelled_sample(docs, flipped) == sample           # held-out labels are never read
    assert len(q.labelled_sample(docs, known, 20)) == 40


def test_defined_cases(spark):
    rows, labels = corpus(80)
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "no id", "x"), (902, "w " * 200_000, "x"), rows[0]], DOCS)
    model = q.fit(q.labelled_sample(docs, spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (3, 7, 0)], LABELS)))
    got = q.score(docs, model).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[900][0].score == by_id[901][0].score and by_id[None][0].held_out is False
    assert len(by_id[rows[0][0]]) == 2 and by_id[rows[0][0]][0].score == by_id[rows[0][0]][1].score
    empty = q.fit(q.labelled_sample(docs, spark.createDataFrame([], LABELS)))
    assert {round(r.score, 6) for r in q.score(docs, empty).collect()} == {0.5}
    assert q.score(docs.where("false"), model).collect() == []


def test_fit_sees_whole_texts(spark):
    rng = np.random.default_rng(8)
    words = {0: ["bad", "spam", "offer"], 1: ["good", "prose", "lines"]}
    same = " ".join(["head"] * 4_000)                                  # 20 KB that all texts begin with
    texts = {i: same + " " + " ".join("".join(rng.choice(words[i % 2], 2)) for _ in range(3_000)) for i in range(60)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts], LABELS)
    sample = q.labelled_sample(docs, labels)
    assert all(len(t) == q.SAMPLE_BYTES and t.startswith(b"head") and t.endswith(texts[i].encode()[-1000:]) for _, t, i in sample)
    model = q.fit(sample, docs)
    pair = q.Pair(model.good, model.bad)
    whole = q.whole_differences(docs, [3, 4], model.good, model.bad)
    assert whole == {i: (pair.difference(texts[i].encode()), len(texts[i].encode())) for i in (3, 4)}
    got = {r.doc_id: r.predicted for r in q.score(docs, model).collect()}
    assert all(got[i] == i % 2 for i in texts)


def test_scores_are_calibrated_for_short_texts_and_rare_classes(spark):
    rng = np.random.default_rng(3)
    shared, good, bad = ["aa", "the", "on", "it", "be"], ["river", "garden"], ["cash###", "win%%%"]
    rows, labels = [], []
    for i in range(3000):
        y = int(rng.random() < 0.85)                                 # good ones are many, and few words tell
        n = int(rng.choice([3, 6, 12, 200]))
        words = [str(rng.choice(good if y else bad)) if rng.random() < 0.25 else str(rng.choice(shared)) for _ in range(n)]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, y, 0))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    sizes = q.class_sizes(known)
    fit_rows = [y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sizes == {1: sum(fit_rows), 0: len(fit_rows) - sum(fit_rows)}
    model = q.fit(q.labelled_sample(docs, known, 200), docs, sizes)
    got = np.array([(r.score, labels[r.doc_id][1]) for r in q.score(docs, model).where("held_out").collect()])
    assert ((got[:, 0] >= 0.5) == got[:, 1]).mean() >= 0.85
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 0.9), (0.9, 1.01)):
        part = got[(got[:, 0] >= low) & (got[:, 0] < high)]
        if len(part) >= 40:
            assert abs(part[:, 0].mean() - part[:, 1].mean()) < 0.15, (low, part[:, 0].mean(), part[:, 1].mean())
