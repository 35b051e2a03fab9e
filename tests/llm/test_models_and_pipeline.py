"""Held-out accuracy of the classifiers, their arithmetic against plain loops, and the pipeline against plain Python."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tiergraph.llm import _words, line_dedup, quality_classifier, sentencepiece_nbest, toxicity

SF = "/root/testdata/sf0.01"


def area(score, y):
    """Share of pairs of one and zero that the score ranks right."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = int(y.sum())
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize(("query", "column", "least"), [(quality_classifier.op3_quality_classifier, "quality", 0.97), (toxicity.op6_toxicity, "toxic", 0.85)])
def test_held_out_rows(spark, query, column, least):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in query(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    folds, own = {"quality": (4, 2), "toxic": (5, 0)}[column]
    assert all(zlib.crc32(str(r.doc_id).encode()) % folds == own for r in rows)
    y = np.array([labels[r.doc_id] for r in rows])
    assert area(np.array([r.score for r in rows]), y) > least
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9


def test_flattened_trees_equal_a_plain_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.3)).astype(float)
    model = quality_classifier.train_trees(x, y)
    got = model.score(x)
    for row, score in zip(x, got, strict=True):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
    assert ((got >= 0.5) == y).mean() > 0.95


def test_recurrent_network_equals_plain_steps():
    net, r = toxicity.Network(), np.random.default_rng(4)
    h = toxicity.HIDDEN
    for k in net.p:
        net.p[k] = r.normal(0, 0.5, net.p[k].shape).astype(np.float32)
    ids = r.integers(0, 1000, (40, 1 + len(toxicity.PREFIXES))).astype(np.int32)
    first, length = np.array([0, 5, 30]), np.array([24, 7, 10])
    got = net.logits(ids, first, length)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for f, n, z in zip(first, length, got, strict=True):
        x = [np.concatenate((net.p["ew"][i[0]], sum(net.p["ec"][j] for j in i[1:]))) for i in ids[f : f + n]]
        states = {}
        for k, way in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            state, states[k] = np.zeros(h), [None] * n
            for t in way:
                gate, back = x[t] @ net.p["w" + k] + net.p["c" + k], state @ net.p["h" + k]
                update, reset = sig(gate[:h] + back[:h]), sig(gate[h : 2 * h] + back[h : 2 * h])
                new = np.tanh(gate[2 * h :] + reset * back[2 * h :])
                states[k][t] = state = (1 - update) * new + update * state
        both = np.array([np.concatenate((a, b)) for a, b in zip(states["f"], states["b"], strict=True)])
        attention = np.exp(np.tanh(both) @ net.p["v"])
        assert abs((attention / attention.sum()) @ both @ net.p["u"] + net.p["b"][0] - z) < 1e-3


def test_of_several_labels_the_least_counts(spark):
    words = ["kind", "calm", "quiet", "green", "river", "stone"]
    docs = spark.createDataFrame([(i, " ".join([words[i % 6], words[i % 5]] * 10 + ["vileword"] * 3 * (i < 40))) for i in range(120)], "doc_id long, text string")
    labels = [(i, int(i < 40)) for i in range(120)]
    twice = labels + [(i, 1) for i in range(40, 120)]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, twice))
    assert np.allclose(one.final, two.final)


def chars(line, size=12):
    """The shingles of line_dedup: at word starts, and of lines with few of these at every place."""
    low = line.lower()
    own = {low[m.start() : m.start() + size] for m in re.finditer(r"(?<![^\W_])[^\W_]", low)}
    return own, {low[i : i + size] for i in range(len(low) - size + 1)} if len(own) < 10 else set()


def similar(x, y):
    (a, e), (b, f) = x, y
    if min(len(a), len(b)) >= 5:
        return len(a & b) >= 0.8 * len(a | b)
    return bool(e and f) and len(e & f) >= 0.8 * len(e | f)


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(31)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    item = " ".join(r.choice(vocab) for _ in range(14))
    shared = say(20)
    texts = {}
    for i in range(90):
        texts[i] = "\n".join(say(r.randint(15, 40)) for _ in range(r.randint(2, 5)))
        if i % 9 == 0:
            texts[i] += "\n" + shared
        if i % 15 == 1:
            texts[i] += "\n" + say(9)[:-1] + " " + item + "."
    for i in range(90, 110):  # near copies, without line breaks so that whole documents decide
        w = re.sub(r"\s+", " ", texts[i - 90]).split(" ")
        w[r.randrange(len(w))] = "altered"
        texts[i] = " ".join(w)
    for i in range(110, 160):
        texts[i] = " ".join("*#$ " + r.choice(vocab) + " !!" for _ in range(r.randint(10, 40)))
    texts |= {160: None, 161: "", 162: "one two"}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(i, int(i < 110), 0) for i in range(160)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item), (2, "words that stand nowhere in here at all")], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    statistics = lambda t: quality_classifier.statistics(_words.Chunk(0, np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))
    left = {i: t for i, t in texts.items() if model.score(statistics(t))[0] >= 0.7}
    assert 80 < len(left) < 125

    # Lines: of each group of similar ones the first stays.
    lines = [(i, k, x) for i in sorted(left) for k, x in enumerate((left[i] or "").split("\n")) if left[i] is not None]
    sets = [chars(x) for _, _, x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    judged = [max(map(len, s)) >= 5 for s in sets]
    for a in range(len(lines)):
        for b in range(a):
            same = lines[a][2].lower() == lines[b][2].lower() and re.search(r"[^\W_]", lines[a][2])
            if same or (judged[a] and judged[b] and similar(sets[a], sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {lines[x][:2] for x in range(len(lines)) if find(x) != x}
    for i in list(left):
        if left[i] is not None and any(g[0] == i for g in gone):
            left[i] = "\n".join(x for k, x in enumerate(left[i].split("\n")) if (i, k) not in gone)
            if not left[i].strip(" \t\n\x0b\f\r"):
                del left[i]

    # Near copies by five words and 0.8.
    grams = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in left}
    for _ in range(5):
        for a in left:
            for b in left:
                if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                    least[a] = min(least[a], least[b])
    near = [i for i in left if least[i] != i]
    left = {i: t for i, t in left.items() if least[i] == i}

    # Test items.
    parts = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)})([x for x in re.split(r"[\W_]+", (t or "").lower()) if x])
    leaks = [i for i, t in left.items() if len(parts(item) & parts(t)) >= 0.8 * len(parts(item))]
    left = {i: t for i, t in left.items() if i not in leaks}
    assert len(gone) > 5 and len(near) > 5 and leaks

    out = {x.doc_id: x for x in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(left)
    back = spark.createDataFrame([(i, x.ids) for i, x in out.items()], "doc_id long, ids array<int>")
    assert {x.doc_id: x.text for x in sentencepiece_nbest.decode_ids(back).collect()} == {i: t or "" for i, t in left.items()}
    assert all(x.round_trip and x.round_trip_2 in (True, None) for x in out.values())


def test_stages_with_null_ids_repeated_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    good = "The old mill by the river turns all day, and its keeper sings to the birds in the trees."
    rows = [(None, good, "a", 1), (1, good, "b", 2), (1, good, "b", 2), (2, None, "c", 3), (3, "", "d", 4), (None, "A second text without any id at all stands here and says other things.", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _k int")
    spark.createDataFrame([(1, "no such words are found in any of the texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        if name == "quality_classifier":
            assert {(x["_id"], x["_k"]) for x in out} <= {(x[2], x[3]) for x in rows}
        elif name == "line_dedup":  # of equal lines the first stays: null ids come first
            assert sorted(x["_id"] for x in out) == ["a", "c", "d", "e"]
        elif name == "ngram_jaccard":  # an id stays as a whole
            assert {x["_id"] for x in out} >= {"b", "c", "d"}
        else:
            assert len(out) == len(rows)


def test_line_dedup_of_a_very_long_text(spark):
    line = "This very line of plain words stands many thousand times in one text of a single document."
    rows = [(1, "\n".join([line] * 20_000)), (2, line), (3, "x" * 200_000), (4, "y " * 100_000)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == line and 2 not in got and got[3] == rows[2][1] and got[4] == rows[3][1]
