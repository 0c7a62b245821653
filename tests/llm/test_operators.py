"""The training-data operators against brute force, and on awkward rows."""

import base64
import hashlib
import random
import sys
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import bpe, chat, decontam, jaccard, labelled, licenses, lines, quality_model, quality_rules, queries, tokens, toxicity, words

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Null, empty, blank, one word, very long, ties, repeated rows, null ids.
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e f g"), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"), (7, "ß é İ ǅ " * 3), (8, "long " * 40000), (9, "x" * 30000), (10, "\x00 　 🙂\n\n")]
CLASH = "text string, id string, h string, node string, words string, _id string, n string, label string"


def table(spark, rows):
    """The rows, with columns whose names operators might use for their own."""
    return spark.createDataFrame([(i, t, *["keep"] * 7) for i, t in rows], "doc_id long, " + CLASH)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_rules(spark):
    def brute(t):
        w = WORD.findall(t or "")
        seen, covered = {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered.update(i + j for i in at for j in range(3))
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered)

    rows = [*AWKWARD, (11, "a b a b a b\na b\nx\n a b\n\n"), (12, "a|b & <c> #"), (13, "p q r x p q r y p q r")]
    got = quality_rules.quality_cascade(table(spark, rows), report=quality_rules.BASE).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept", "id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[1:6]) == brute(r.text) and r.id == "keep"
        assert not r.kept or r.n_words >= 50
    full = {r.doc_id: r for r in quality_rules.measured(table(spark, [(1, "x 1 2\n- a...\n  \u2022 b\n12 \u00e9 ...\nx"), (2, None)])).collect()}
    assert [full[1][m] for m in quality_rules.LATER] == [4, 10, 2, 2, 5] and all(full[2][m] == (1 if m == "n_lines" else 0) for m in quality_rules.METRICS)


def test_rules_short_circuit(spark):
    rng = random.Random(11)
    plain = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    rows = [(1, " ".join(plain(90))), (2, "a b c " * 40), (3, " ".join(plain(60)) + " 12345" * 90), (4, "\n".join(f"- {x}" for x in plain(60))), (5, "\n".join(f"{x} ..." for x in plain(60))), (6, None), (7, " ".join(x for w in plain(40) for x in (w, "5%", "..", "!")))]
    docs = table(spark, rows * 3).withColumn("n_words", F.lit("mine")).withColumn("left", F.lit("mine")).withColumn("a.b", F.lit("dot"))
    rules = quality_rules.default_rules()
    some = quality_rules.measured(table(spark, rows))
    want = {r.doc_id: not r.no for r in some.select("doc_id", F.greatest(*(r.rejects for r in rules)).alias("no")).collect()}
    assert [i for i, ok in want.items() if ok] == [1]
    for order in (None, rules, rules[::-1]):
        for report in ((), quality_rules.BASE, ("n_words",)):
            got = quality_rules.quality_cascade(docs, order, report=report)
            assert got.columns == [x for x in docs.columns if x not in report] + [*(m for m in quality_rules.METRICS if m in report), "kept"]
            got = got.collect()
            assert len(got) == 21 and all(r.kept == want[r.doc_id] and r.left == "mine" and r["a.b"] == "dot" for r in got)
    # What later rules read is left unmeasured for the documents that an earlier one has rejected.
    for r in quality_rules.quality_cascade(table(spark, rows), report=quality_rules.BASE, trace=True).collect():
        later = [r[m] for m in quality_rules.LATER]
        assert None not in later if r.kept else None in later or sum(x is not None for x in later) == 5
        if r.doc_id in (2, 6):  # rejected by the reported metrics
            assert later == [None] * 5 and r.n_words is not None
    # A rule that would fail on a rejected document's text is never reached.
    bad = quality_rules.Rule("raises", F.when(F.col("n_distinct") >= 0, F.raise_error(F.lit("read"))).cast("boolean"), ("n_distinct",))
    few = quality_rules.Rule("few", F.col("n_words") < 50, ("n_words",))
    with pytest.raises(Exception, match="read"):
        quality_rules.quality_cascade(table(spark, [(1, "a b")]), [bad]).collect()
    assert quality_rules.quality_cascade(table(spark, []), report=("n_words",)).count() == quality_rules.quality_cascade(table(spark, [])).count() == 0
    assert [r.kept for r in quality_rules.quality_cascade(table(spark, [(1, "a b")]), [few], report=("n_words",)).collect()] == [False]


def textbook_tiles(doc, item, seed):
    """Greedy string tiling by its definition: mark the longest common run of unmarked words until none is left."""
    in_doc, in_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                if n >= seed and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        out.append(best)
        in_doc[i : i + n] = in_item[j : j + n] = [True] * n


def test_tiles_against_the_textbook():
    rng = random.Random(2)
    hashes = words.hashed_words([" ".join(f"w{i}" for i in range(30)).encode()], words.SIGNS)[0]
    for _ in range(500):
        kinds, seed = rng.choice([2, 3, 5, 20]), rng.choice([1, 2, 3, 5])
        doc = [rng.randrange(kinds) for _ in range(rng.randrange(1, 40))]
        item = [rng.randrange(kinds) for _ in range(rng.randrange(1, 25))]
        at = rng.randrange(len(doc))
        doc[at:at] = item[: rng.randrange(len(item) + 1)]
        assert decontam.tiles(hashes[doc], hashes[item], seed) == textbook_tiles(doc, item, seed)
        cut = rng.randrange(len(doc) + 1)
        # Stretches: as if a word of no other place stood between them.
        apart = decontam.tiles(hashes[doc], hashes[item], seed, [x for x in (cut, len(doc) - cut) if x])
        assert apart == [(i - (i > cut), j, n) for i, j, n in textbook_tiles([*doc[:cut], -1, *doc[cut:]], item, seed)]


def test_contaminated_against_brute_force(spark):
    """Whole tables of random texts over few words, so that seeds, items and documents meet in many ways."""
    rng = random.Random(8)
    sentence = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    items = [(i, sentence(rng.randrange(1, 30))) for i in range(25)]
    shared = sentence(12)
    items += [(i, shared + sentence(6)) for i in range(25, 30)]
    docs = []
    for i in range(120):
        parts = [sentence(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            _, w = rng.choice(items)
            a, b = sorted((rng.randrange(len(w) + 1), rng.randrange(len(w) + 1)))
            parts += [w[a:b], sentence(rng.randrange(4))]
        rng.shuffle(parts)
        docs.append((i, [x for p in parts for x in p]))
    wanted = set()
    for i, doc in docs:
        for j, item in items:
            found = textbook_tiles(doc, item, min(5, len(item)))
            matched = sum(n for *_, n in found)
            if found and matched >= 0.5 * len(item):
                wanted.add((i, j, len(item), matched, len(found), max(n for *_, n in found)))
    got = decontam.contaminated(table(spark, [(i, " ".join(w)) for i, w in docs]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert len(got) == len(wanted) > 50 and {tuple(r)[:6] for r in got} == wanted


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog while seven green birds sing loudly today"
    w = item.split()
    docs = [*AWKWARD, (20, "intro " + item + " outro"), (21, " ".join(w[8:]) + " and then " + " ".join(w[:8])), (22, " ".join(w[:6]) + " nothing else"), (23, item.upper().replace(" ", ",\n")), (24, " ".join(reversed(w)))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(table(spark, docs), bench).collect()}
    assert set(got) == {(20, 1), (21, 1), (23, 1)} and got[21, 1].n_tiles == 2
    assert decontam.decontaminate(table(spark, docs), bench).count() == len(docs) - 3
    assert decontam.contaminated(table(spark, docs), bench.limit(0)).count() == 0
    assert decontam.contaminated(table(spark, []), bench).count() == 0 and decontam.decontaminate(table(spark, []), bench).count() == 0
    # A column of a helper's name, one with a dot, and a null id among the hits.
    odd = table(spark, [*docs, (None, item)]).withColumn("_hit", F.lit("mine")).withColumn("a.b", F.lit("dot"))
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns and {r["a.b"] for r in kept.collect()} == {"dot"}
    assert kept.count() == len(docs) - 4  # the hit null id takes the other row of null id along


def test_classifiers(spark):
    rng = random.Random(3)
    plain = ["river", "stone", "walk", "light", "green", "table", "window", "paper"]

    def doc(i):
        w = [rng.choice(plain) for _ in range(60)]
        if i % 3 == 0:
            w[30] = rng.choice(["idiot", "scum"])
        return " ".join(w) if i % 4 else " | ".join(x + "###" for x in w)

    rows = [(i, doc(i)) for i in range(400)]
    docs = table(spark, rows + [(1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i, _ in rows] + [(2000, None, None)], "doc_id long, quality int, toxic int")
    for module, name, cut in ((quality_model, "quality", 0.3), (toxicity, "toxic", 0.5)):
        model = module.fit(docs, labels, name)
        got = docs.withColumn("s", module.score(docs, model)).join(labels.select("doc_id", F.col(name).alias("y")), "doc_id", "left").withColumn("held", labelled.held_out(F.col("doc_id"))).collect()
        assert len(got) == 402 and all(0 <= r.s <= 1 for r in got)
        held = [r for r in got if r.held and r.y is not None]
        assert len(held) > 40 and sum((r.s >= cut) == (r.y == 1) for r in held) / len(held) > 0.95
        none = module.fit(docs, labels.limit(0), name)
        assert all(r.s == 0.5 for r in docs.select(module.score(docs, none).alias("s")).collect())


def test_classifiers_in_any_layout(spark):
    """Ids with both labels are left out, and how the tables are laid out changes no bit of a score."""
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["river", "stone", "walk", "light", "scum" if i % 2 else "green"]) for _ in range(30))) for i in range(200)]
    known = [(i, i % 2, i % 2) for i, _ in rows]
    both = [(i, 1 - i % 2, 1 - i % 2) for i in range(0, 200, 5)]
    kind = "doc_id long, quality int, toxic int"
    for module, name in ((quality_model, "quality"), (toxicity, "toxic")):
        seen = []
        for order in (list, lambda x: x[::-1], lambda x: sorted(x, key=lambda r: hash(str(r)))):
            docs = table(spark, order(rows)).repartition(1 + len(seen))
            labels = spark.createDataFrame(order(known + both), kind).repartition(3)
            model = module.fit(docs, labels, name)
            seen.append({r.doc_id: r.s for r in docs.select("doc_id", module.score(docs, model).alias("s")).collect()})
        clean = module.fit(docs, spark.createDataFrame([r for r in known if r[0] % 5], kind), name)
        seen.append({r.doc_id: r.s for r in docs.select("doc_id", module.score(docs, clean).alias("s")).collect()})
        assert seen[0] == seen[1] == seen[2] == seen[3]
        assert table(spark, []).select(module.score(docs, clean)).count() == 0


def toxic_corpus(words_, many, long):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(words_)]
    return [(i, " ".join([*rng.choices(vocabulary, k=long), *(["scum"] if i % 3 == 0 and i % 7 else [])])) for i in range(many)]


@pytest.mark.parametrize(("words_", "many", "long", "features"), [(4, 150, 12, 40), (2500, 500, 40, 600)])
def test_toxicity_against_one_process(spark, monkeypatch, words_, many, long, features):
    """Counts, the choice of features, scaling and the fit, made again in plain numpy from whole texts."""
    import numpy as np

    rows = toxic_corpus(words_, many, long)
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, features=features)
    # How rows are dealt to tasks changes no bit, rare n-grams included; nor do repeated rows.
    for tasks, order in ((1, 1), (3, -1), (8, -1)):
        monkeypatch.setattr(toxicity, "TRAIN_TASKS", tasks)
        again = toxicity.fit(table(spark, rows[::order] + rows[:5] * tasks), labels, features=features)
        assert again.ids.tolist() == model.ids.tolist() and again.weights.tolist() == model.weights.tolist() and again.bias == model.bias
    held = {r.doc_id for r in docs.where(labelled.held_out(F.col("doc_id"))).collect()}
    train = [(t, int(i % 3 == 0)) for i, t in rows if i not in held]
    has = [set(np.concatenate([h for h, _ in toxicity.ngrams([t.encode()])]).tolist()) for t, _ in train]
    n1, n0 = sum(y for _, y in train), sum(1 - y for _, y in train)
    count = {}
    for some, (_, y) in zip(has, train):
        for h in some:
            count.setdefault(h, [0, 0])[y] += 1
    chi = {h: ((p * (n0 - q) - q * (n1 - p)) ** 2 / ((p + q) * (n1 + n0 - p - q + 1)), -h) for h, (q, p) in count.items() if p + q >= toxicity.MIN_DOCS}
    ids = sorted(sorted(chi, key=chi.get, reverse=True)[:features])
    ratio = np.array([np.log((count[h][1] + 1) / (n1 + 1)) - np.log((count[h][0] + 1) / (n0 + 1)) for h in ids])
    x, y = np.array([[h in some for h in ids] for some in has], float), np.array([y for _, y in train], float)
    w, b = np.ones(len(ids)) * 0.1, np.array([np.log(n1 / n0)])
    adam = labelled.Adam([w, b], 0.05)
    for _ in range(300):
        g = (labelled.sigmoid(x @ (w * ratio) + b) - y) / len(y)
        adam.step([(x.T @ g) * ratio + 1e-4 * w, np.array([g.sum()])])
    assert model.ids.tolist() == ids and np.allclose(model.weights, w * ratio, atol=1e-6) and abs(model.bias - b[0]) < 1e-6
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect()}
    for i, t in rows:
        z = sum(v for h, v in zip(ids, w * ratio) if h in set(np.concatenate([h for h, _ in toxicity.ngrams([t.encode()])]).tolist())) + b[0]
        assert abs(got[i] - labelled.sigmoid(np.array([z]))[0]) < 1e-6


def test_training_rows(spark):
    """One row of an id however often it comes, never more than asked for, ids of any type, the same rows in any layout."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(3, 0), (7, 1), (9, None), (None, 1)], "doc_id long, toxic int")
    rows = [(i, f"text {i}") for i in range(500)] + [(11, f"other {k}") for k in range(1000)] + [(12, "text 12")] * 1000 + [(None, "x"), (13, None)]
    got = labelled.training_rows(table(spark, rows), labels, "toxic").collect()
    held = {r.id for r in spark.range(500).where(labelled.held_out(F.col("id"))).collect()}
    assert sorted(int(r.id) for r in got) == [i for i in range(500) if i not in held and i != 3]
    some = labelled.training_rows(table(spark, rows), labels, "toxic", rows=50).collect()
    assert len(some) == 50 and set(some) <= set(got)
    assert set(labelled.training_rows(table(spark, rows[::-1]).repartition(3), labels.repartition(5), "toxic", rows=50).collect()) == set(some)
    text = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    named = labelled.training_rows(text(table(spark, rows)), text(labels), "toxic").collect()
    assert len(named) > 350 and all(r.id.startswith("d") for r in named)


def test_word_vectors_against_one_process(spark):
    import numpy as np

    texts = ["a b c a", "b c", "", "one a b"]
    index, want = quality_model.index_vectors(), np.zeros((quality_model.WORDS, quality_model.DIMS))
    for t in texts:
        rows, _ = quality_model.word_rows([t.encode()])
        for i, x in enumerate(rows):
            for j in range(max(0, i - quality_model.WINDOW), min(len(rows), i + quality_model.WINDOW + 1)):
                if j != i:
                    want[x] += index[rows[j]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, label int").repartition(3)
    sums = df.mapInArrow(quality_model._contexts, "sums binary").repartition(1).mapInArrow(quality_model._summed, "sums binary").first()["sums"]
    assert (np.frombuffer(sums, np.float32).reshape(want.shape) == want).all()


def plain_pool(text, vectors):
    """Mean, spread, step and total of a text's word vectors, a word at a time."""
    import math

    words_ = [vectors[quality_model.word_rows([w.encode()])[0][0]] for w in WORD.findall(text)]
    out = []
    for part in range(4):
        for d in range(quality_model.DIMS):
            x = [float(v[d]) for v in words_]
            n, total = len(x), sum(x)
            if not n:
                out.append(0.0)
            elif part == 0:
                out.append(total / n)
            elif part == 1:
                out.append(math.sqrt(max(0.0, sum(a * a for a in x) / n - (total / n) ** 2)))
            elif part == 2:
                out.append(sum(abs(a - b) for a, b in zip(x[1:], x)) / max(n - 1, 1))
            else:
                out.append(math.copysign(math.log1p(abs(total)), total))
    return out


@pytest.mark.parametrize("piece", [3, quality_model.PIECE])
def test_pooling_against_a_plain_version(monkeypatch, piece):
    import numpy as np

    monkeypatch.setattr(quality_model, "PIECE", piece)
    vectors = np.random.default_rng(1).normal(0, 0.2, (quality_model.WORDS, quality_model.DIMS)).astype(np.float32)
    texts = ["", " \n", "one", "one one one one", "a b c d e f g a b c", "Mixed Case words, é 日 and\tmore words\n", "w " * 3 * 7]
    assert np.allclose(quality_model.pooled([t.encode() for t in texts], vectors), [plain_pool(t, vectors) for t in texts], atol=2e-4)


def test_network_against_a_plain_version():
    """The network's gradients against differences of its loss, and the temperature against a search over the kept rows."""
    import numpy as np

    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, (60, 5)), (rng.random(60) < 0.6).astype(float)
    mean, spread, layers, temperature = quality_model.trained(np.column_stack([x, y + rng.normal(0, 0.5, 60)]), y)
    z = quality_model._forward(layers, (np.column_stack([x, y]) - mean) / spread)[1]
    assert ((z > 0) == (y > 0)).mean() > 0.75 and 0.25 <= temperature <= 8
    # Plain forward pass: one hidden layer of tanh.
    row = (np.append(x[0], y[0]) - mean) / spread
    hidden = [np.tanh(sum(row[i] * layers[0][i, j] for i in range(6)) + layers[1][j]) for j in range(quality_model.HIDDEN)]
    assert abs(sum(h * w for h, w in zip(hidden, layers[2])) + layers[3][0] - z[0]) < 1e-9
    # The first step of training moves each weight against the sign of the loss's slope, found by differences.
    data, many = np.column_stack([x, y + rng.normal(0, 0.5, 60)]), quality_model.EPOCHS
    steps = []
    try:
        quality_model.EPOCHS = 0
        start = quality_model.trained(data, y)
        real = quality_model.Adam.step

        def one(self, grads):
            steps.append([g.copy() for g in grads])
            raise StopIteration

        quality_model.Adam.step, quality_model.EPOCHS = one, 1
        with pytest.raises(StopIteration):
            quality_model.trained(data, y)
    finally:
        quality_model.EPOCHS, quality_model.Adam.step = many, real
    generator = np.random.Generator(np.random.PCG64(5))
    first = [generator.normal(0, 0.2, (6, quality_model.HIDDEN)), np.zeros(quality_model.HIDDEN), generator.normal(0, 0.2, quality_model.HIDDEN), np.zeros(1)]
    own = generator.permutation(60)[12:]
    batch = (data[np.array_split(generator.permutation(own), 1)[0]] - start[0]) / start[1]

    def loss(params, rows, want):
        p = labelled.sigmoid(quality_model._forward(params, rows)[1])
        return -np.mean(want * np.log(p) + (1 - want) * np.log(1 - p)) + 5e-5 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    order = [int(np.flatnonzero((np.abs((data - start[0]) / start[1] - r)).sum(1) < 1e-12)[0]) for r in batch]
    target = y[order]
    for k, at in ((0, (2, 3)), (1, (4,)), (2, (5,)), (3, (0,))):
        up, down = [p.copy() for p in first], [p.copy() for p in first]
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert abs((loss(up, batch, target) - loss(down, batch, target)) / 2e-6 - steps[0][k][at]) < 1e-5
    # The temperature is the best of its grid on the rows kept from training.
    held = np.random.Generator(np.random.PCG64(5))
    held.normal(0, 0.2, (6, quality_model.HIDDEN))
    held.normal(0, 0.2, quality_model.HIDDEN)
    kept = held.permutation(60)[:12]
    mean, spread, layers, temperature = quality_model.trained(data, y)
    z = quality_model._forward(layers, (data[kept] - mean) / spread)[1]
    cost = {t: -np.mean(y[kept] * np.log(labelled.sigmoid(z / t) + 1e-12) + (1 - y[kept]) * np.log(1 - labelled.sigmoid(z / t) + 1e-12)) for t in np.geomspace(0.25, 8, 61)}
    assert abs(cost[min(cost, key=cost.get)] - cost[min(cost, key=lambda t: abs(t - temperature))]) < 1e-12


def test_chat(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>\n", "", None, "plain\n\ntext", "<|im_end|>\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(said)] + [(2, None, None, None, "x"), (2, 0, "us\ner%0A<|", "q", "x"), (3, 0, "assistant", "same", "x"), (3, 0, "assistant", "same", "x")]
    out = chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, conv string"))
    got = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).collect()
    whole = max((r for r in got if r.conv_id == 1), key=lambda r: r.n_context)
    assert [t.text for t in whole.turns] == [t or "" for t in said]
    assert [r.loss for r in sorted((r for r in got if r.conv_id == 1 and r.target is not None), key=lambda r: r.target)] == [t or "" for t in said[1::2]]
    assert [(t.role, t.text) for r in got if r.conv_id == 2 for t in r.turns] == [("", ""), ("us\ner%0A<|", "q")]
    assert sorted((r.target, r.n_context, r.loss) for r in got if r.conv_id == 3) == [(0, 0, "same"), (1, 1, "same")]
    assert chat.format_examples(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


@pytest.mark.parametrize("part", [2, jaccard.PART])
def test_jaccard(spark, monkeypatch, part):
    """Against all pairs; with small parts, hubs and buckets are dealt out many times over."""
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "BUCKET_PART", part)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(12)]
    passage = [f"p{i}" for i in range(40)]
    rows, n = list(AWKWARD), 100
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                w = w + passage
            rows.append((n, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            n += 1
    # Ids of several texts: one that joins two classes, two that share their least id's texts, one that stands alone.
    rows += [(400, " ".join(base[0])), (400, " ".join(base[1])), (400, " ".join(base[1])), (401, " ".join(base[2])), (402, "u1 u2 u3 u4 u5 u6"), (402, "v1 v2 v3 v4 v5 v6"), (403, "v1 v2 v3 v4 v5 v6"), (404, "u1 u2 u3 u4 u5 u6"), (405, None), (405, "t1 t2")]

    def shingles(t):
        w = WORD.findall((t or "").translate(LOW))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert find(403) == find(404) == 402
    got = jaccard.jaccard_classes(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(x)) for i, x in sets)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id) if r.n_shingles else r.doc_id)
    assert jaccard.jaccard_classes(table(spark, [])).count() == 0


def ranks():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe(spark):
    import tiktoken

    known = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rng = random.Random(1)
    rows = [*AWKWARD, (30, "ab" * 3000), (31, "".join(rng.choice("abcdeßé½ \t\n'sÀ日") for _ in range(3000))), (32, "<|endoftext|> I'll don't 'S ١٢")]
    got = bpe.bpe_roundtrip(table(spark, rows), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == known.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.node == "keep"


def test_ids_of_other_types(spark):
    """Whole numbers as text are ids; other text is refused by the operators that compare ids by size, taken by the classifiers."""
    named = spark.createDataFrame([("d1", "a b c d e f"), ("d2", "a b c d e f")], "doc_id string, text string")
    whole = spark.createDataFrame([("7", "a b c d e f"), ("12", "a b c d e f")], "doc_id string, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_classes(whole).collect()} == {7} and decontam.contaminated(whole, bench).count() == 2
    for run in (lambda: jaccard.jaccard_classes(named), lambda: decontam.contaminated(named, bench)):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            run().collect()
    labels = spark.createDataFrame([("d1", 1, 0), ("d2", 0, 1)], "doc_id string, quality int, toxic int")
    for module in (quality_model, toxicity):
        assert named.select(module.score(named, module.fit(named, labels))).count() == 2


def test_empty_tables_and_odd_names(spark):
    """No rows give no rows; a text column with a dot in its name is read like any other."""
    path, model = public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model")
    empty = table(spark, [])
    assert bpe.bpe_roundtrip(empty, path, public.PATTERN).count() == tokens.count_tokens(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert empty.select(quality_model.score(empty, quality_model.fit(empty, labels))).count() == empty.select(toxicity.score(empty, toxicity.fit(empty, labels))).count() == 0
    odd = spark.createDataFrame([(1, "a b", "mine")], "`doc.id` long, `my.text` string, both string")
    (row,) = bpe.bpe_roundtrip(odd, path, public.PATTERN, text="my.text").collect()
    assert row.both == "mine" and bytes(row.decoded) == b"a b"
    assert [r.n_tokens for r in tokens.count_tokens(odd, model, text="my.text").collect()] == [2]
    assert [r.n_words for r in licenses.license_scan(odd, "doc.id", "my.text").collect()] == [2]
    assert [r.component_id for r in jaccard.jaccard_classes(odd, "doc.id", "my.text").collect()] == [1]
    assert [r.kept for r in quality_rules.quality_cascade(odd, text="my.text").collect()] == [False]
    assert [r["my.text"] for r in lines.drop_shared_lines(odd, "doc.id", "my.text").collect()] == ["a b"]


def test_bpe_merge_against_a_plain_scan():
    known = ranks()

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((known[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known), default=None)
            if best is None:
                return [known[x] for x in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(9)
    pairs = bpe.byte_pairs(known)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aabtheion \xc3\xa9\xff0") for _ in range(rng.randrange(1, 30)))
        assert bpe.merge(piece, known, pairs) == plain(piece)


def test_bpe_slices():
    column = pa.array(["x" * 5, None, "", "y" * 100, "z" * 3, "w" * 3])
    parts = list(bpe.slices(column, 8))
    assert [x for p in parts for x in p.to_pylist()] == column.to_pylist() and [len(p) for p in parts] == [3, 1, 2]
    assert list(bpe.slices(pa.array([], pa.string()))) == []


def test_bpe_cache_generations():
    own = bpe.Codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, cached=3)
    text = " ".join(f"w{i % 7}" for i in range(60))
    assert own.decode([int.from_bytes(own.encode(text)[i : i + 4], "little") for i in range(0, len(own.encode(text)), 4)]) == text.encode() and len(own.cache) <= 3


def test_bpe_cache_bytes():
    """Long pre-tokens of a wide script take far more than short ones: the cache is bounded by bytes too, and the ids are the same."""
    most, rng = 1 << 16, random.Random(4)
    own, free = (bpe.Codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, most=n) for n in (most, 1 << 30))
    for _ in range(300):
        text = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60)) for _ in range(3))
        assert own.encode(text) == free.encode(text) and own.decode([int.from_bytes(own.encode(text)[i : i + 4], "little") for i in range(0, len(own.encode(text)), 4)]) == text.encode()
        for kept in (own.cache, own.cache.old):
            assert sum(sys.getsizeof(x) for entry in kept.items() for x in entry) + sys.getsizeof(kept) <= most
    assert own.cache.old and not free.cache.old


def test_lines(spark):
    long = "A shared line of more than twenty"
    rows = [(1, f"{long}\nown"), (2, f" {long.upper()} \n{long}\nb"), (3, f"c\n{long}"), (4, "short\nshort"), (5, "short"), (6, "short"), (7, f"twice is no three documents\n{'z' * 25}"), (8, "z" * 25), (8, "z" * 25), (9, None), (10, ""), (None, long)]
    got = lines.drop_shared_lines(table(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
        assert r.h == "keep"
    assert by[1] == [("own", 2, 1)] and by[2] == [("b", 3, 2)] and by[3] == [(f"c\n{long}", 2, 0)] and by[None] == [("", 1, 1)]
    assert by[4] == [("short\nshort", 2, 0)] and by[8] == [("z" * 25, 1, 0)] * 2 and by[9] == by[10] == [("", 1, 0)]
    assert lines.drop_shared_lines(table(spark, [])).count() == 0
    odd = lines.drop_shared_lines(table(spark, rows).withColumn("a.b", F.lit("dot")).withColumn("_drop", F.lit("mine")).withColumn("pos", F.lit("mine")))
    assert {(r["a.b"], r["_drop"], r.pos) for r in odd.collect()} == {("dot", "mine", "mine")}


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_lines_of_hot_hashes(spark, monkeypatch, hot):
    """Whatever share of the hashes is broadcast, the rest is found by the shuffle."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(6)
    common = [f"line number {i} that documents share" for i in range(12)]
    rows = [(i, "\n".join([common[0], *(rng.choice(common) + " " * rng.randrange(2) for _ in range(rng.randrange(6))), f"own line of document {i} alone"])) for i in range(60)]
    docs = {}
    for i, t in rows:
        for line in t.split("\n"):
            docs.setdefault(line.strip(), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(docs[x.strip()]) < 3 or max(docs[x.strip()]) == i) for i, t in rows}
    assert {r.doc_id: r.text for r in lines.drop_shared_lines(table(spark, rows)).collect()} == want


def test_licenses(spark):
    mit = dict(licenses.TEMPLATES)["mit"]
    gap = mit.split()
    gap = " ".join(gap[:20] + ["really", "very"] + gap[20:])
    rows = [*AWKWARD, (40, "Under the MIT-License, under the\nmit license"), (41, "Apache License, Version 2.0 and CC BY-NC"), (42, f"x {gap} y"), (43, "under the mit"), (44, "cc by nc " * 3), (45, "all rights reserved " * 30)]
    got = {(r.doc_id, r.n_words): r for r in licenses.license_scan(table(spark, rows)).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert (by[40].n_base, by[40].first_word, by[40].last_word, by[40].base_labels) == (2, 0, 4, "mit")
    assert by[41].base_labels == "apache-2,cc-by-nc" and (by[41].first_word, by[41].last_word) == (0, 6)
    assert by[42].n_base == 0 and by[42].labels == "mit" and 0.6 < by[42].score <= 1 and by[42].first_word is None
    assert by[43].labels == "" and by[43].score == 0 and by[44].n_base == 3
    assert by[45].labels == "" and by[45].score == 0  # one k-gram, however often, is no template
    assert by[1].n_words == 0 and by[8].n_words == 40000
    assert licenses.license_scan(table(spark, rows)).count() == len(rows)


def test_licenses_in_portions(spark, monkeypatch):
    """A library of more k-grams than are broadcast at once takes several passes, with the same result."""
    rng = random.Random(2)
    pieces = [w for _, t in licenses.TEMPLATES for w in (t.split()[:30], t.split()[5:])] + [p.split() for p in licenses.PHRASES]
    docs = table(spark, [(i, " ".join(x for _ in range(3) for x in [*rng.choice(pieces), "and", "so"])) for i in range(40)] + AWKWARD)
    whole = sorted(map(repr, licenses.license_scan(docs).collect()))
    monkeypatch.setattr(licenses, "GRAMS", 30)
    every = (*((x, p, True) for p, x in licenses.PHRASES.items()), *((x, t, False) for x, t in licenses.TEMPLATES))
    parts = licenses.portions(every)
    assert len(parts) > 3 and tuple(t for _, p in parts for t in p) == every and [n for n, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    assert sorted(map(repr, licenses.license_scan(docs).collect())) == whole


def test_licenses_against_brute_force(spark):
    """Texts put together from pieces of templates, in and out of order, against plain diagonals."""
    every = [*((x, p.split(), True) for p, x in licenses.PHRASES.items()), *((x, t.split(), False) for x, t in licenses.TEMPLATES)]
    rng = random.Random(4)

    def text():
        out = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(every)[1]
            a = rng.randrange(len(w)) if rng.random() < 0.4 else 0
            piece = w[a : a + rng.choice([3, 8, 20, 200])]
            for _ in range(rng.choice([0, 0, 1, 3])):
                if rng.random() < 0.5:
                    piece = [*piece[: len(piece) // 2], "new", *piece[len(piece) // 2 :]]
                else:
                    piece = piece[: len(piece) // 3] + piece[len(piece) // 3 + 1 :]
            if rng.random() < 0.15:
                piece = piece[::-1]
            out += piece * rng.choice([1, 1, 1, 2, 6]) + ["x", "y"] * rng.choice([0, 1, 30])
        return " ".join(out)

    def brute(t):
        w, spans = (t or "").split(), []
        for label, template, exact in every:
            hits = [(i, j) for i in range(len(w) - 2) for j in range(len(template) - 2) if w[i : i + 3] == template[j : j + 3]]
            need, group = len(template) - 2, {}
            for d in sorted({i - j for i, j in hits}):
                if exact or not group or d - last > licenses.DRIFT:
                    first = d
                group.setdefault(first, []).extend(h for h in hits if h[0] - h[1] == d)
                last = d
            for first, some in group.items():
                some.sort()
                forward = 1 + sum(b[1] > a[1] for a, b in zip(some, some[1:]))
                found = min(forward, len({j for _, j in some}))
                if some[-1][0] - some[0][0] + 1 > 2 * need:
                    found = max(sum(i - j == d for i, j in some) for d in {i - j for i, j in some})
                if found >= (need if exact else licenses.COVERAGE * need):
                    spans.append((exact, label, max(first, 0), found / need))
        base = [x for x in spans if x[0]]
        at = [x[2] for x in base]
        return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x[1] for x in base})), ",".join(sorted({x[1] for x in spans})), max((x[3] for x in spans), default=0.0)

    rows = [(i, text()) for i in range(300)] + [(300, None), (301, ""), (302, "cc by")]
    got = licenses.license_scan(table(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in rows} and len(got) == len(rows)
    assert sum(r.labels != r.base_labels for r in got) > 30  # the voting adds labels of its own
    assert licenses.license_scan(table(spark, [])).count() == 0


def test_tokens(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rows = [*AWKWARD, (50, "a  b\n\n c ▁d▁▁e <s></s> \t"), (51, " lead"), (52, "trail "), (53, "\n"), (54, "word " * 5000)]
    got = tokens.count_tokens(table(spark, rows), public.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(sp.encode(r.text or "")) and r.over_limit == (r.n_tokens > 4096)


def test_token_counter_in_any_order():
    """One counter with a small cache over many texts: no text's count may hang on what came before."""
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    parts = ["see", "river", "stone", "x", "\n", " ", "  ", "\n\n", " \n", "\n ", "\t", "é", "日本", "🙂", "▁", "▁▁", "<s>", "</s>", "\x00", "\r\n", "ﬁ", "\u00a0", "\u3000", "\u200b", "word", "12", ".", "\ufeff", "\x7f", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)] + ["see\nriver", "x \nriver stone"]
    for first in ({}, {"see": len(sp.encode("see")), "river": len(sp.encode("river"))}):
        own = tokens.Counter_(path, first, cached=300)
        rng.shuffle(texts)
        assert [t for t in texts if own.count(t) != len(sp.encode(t))] == []


def test_frequent_lengths(spark):
    path = public.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(" ".join(["often"] * 9 + [f"w{i}", "some\nline"]),) for i in range(50)] + [(None,), ("",)], "text string").repartition(5)
    words_, lengths = tokens.frequent_lengths(df, "text", path, frequent=3, a_task=2)
    assert "often" in words_.split("\x00") and "\n" not in words_ and len(lengths) == len(words_.split("\x00")) <= 3
    assert tokens.frequent_lengths(df.limit(0), "text", path) == ("", b"")


def test_pieces():
    texts = [b"", b"a b", b"word " * 200000, b"x" * 700000 + b" y", b" "]
    h, bounds = words.hashed_words(texts)
    assert [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [0, 2, 200000, 2, 0]
    assert len(set(h[2:200002].tolist())) == 1


def test_queries_match_their_sql(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        columns = sorted(got.columns)
        mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
        assert mine == sorted(repr(r) for r in con.sql(sql).project(", ".join(columns)).fetchall()), name
