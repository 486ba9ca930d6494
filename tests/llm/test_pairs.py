"""Embedding near-dedup (op2), Jaccard join (op5), decontamination (op6): brute force and edge cases."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, embedding_dedup, jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def brute_jaccard(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    lists = {}
    for k, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(k)
    links = []
    for k, s in enumerate(sets):
        for x, o in Counter(x for g in s for x in lists[g] if x < k).items():
            if 100 * o >= 75 * (len(s) + len(sets[x]) - o):
                links.append((k, x))
    root, least = components(len(docs), links), {}
    for k, (i, _) in enumerate(docs):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, len(sets[k]), least[root[k]]) for k, (i, _) in enumerate(docs))


def near_copies(seed=5):
    """Groups of copies and near copies from two to dozens, short and empty texts, a shared passage."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for group, size in enumerate([2, 3, 5, 40, 70]):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    docs += [" ".join([rng.choice(vocab) for _ in range(30)] + shared + [rng.choice(vocab) for _ in range(30)]) for _ in range(40)]
    docs += ["", None, " \t ", "one two", "One  TWO", "one two three four", "a b c d e", "A b\tc d e", docs[0], docs[0]]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block, members", [(3 << 18, 512), (500, 512), (3 << 18, 8)])
def test_jaccard_brute_force(spark, monkeypatch, block, members):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    docs = near_copies()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, node string, n_shingles int").repartition(5)
    got = sorted(map(tuple, jaccard_join.components(df).collect()))
    assert got == brute_jaccard(docs)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, _, c in got if i == c}


def test_jaccard_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.components(spark.createDataFrame([], schema)).count() == 0
    long = "word%d " * 50000 % tuple(range(50000))
    rows = [(7, long), (9, long + "more"), (None, "a b c d e f"), (3, "q r s t u v"), (3, "q r s t u v"), (2, None)]
    got = {tuple(r) for r in jaccard_join.components(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(7, 49996, 7), (9, 49997, 7), (None, 2, None), (3, 2, 3), (2, 0, 2)}
    assert jaccard_join.one_of_each(spark.createDataFrame(rows, schema)).count() == 4


@pytest.mark.parametrize("marked", [2_000_000, 0])
def test_one_of_each_of_odd_rows(spark, monkeypatch, marked):
    """Ids that repeat with other texts, null ids, equal texts, null texts and clashing columns."""
    monkeypatch.setattr(jaccard_join, "MARKED", marked)
    say = lambda k: " ".join(f"s{k}w{i}" for i in range(40))
    rows = [(5, say(1), "a"), (3, say(1), "b"), (8, say(2), "c"), (8, say(3), "d"), (8, say(3), "d"), (9, say(2) + " end", "e"), (None, say(1), "f"), (None, None, "g"), (1, None, "h"), (2, "", "i"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = [{(r["doc_id"], r["node"]) for r in jaccard_join.one_of_each(df.repartition(n)).collect()} for n in (1, 4)]
    assert got[0] == got[1] and got[0] - {(8, "c"), (8, "d")} == {(3, "b"), (None, "f"), (None, "g"), (1, "h"), (2, "i"), (4, None)}
    assert jaccard_join.one_of_each(df).count() == 7


@pytest.mark.parametrize("bits", [22, 3])
def test_copies_in_several_blocks(spark, monkeypatch, bits):
    """Copies, copies in other case and near copies that lie in different blocks; with a bitmap that is full, too."""
    monkeypatch.setattr(jaccard_join, "TWIN_BITS", bits)
    say = lambda k: " ".join(f"s{k}w{i}" for i in range(60))
    docs = list(enumerate([say(1)] * 6 + [say(2), say(2).upper(), say(2) + " end"] + [say(3), say(3).upper()] + [say(k) for k in range(4, 30)]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(len(docs), "doc_id")
    assert sorted(map(tuple, jaccard_join.components(df).collect())) == brute_jaccard(docs)
    # copies alone are no partners of a class
    classes = jaccard_join.class_table(df.where("doc_id < 6 or doc_id > 10"))
    assert classes.agg(F.count("node")).first()[0] > 26 and not classes.where("toks is not null").count()


def test_shingles_take_as_many_bytes_in_many_buckets(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    monkeypatch.setattr(jaccard_join, "TaskContext", Task)
    texts = [b" ".join(b"%d-%d" % (k, i) for i in range(64)) for k in range(500)]
    size = []
    for buckets in (4, 400):
        block = jaccard_join._Block(buckets, 1)
        block.add(list(range(500)), texts, [False] * 500)
        rows = block.rows()
        size.append(sum(len(x) for c in "abc" for x in rows.column(c).to_pylist()))
    assert size[1] <= 1.1 * size[0] and size[1] < 12 * 500 * 60


def test_half_of_the_shingles_move(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    monkeypatch.setattr(jaccard_join, "TaskContext", Task)
    block = jaccard_join._Block(4, 1)
    block.add(list(range(500)), [b" ".join(b"%d-%d" % (k, i) for i in range(64)) for k in range(500)], [False] * 500)
    rows = block.rows().to_pylist()
    assert sum(len(r["a"]) // 8 for r in rows if r["kind"] == 2) == 500 * 30


@pytest.mark.parametrize("whole", [False, True])
def test_partners_keep_a_hub(whole):
    """Of all pairs that link, and however many shingles they share with others; chance alone keeps none."""
    rng = np.random.default_rng(6)
    common_ones = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for group in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64)
        for _ in range(rng.integers(1, 6)):
            own = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.12])]
            more = rng.choice(common_ones, len(base) // rng.integers(6, 40))
            sets.append(np.unique(np.concatenate([own, more, rng.integers(0, 2**63, len(base) // 20 + 1, dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    g, size = (np.concatenate(sets), n) if whole else jaccard_join.prefixes(np.concatenate(sets), n)
    at, label, least, times = np.repeat(np.arange(len(n)), size), rng.permutation(len(n)), {}, Counter(g.tolist())
    for k, t in zip(at, g.tolist()):
        least[t] = min(least.get(t, len(n)), label[k])
    some = np.array([times[t] > 1 for t in g.tolist()])
    own, hub = jaccard_join.heavy_hubs(at[some], np.array([least[t] for t in g.tolist()])[some], n, whole)
    kept = [set(hub[own == k].tolist()) for k in range(len(n))]
    links = [(j, k) for k in range(len(n)) for j in range(k) if 7 * len(np.intersect1d(sets[j], sets[k])) >= 3 * (n[j] + n[k])]
    assert len(links) > 30 and all(kept[j] & kept[k] for j, k in links)
    assert sum(map(len, kept)) < 0.1 * some.sum()


def test_chance_does_not_join_groups(spark, monkeypatch):
    """Pairs of near copies in a chain: each has a phrase in common with the next; searched apart, by few queries at a time."""
    monkeypatch.setattr(jaccard_join, "ASKS", 1)
    say = lambda k: " ".join(f"s{k}w{i}" for i in range(80)) + f" this phrase joins {k} and {k} then this phrase joins {k + 1} and {k + 1}"
    docs = list(enumerate([t for k in range(40) for t in (say(k), say(k) + " end")]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    groups = jaccard_join.class_table(df).where("toks is not null").groupBy("grp").count().collect()
    assert sorted(r["count"] for r in groups) == [2] * 40
    assert sorted(map(tuple, jaccard_join.components(df).collect())) == brute_jaccard(docs)


def test_materialize_leaves_no_shuffle_files(spark):
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" ")))
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(key, None)
    out = common.materialize(spark.range(0, 100000, 1, 4).groupBy(F.expr("id % 1000")).count(), "counted")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000 and spark.conf.get(key, None) == was


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 200), rng.integers(0, 2**60, 5, dtype=np.uint64)])) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    lists = jaccard_join.Lists(n, sets)
    for k, s in enumerate(sets):
        want = [j for j, t in enumerate(sets) if 7 * len(np.intersect1d(s, t)) >= 3 * (len(s) + len(t))]
        assert lists.partners(s, len(s)).tolist() == want, k


def test_pack_round_trip():
    g = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (jaccard_join.unpack(jaccard_join.pack(g)) == g).all()


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 1), (2, None)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()))
    full = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    root, least = components(1200, full), {}
    for k in range(1200):
        least.setdefault(root[k], k)
    assert got == {k: least[root[k]] for k in {x for e in full for x in e}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    x[50:150] = x[0] + rng.normal(size=(100, 16)) * 0.25 * np.linalg.norm(x[0]) / 4
    x[200:220] = x[5]
    x[220:230] = x[6] * 3
    return x


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = vectors()
    df = spark.createDataFrame([(k, v.tolist(), 1, "clash") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    found, all_links = sum(r["n_links"] for r in got.values()), near.sum() - len(x)
    assert len(got) == len(x) and found >= 0.98 * all_links
    assert all(r["n_links"] <= near[k].sum() - 1 for k, r in got.items())
    root = components(len(x), np.argwhere(near))
    least = {}
    for k in range(len(x)):
        least.setdefault(root[k], k)
    assert np.mean([got[k]["component_id"] == least[root[k]] for k in range(len(x))]) > 0.98
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, None), (7, [0.0, 0.0]), (8, [1.0, nan]), (9, [inf, 1.0]), (10, [1.0, None]), (11, []), (12, [1.0, 2.0, 0.0]), (None, [2.0, 4.0]), (4, [-0.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    alone = {(i, 0, i): 1 for i in (6, 7, 8, 9, 10, 11, 12)}
    assert got == Counter({(5, 2, 5): 2, (None, 2, 5): 1, (4, 1, 3): 1, (3, 1, 3): 1, **alone})
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_blocks_and_strips_agree(monkeypatch):
    """Counts and components of all strips, within a block and between two, against the whole matrix."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(80, 8)), np.repeat(rng.normal(size=(3, 8)), 40, axis=0) + rng.normal(size=(120, 8)) * 0.15])
    size, code = rng.integers(1, 5, len(x)), rng.integers(0, 2, (len(x), 2))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool) & (code[:, None, 0] != code[None, :, 0])
    for strip in (7, 512):
        monkeypatch.setattr(embedding_dedup, "STRIP", strip)
        every = np.arange(len(x))
        n, label = embedding_dedup.compare(x, code, size, 1, every, every)
        assert (n == near @ size).all() and len(set(label)) == len(set(components(len(x), np.argwhere(near))))
        left, right = every[::2], every[1::2]
        n, label = embedding_dedup.compare(x, code, size, 1, left, right)
        apart = near & (every[:, None] % 2 != every[None] % 2)
        assert (n == apart @ size).all() and len(set(label)) == len(set(components(len(x), np.argwhere(apart))))


def test_plan_keeps_recall():
    for n in (10, 1000, 10**6, 10**9):
        bits, tables = embedding_dedup.plan(n)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= embedding_dedup.MISS * 1.001


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_brute_force():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(1, 6, rng.integers(1, 20), dtype=np.uint64), rng.integers(1, 6, rng.integers(1, 40), dtype=np.uint64)) for _ in range(200)]
    score, _ = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    assert score.tolist() == [smith_waterman(a, b) for a, b in pairs]


def test_decontamination(spark):
    rng = random.Random(2)
    vocab = [f"v{k}" for k in range(500)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(30) for _ in range(20)]
    docs = [(k, " ".join(say(rng.randint(1, 200)))) for k in range(60)]
    planted = set()
    for k in range(20):
        w = [x for x in items[k] if rng.random() > 0.1]
        w = [rng.choice(vocab) if rng.random() < 0.1 else x for x in w]
        docs.append((100 + k, " ".join(say(rng.randint(0, 300)) + [x.upper() + "," for x in w] + say(20))))
        planted.add((100 + k, k))
    docs += [(None, " ".join(items[3])), (200, None), (201, ""), (202, "v1"), (203, "yes no"), (204, " ".join(say(60000)))]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    bench = [(k, " ".join(w), "c") for k, w in enumerate(items)] + [(50, None, "c"), (51, "", "c"), (52, "Yes no!", "c"), (52, "Yes no!", "c")]
    b = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(df, b).collect())
    assert set(got) == planted | {(None, 3), (203, 52)} and got[203, 52] == 2
    clean = decontaminate.clean_documents(df, b)
    assert clean.columns == df.columns and {r[0] for r in clean.select("doc_id").collect()} == set(range(60)) | {200, 201, 202, 204}
    assert decontaminate.contaminated_pairs(df, b.where("false")).count() == 0
    assert decontaminate.contaminated_pairs(df.where("false"), b).count() == 0


def test_no_copy_is_lost():
    """All of random edits, regular ones among them, against the full alignment: the bound on hits holds."""
    rng = random.Random(11)
    items = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 45))] for _ in range(30)]
    texts, texts_words = [], []
    for item in items:
        copies = [[w for k, w in enumerate(item) if k % 3 != j] for j in range(3)]
        copies += [[f"x{k}" if k % 3 == j else w for k, w in enumerate(item)] for j in range(3)]
        copies += [[x for k, w in enumerate(item) for x in ([w, f"y{k}"] if k % n == 0 else [w])] for n in (1, 2, 3)]
        for rate in (0.1, 0.2, 0.3, 0.4, 0.6):
            for _ in range(6):
                copies.append([x for w in item for x in ([w] if rng.random() > rate else rng.choice([[], ["z"], [w, "z"], ["z", w]]))])
        for c in copies:
            around = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 60))] for _ in range(2)]
            texts_words.append(around[0] + c + around[1])
            texts.append(" ".join(texts_words[-1]).encode())
    finder = decontaminate.Finder(decontaminate._items([(k, " ".join(w).encode()) for k, w in enumerate(items)]))
    thinned = decontaminate._items([(k, " ".join(w).encode()) for k, w in enumerate(items)])
    thinned.thin(np.random.default_rng(1).integers(1, 9, len(thinned.gram)))
    found = {(d, k): s for d, k, s, *_ in decontaminate.contaminations(finder, texts)}
    assert {(d, k): s for d, k, s, *_ in decontaminate.contaminations(decontaminate.Finder(thinned), texts)} == found
    hashes = [common.word_hashes([t])[1] for t in texts]
    want = {}
    for k, item in enumerate(finder.items.words):
        score, _ = decontaminate.align([item] * len(texts), hashes)
        want.update({(d, k): s / (2 * len(item)) for d, s in enumerate(score) if s >= len(item)})
    assert set(found) == set(want) and all(abs(found[x] - want[x]) < 1e-9 for x in want) and len(want) > 600


def test_edited_copies_of_a_hot_item(spark):
    """A verbatim copy makes most n-grams rare; those that many edited copies hold stay seeds."""
    item = [f"h{k}" for k in range(40)]
    edited = [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    docs = [(0, " ".join(item))] + [(k, f"before{k} " + " ".join(edited) + " after") for k in range(1, 1001)]
    docs += [(2000, "h0 h1 h2 and h10 h11 h12 but nothing else")]
    assert decontaminate.hits_needed(4) == 1 and decontaminate.hits_needed(40) == 13
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["similarity"] for r in decontaminate.contaminated_pairs(df, b).collect()}
    assert set(got) == set(range(1001)) and got[0] == 1 and 0.7 < got[7] < 0.72
    assert {r[0] for r in decontaminate.clean_documents(df, b).select("doc_id").collect()} == {2000}


def test_windows_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    say = lambda n: [f"u{rng.randrange(60)}" for _ in range(n)]
    items = [say(25) for _ in range(30)]
    texts = [" ".join(say(80) + [w for w in items[k] if rng.random() > 0.15] + say(80)).encode() for k in range(30)]
    finder = decontaminate.Finder(decontaminate._items([(k, " ".join(w).encode()) for k, w in enumerate(items)]))
    whole = decontaminate.contaminations(finder, texts)
    assert {(k, k) for k in range(30)} <= {(d, k) for d, k, *_ in whole}
    monkeypatch.setattr(decontaminate, "BLOCK", 50)
    assert sorted(decontaminate.contaminations(finder, texts)) == sorted(whole)


def test_decontamination_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 200)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    bench = common.table(spark, "/root/testdata/sf0.001", "benchmark")
    sliced = {(r[0], r[1]) for r in decontaminate.contaminated_pairs(docs, bench.limit(6)).select("doc_id", "item_id").collect()}
    monkeypatch.undo()
    assert sliced == {(r[0], r[1]) for r in decontaminate.contaminated_pairs(docs, bench.limit(6)).select("doc_id", "item_id").collect()}
