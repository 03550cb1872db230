"""Near duplicates, mixing and the pipeline, against exact all-pairs similarity and plain water filling."""

import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sluice.llm import mixing, near_dedup
from sluice.llm.common import Scratch, release, shared_dir, table, written, written_so_far
from sluice.llm.mixing import Mixture, budgets, mix
from sluice.llm.queries import ORACLE_SQL, QUERIES, with_domain
from sluice.llm.shingles import Weights, shingles, weighted_jaccard, word_hashes
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def shingle_set(text):
    words = WORD.findall((text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_shingles_are_those_of_the_text():
    texts = ["", "One two", "a b c d e f a b c d e", "A b C d e", "é中 x—y z w v u", " . ", "x " * 300]
    hashes, times, counts = shingles([t.encode() for t in texts])
    ends = np.cumsum(counts)
    parts = [(hashes[a:b], times[a:b]) for a, b in zip(ends - counts, ends)]
    for (h, n), text in zip(parts, texts):
        words = WORD.findall(text.lower())
        assert len(h) == len(shingle_set(text)) and (np.diff(h.astype(object)) > 0).all()
        assert n.sum() == (max(1, len(words) - 4) if words else 0)
    assert parts[2][0][np.isin(parts[2][0], parts[3][0])].size == 1
    assert word_hashes([b"Ab aB", b"ab"])[0].tolist() == [word_hashes([b"ab"])[0][0]] * 3


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(8)
    base = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    one = rng.random(400).astype(np.float32) + 0.5
    for change in (0.05, 0.3, 0.8):
        other = np.where(rng.random(400) < change, one * 4, one).astype(np.float32)
        wanted = weighted_jaccard((base, one), (base, other))
        both, counts = np.concatenate([base, base]), np.array([400, 400])
        hits = [len(set(near_dedup.sample(both, np.concatenate([one, other]), counts, k))) == 1 for k in range(400)]
        assert abs(np.mean(hits) - wanted) < 0.09


def planted(spark):
    """Copies, near copies in a large group and a small one, a shared passage in texts that differ otherwise, short and odd texts."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    long = lambda n: [word() for _ in range(n)]
    base, small, passage = long(400), long(300), long(60)
    texts = [" ".join(long(200)) for _ in range(30)]
    texts += [texts[0]] * 5
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 400, 8)]
    texts += [" ".join([*small[: 30 * k], word(), *small[30 * k + 1 :]]) for k in range(3)]
    texts += [" ".join([*long(120), *passage, *long(120)]) for _ in range(25)]
    texts += ["", None, "one", "one", "one two", "ONE two", "a b c d e f g"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts


def components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (texts[i] or "") == (texts[j] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_are_those_of_all_pairs(spark):
    docs, texts = planted(spark)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)
    kept = near_dedup.dedup(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(texts))) and kept.columns == docs.columns


def test_near_duplicates_of_odd_rows(documents, odd, none):
    got = near_dedup.classes(odd)
    assert got.count() == odd.count() and near_dedup.classes(none).collect() == []
    same = {r["doc_id"]: r["class_id"] for r in got.where("doc_id is not null").collect()}
    assert same[5] == same[6] == 5 and same[8] == same[9] == 8
    kept = near_dedup.dedup(odd)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and kept.columns == odd.columns and near_dedup.dedup(none).collect() == []
    # Rows of one class: the null and empty texts; "one" twice; the long ones; the seven letters.
    assert len(rows) == len({r["text"] or "" for r in odd.collect()})
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    ids = sorted(texts)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents).collect()}
    assert [found[i] for i in ids] == [ids[c] for c in components([texts[i] for i in ids])]


def test_crowded_buckets_meet_two_drawn_nodes(spark):
    """Nodes that all share buckets but not their classes: each meets the same two, small buckets give all pairs."""
    rows = [(f"n{k:03}", b, 7 if b else k // 20) for k in range(60) for b in range(2)]
    met = spark.createDataFrame([(*r, 100.0 + k % 3) for k, r in enumerate(rows)], "node string, band int, value long, weight double")
    roots, scratch = spark.createDataFrame([], "node string, root string"), Scratch(spark)
    inside = {(f"n{a:03}", f"n{b:03}") for a, b in itertools.combinations(range(60), 2) if a // 20 == b // 20}
    pairs = {tuple(r) for r in near_dedup._between(met, roots, 0.8, scratch).collect()}
    assert {x for p in pairs & inside for x in p} == {f"n{k:03}" for k in range(60)} and len(pairs) < 60 * 2 * 4
    small = met.where("node < 'n010'")  # a bucket of few is compared in all pairs at once
    assert {tuple(r) for r in near_dedup._between(small, roots, 0.8, scratch).collect()} == {p for p in inside if p[1] < "n010"}
    folder = scratch.folder.removeprefix("file://")
    assert os.path.isdir(folder)
    scratch.clear()
    assert not os.path.exists(folder)


def chain(n, rng):
    """Each text has two words of the one before changed, in its last 80 of 200: neighbours are just alike, all share most bands."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    words, texts = [word() for _ in range(200)], []
    for _ in range(n):
        for k in rng.sample(range(120, 200), 2):
            words[k] = word()
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [512, 16])
def test_the_rest_of_crowded_buckets_is_compared(spark, monkeypatch, block):
    """Every pair of a crowded bucket that no drawn node joins, within and between blocks; two components to start with."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = chain(60, random.Random(4))
    nodes = [(f"n{k:03}", t) for k, t in enumerate(texts)]
    weights = spark.sparkContext.broadcast(near_dedup.frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    met = spark.createDataFrame([(n, 0, 7, 100.0 + 45 * (k % 2)) for k, (n, _) in enumerate(nodes)], "node string, band int, value long, weight double")
    roots = spark.createDataFrame([(n, "n000") for n, _ in nodes[:30]], "node string, root string")
    scratch = Scratch(spark)
    links = near_dedup._rest(met, roots, spark.createDataFrame(nodes, "node string, text string"), weights, 0.8, scratch)
    got = written(links, "links").collect()
    assert all(max(r["similarity"], r["plain"]) >= 0.8 and r["a"] < r["b"] for r in got)
    after = {r["node"]: r["root"] for r in near_dedup._joined(roots, written(links, "links"), scratch).collect()}
    assert after == {n: "n000" for n, _ in nodes} and set(components(texts)) == {0}


def test_large_groups_barely_alike_are_those_of_all_pairs(spark):
    """Texts of which all are nearly alike and two each are, in crowded buckets: classes against the links of all pairs."""
    r = random.Random(6)
    long = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    core, both = long(173), [long(22) for _ in range(300)]
    texts = r.sample([" ".join([*core, *x, *long(5)]) for x in both * 2], 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert [got[i] for i in range(600)] == components(texts) and len(set(got.values())) == 300


def test_texts_of_a_group_with_many_edits_lose_no_link(spark):
    """500 texts of 300 words, each with 4 to 11 words replaced: pairs of 0.8 or more stand in one class, by brute force."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base, texts = [word() for _ in range(300)], []
    for _ in range(500):
        words = list(base)
        for k in r.sample(range(300), r.randrange(4, 12)):
            words[k] = word()
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {d["doc_id"]: d["class_id"] for d in near_dedup.classes(docs).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(500), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    lost = sum(got[i] != got[j] for i, j in pairs)
    assert len(pairs) > 40 and lost <= 0.02 * len(pairs)


def test_weighted_links_are_those_of_all_pairs(spark):
    """Repeated passages and common shingles: every pair whose weighted similarity, computed one by one, is 0.8 or more."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    common, texts = [word() for _ in range(40)], []
    for _ in range(40):
        own = [word() for _ in range(r.randrange(60, 140))]
        for _ in range(4):
            edited = list(own)
            for k in r.sample(range(len(own)), r.randrange(0, 4)):
                edited[k] = word()
            texts.append(" ".join([*common, *edited, *edited[: r.randrange(0, 20)] * r.randrange(1, 3)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = near_dedup.frequencies(docs)
    got = {d["doc_id"]: d["class_id"] for d in near_dedup.classes(docs).collect()}
    found = [(h, weights.of(h, n)) for h, n, _ in (shingles([t.encode()]) for t in texts)]
    wanted = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if weighted_jaccard(found[i], found[j]) >= 0.8}
    assert len(wanted) > 30 and all(got[i] == got[j] for i, j in wanted)


def test_words_that_sums_of_powers_confuse():
    def thue(n, a, b):
        return "".join((a, b)[k.bit_count() & 1] for k in range(n)).encode()

    words = [thue(n, *p) for n in (8, 64, 512, 1024, 2048, 4096) for p in ("ab", "ba")] + [b"a" * k for k in range(1, 40)]
    assert len(set(word_hashes([b" ".join(words)])[0].tolist())) == len(words)


def test_frequencies_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, f"common words in every text here {i} {i * 7} {i * 11} {i * 13} end") for i in range(500)], "doc_id long, text string")
    weights = near_dedup.frequencies(docs)
    common, rare = (shingles([t])[0] for t in (b"common words in every text", b"1 2 3 4 5"))
    assert weights.of(common, np.ones(1))[0] < 0.55 and weights.of(rare, np.ones(1))[0] > 0.9
    assert isinstance(weights, Weights)


def test_released_tables_are_gone(spark):
    folders = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("released-")}
    zero = written(spark.range(0), "released-0")
    since = written_so_far()
    one, two = (written(spark.range(k), f"released-{k}") for k in (1, 2))
    assert len(folders()) == 3
    release(spark, two, since)
    assert len(folders()) == 2 and two.count() == 2 and zero.count() == 0


# Mixing


def fill(budget, items):
    out, open_ = {n: 0.0 for n, _, _ in items}, [i for i in items if i[1] > 0]
    while open_:
        level = budget / sum(w for _, w, _ in open_)
        full = [i for i in open_ if i[2] <= level * i[1]]
        if not full:
            return out | {n: level * w for n, w, _ in open_}
        for n, _, cap in full:
            out[n], budget = cap, budget - cap
        open_ = [i for i in open_ if i not in full]
    return out


def plain_budgets(leaves, mixture):
    def usable(leaf):
        return all(mixture.weights.get(c, {}).get(v, 1.0) > 0 for c, v in zip(mixture.tree, leaf))

    def down(level, under, budget):
        if level == len(mixture.tree):
            return {under: budget}
        names = sorted({k[level] for k in leaves if k[:level] == under})
        cap = lambda n: sum(t * mixture.max_epochs for k, t in leaves.items() if k[: level + 1] == (*under, n) and usable(k))
        shares = fill(budget, [(n, mixture.weights.get(mixture.tree[level], {}).get(n, 1.0), cap(n)) for n in names])
        return {k: v for n in names for k, v in down(level + 1, (*under, n), shares[n]).items()}

    most = sum(t * mixture.max_epochs for k, t in leaves.items() if usable(k))
    return down(0, (), min(most, mixture.share * sum(leaves.values())))


@pytest.mark.parametrize(
    "mixture",
    [
        Mixture(("d", "l"), {"d": {"a": 3.0}}, 0.5, max_epochs=1),
        Mixture(("d", "l"), {"d": {"a": 1000.0}, "l": {"x": 5.0}}, 1.2, max_epochs=2),
        Mixture(("d", "l"), {"d": {"b": 0.0}}, 5.0, max_epochs=1),
        Mixture(("d", "l"), {}, 0.0),
    ],
)
def test_budgets_are_water_filling(spark, mixture):
    r = random.Random(1)
    leaves = {(d, x): r.choice([1, 10, 100, 5000]) for d in "abc" for x in "xyz"}
    rows = budgets(spark.createDataFrame([(*k, t) for k, t in leaves.items()], "_0 string, _1 string, _tokens long"), mixture).collect()
    wanted = plain_budgets(leaves, mixture)
    assert all(abs(r["_budget"] - wanted[r["_0"], r["_1"]]) <= 1 for r in rows) and len(rows) == len(leaves)


def test_mixes_take_prefixes_of_seeded_epochs(spark, documents):
    mixture = Mixture(weights={"lang": {"en": 3.0}}, share=0.9, max_epochs=3, seed=5)
    docs = with_domain(documents)
    out = mix(docs, mixture).toPandas()
    assert list(out.columns) == [*docs.columns, "_epoch"]
    sizes = docs.select(*mixing._leaf(mixture), "doc_id", mixing.words_and_end(mixing.text_of()).alias("n"), mixing._digits(mixing.F.concat_ws(":", mixing.F.col("doc_id").cast("string"), "text")).alias("h")).toPandas()
    leaves = sizes.groupby(["_0", "_1", "_2"]).n.sum().to_dict()
    wanted = plain_budgets(leaves, mixture)
    keys = spark.createDataFrame(sizes).crossJoin(spark.range(4).withColumnRenamed("id", "e")).withColumn("_epochs", mixing.F.col("e")).select("doc_id", "e", mixing._key("h", mixture).alias("key")).toPandas()
    key = {(r.doc_id, r.e): r.key for r in keys.itertuples()}
    got = {(r[0], r[1]) for r in out[["doc_id", "_epoch"]].itertuples(index=False, name=None)}
    plan = set()
    for leaf, part in sizes.groupby(["_0", "_1", "_2"]):
        budget = int(wanted[leaf] + 1e-6)
        full, left = divmod(budget, int(leaves[leaf]))
        plan |= {(d, e) for d in part.doc_id for e in range(full)}
        for d, n in sorted(zip(part.doc_id, part.n), key=lambda x: key[x[0], full]):
            if n > left:
                break
            left -= n
            plan.add((d, full))
    assert got == plan and len(got) == len(out)


def test_mixes_are_those_of_the_sql(spark):
    folder = f"{DATA}/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    frame, wanted = QUERIES["op9_mixing"](spark, folder), duck.sql(ORACLE_SQL["op9_mixing"])
    assert frame.columns == wanted.columns
    assert sorted(map(tuple, frame.collect())) == sorted(wanted.fetchall())


def test_mixes_of_odd_rows(odd, none):
    mixture = Mixture(tree=("lang", "label"), share=2.0, max_epochs=2)
    assert mix(odd, mixture).count() == 2 * odd.count() and mix(none, mixture).collect() == []
    assert mix(odd, Mixture(tree=("lang",), share=0.0)).collect() == []
    named = odd.withColumn("_epoch", mixing.F.lit("mine")).withColumn("_nth", mixing.F.lit(7)).withColumn("_row", mixing.F.lit(8))
    out = mix(named, mixture)
    assert out.columns == [*(c for c in named.columns if c != "_epoch"), "_epoch"] and out.where("_epoch not in (0, 1)").isEmpty()
    whole = mix(named, mixture, epoch=None)
    assert whole.columns == named.columns and whole.where("_epoch = 'mine' and _nth = 7").count() == 2 * odd.count()


# The pipeline


def test_pipeline_runs_whole(spark, data, documents):
    docs, seen = table(spark, data, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, data), name)
        assert docs.columns == documents.columns
        seen.append((name, before.count(), docs.count()))
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    by = {name: (a, b) for name, a, b in seen}
    assert by["secret_scans"][0] == by["secret_scans"][1] and all(a > b for n, (a, b) in by.items() if n != "secret_scans")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, data).toPandas()
    columns = list(packed.columns)
    assert packed.sort_values(columns[:2])[columns[:5]].values.tolist() == again.sort_values(columns[:2])[columns[:5]].values.tolist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "secret_scans", "mixing", "best_fit_packing"]
