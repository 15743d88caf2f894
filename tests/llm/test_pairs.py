"""Jaccard and cosine joins against brute force, and the corpus pipeline."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np

from simgraph.llm import jaccard, lattice

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_classes(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    some = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    texts = []
    for n in (5, 8, 40, 120, 300):
        for _ in range(6):
            base = some(n)
            texts.append(base)
            for _ in range(r.randint(1, 5)):
                t = list(base)
                for _ in range(r.randint(0, max(1, n // 40))):
                    t[r.randrange(n)] = "edited" + str(r.randint(0, 99))
                texts.append(t)
    hot = some(150)
    for _ in range(40):
        t = list(hot)
        t[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
        texts.append(t)
    line = some(30)
    texts += [some(60) + line for _ in range(30)]
    return [" ".join(t) for t in texts] + ["", None, "one two", "one two", " \n", "one two three"]


def check_jaccard(spark, texts):
    ids = list(range(100, 100 + len(texts)))
    rows = [(i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)] + [(100, texts[0], 1, "x", 2), (None, texts[0], 1, "x", 2)]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, id int, sketch string, n int")).collect()
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    linked = [(a, b) for a, b in combinations(ids, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    comp, n = plain_classes(ids, linked), dict.fromkeys(ids, 0)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    for x in got:
        if x.id is None:
            assert x.class_id is None and x.n_links == 0
        else:
            assert (x.class_id, x.n_links) == (comp[x.id], n[x.id]), x
            assert sets[x.copy_of] == sets[x.id]


def test_jaccard_equals_brute_force(spark):
    check_jaccard(spark, corpus(1))


def test_jaccard_splits_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "TILE", 6)
    check_jaccard(spark, corpus(2))


def test_dense_pairs_become_groups():
    ok = np.zeros((40, 40), bool)
    ok[:12, :12] = True  # all of twelve
    ok[20:25, 20:25] = True  # too few to be many
    ok[30:36, 31:37] |= np.eye(6, dtype=bool)  # a chain
    ok |= ok.T
    i, j, dense = jaccard.pairs_and_groups(ok)
    assert sorted(zip(i[dense].tolist(), j[dense].tolist(), strict=True)) == [(k, 0) for k in range(1, 12)]
    assert {tuple(sorted(p)) for p in zip(i[~dense].tolist(), j[~dense].tolist(), strict=True)} == {(a, b) for a in range(12, 40) for b in range(a + 1, 40) if ok[a, b]}


def test_known_groups_are_not_told_again():
    ok = ~np.eye(40, dtype=bool)
    i, j, dense = jaccard.pairs_and_groups(ok, np.repeat([7, 8, 9, 7], 10))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(10, 0), (20, 0)] and dense.all()
    chain = np.eye(6, k=1, dtype=bool) | np.eye(6, k=-1, dtype=bool)
    i, j, dense = jaccard.pairs_and_groups(chain, np.array([1, 1, 2, 3, 3, 3]))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 2), (2, 3)] and not dense.any()


def test_near_copies_make_rows_in_proportion(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "SMALL", 64)
    monkeypatch.setattr(jaccard, "TILE", 32)
    brute = jaccard._brute

    def told(t, similarity):
        import uuid

        for b in brute(t, similarity):
            (tmp_path / f"{uuid.uuid4().hex}.{b.num_rows}").touch()
            yield b

    monkeypatch.setattr(jaccard, "_brute", told)
    r = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(300):
        t = list(base)
        t[r.randrange(200)] = f"e{k}"
        texts.append(" ".join(t))
    check_jaccard(spark, texts)
    assert sum(int(f.suffix[1:]) for f in tmp_path.iterdir()) <= 10 * len(texts)


def plain_keep(rows):
    """Rows that stay where one of each class of near copies does; a row is (id, text)."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i, t] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())
    kinds = sorted({s for (i, _), s in sets.items() if i is not None and s}, key=lambda s: (min(i for (i, _), q in sets.items() if i is not None and q == s), sorted(s)))
    linked = [(a, b) for a, b in combinations(range(len(kinds)), 2) if len(kinds[a] & kinds[b]) * 5 >= 4 * len(kinds[a] | kinds[b])]
    root = plain_classes(range(len(kinds)), linked)
    out, seen = [], set()
    for i, t in rows:
        s = sets[i, t]
        if i is None or not s:
            out.append((i, t))
            continue
        k = kinds.index(s)
        if root[k] == k and i == min(j for (j, _), q in sets.items() if j is not None and q == s) and k not in seen:
            seen.add(k)
            out.append((i, t))
    return out


def test_one_row_of_each_class_stays(spark):
    r = random.Random(31)
    some = lambda n, p: " ".join(f"{p}{r.randint(0, 900)}" for _ in range(n))
    a, b, c = some(40, "a"), some(40, "b"), some(40, "c")
    rows = [(3, a), (5, a + " x"), (5, b), (9, c), (9, c), (None, a), (None, a), (11, ""), (11, ""), (12, None), (13, "one two"), (14, "one two"), (15, c.replace(" ", "\n")), (2, some(30_000, "long"))]
    rows += [(100 + i, t) for i, t in enumerate(corpus(3))]
    df = spark.createDataFrame([(i, t, f"l{k}", k, 7) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, d1 int")
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_keep(rows), key=repr)
    assert [x for x in got if x[0] in (3, 5, 9, 15)].count((9, c)) == 1 and (5, b) in got and (5, a + " x") not in got
    assert jaccard.keep_one(df.limit(0)).count() == 0

def test_jaccard_empty(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lattice_decoder():
    r = np.random.default_rng(1)
    x = r.normal(0, 2, (300, 8))
    p = lattice.decode(x)
    assert ((2 * p) % 1 == 0).all() and ((p.sum(1) % 2) == 0).all()
    assert (np.abs(p - np.rint(p)).max(1) % 0.5 == 0).all()
    near = ((x - p) ** 2).sum(1)
    for m in lattice.minimal_vectors():
        assert (((x - p - m) ** 2).sum(1) >= near - 1e-9).all()
    assert len(lattice.minimal_vectors()) == 240 and np.allclose((lattice.minimal_vectors() ** 2).sum(1), 2)


def check_lattice(spark):
    r = np.random.default_rng(2)
    v = [r.normal(size=64) for _ in range(400)]
    v += [v[i % 40] + r.normal(0, 0.045 * np.linalg.norm(v[i % 40]), 64) for i in range(200)]
    hot = r.normal(size=64)
    v += [hot + r.normal(0, 0.2, 64) for _ in range(60)] + [v[3]] * 5 + [v[3] * 2]
    v = [x.astype(np.float32).tolist() for x in v]
    v += [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(0, v[0], 0), (None, v[0], 0)]
    got = lattice.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")).collect()
    good = [i for i, x in enumerate(v) if x and len(x) == 64 and None not in x and np.isfinite(x).all() and any(x)]
    m = np.array([v[i] for i in good], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = [(good[a], good[b]) for a, b in np.argwhere(np.triu(m @ m.T >= 0.9, 1))]
    comp, n = plain_classes(range(len(v)), linked), dict.fromkeys(range(len(v)), 0)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows) and len(linked) > 1000
    wrong = [x for x in got if x.id is not None and (x.component_id, x.n_links) != (comp[x.id], n[x.id])]
    assert not wrong
    assert [x for x in got if x.id is None][0].component_id is None


def test_lattice_equals_brute_force(spark):
    check_lattice(spark)


def test_lattice_tiles(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", 16)
    monkeypatch.setattr(jaccard, "DENSE", 1)
    check_lattice(spark)


def test_lattice_empty(spark):
    assert lattice.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from simgraph.llm import bpe, decontam, secrets, toxicity

    r = random.Random(33)
    calm = lambda n: " ".join(f"w{int(900 * r.random() ** 2)}" for _ in range(n))
    items = [calm(25) for _ in range(6)] + ["w1", None]
    texts = [calm(r.randint(1, 90)) for _ in range(120)]
    for i in range(0, 120, 3):
        texts[i] += r.choice([" you utter idiot moron", f" {items[i % 6]} end", " password = " + "k3Y" * 6, " see ghp_" + "aB3dE5gH7jK9" * 3, ""])
    texts += [texts[1] + " x", texts[1], texts[4], None, "", calm(20_000) + " idiot moron", calm(15_000) + " AKIA" + "Z9" * 9]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, texts[7], "en", "s", 1), (8, texts[8], "xx", "s", 1), (8, calm(30), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("idiot" in t)) for i, t in enumerate(texts[:120])]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    machine = toxicity.train(stored, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = [x for x, s in zip(rows, [q.score for q in toxicity.score(spark.createDataFrame([(k, x[1]) for k, x in enumerate(rows)], "doc_id long, text string").coalesce(1), machine).collect()], strict=True) if s < 0.5]
    gone = [x for x in rows if x not in clean]
    assert len(gone) > 5 and all("idiot" in x[1] for x in gone)
    left = plain_keep([(x[0], x[1]) for x in clean])
    assert len(left) < len(clean)
    codes = lambda ts: [h[f[k] : f[k + 1]] for i, j, h, f in decontam._terms(pa.array(ts, pa.string())) for k in range(j - i)]
    bench = [c for c in codes([t for t in items if t]) if len(c) >= 3]
    kept = [x for x, d in zip(left, codes([t for _, t in left]), strict=True) if not len(d) or all(decontam.align(d[None], c[None])[0][0] < 0.6 * 2 * len(c) for c in bench)]
    assert len(kept) < len(left)
    model = secrets.train(spark.createDataFrame(kept, "doc_id long, text string"))
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    want, hidden = [], 0
    for i, x in kept:
        spans = [(s, e) for s, e, *_ in secrets.find([x], model)[0]]
        hide = [any(s <= k < e for s, e in spans) for k in range(len(x or ""))]
        text = "".join("[secret]" if h and (k == 0 or not hide[k - 1]) else "" if h else x[k] for k, h in enumerate(hide))
        hidden += bool(spans)
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), ids))
    assert hidden > 5
    assert sorted(((x.doc_id, x.n_tokens, list(x.ids)) for x in got), key=repr) == sorted(want, key=repr)


def test_stages_of_nothing_give_nothing(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, f in p.STAGES:
        out = f(spark, docs, sf)
        assert out.count() == 0, name
        assert name == "token_ids" or out.columns == docs.columns


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert 0 < len(ids) <= docs.count() and len(ids) == len(out)
    assert [k for k, _ in p.STAGES] == ["toxicity", "near_copies", "benchmark_leaks", "secrets", "token_ids"]
    cur = docs
    for name, f in p.STAGES[:-1]:
        cur = f(spark, cur, sf)
        assert cur.columns == docs.columns, name
    left = cur.select("doc_id", "text", "n_chars").collect()
    assert {r.doc_id for r in left} == ids and all(len(r.text) == r.n_chars for r in left)
