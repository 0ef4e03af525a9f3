"""Registered queries and walks do the whole job: no fixed share of the input, no silent bound."""

import random
from collections import Counter

from lattice.functions import text as T
from lattice.operators import resolve, traverse
from lattice.plans import tables

DATA = "/root/testdata/sf0.001"


def test_modules_keep_every_nation_pair(spark):
    rows = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()]
    cust, supp, order = (dict(rows(*t)) for t in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("orders", "o_orderkey", "o_custkey")))
    ends = ((cust[order[o]], supp[s]) for o, s in rows("lineitem", "l_orderkey", "l_suppkey"))
    want = Counter((str(a), str(b)) for a, b in ends if a != b)
    assert {(r.source, r.target): r.weight for r in tables._modules(spark, DATA).edges.collect()} == want


def test_entities_compare_whole_texts(spark, tmp_path):
    words = lambda seed, n: " ".join("".join(random.Random(seed * 1000 + i).choices("abcdefghijklmnop", k=6)) for i in range(n))
    opening, body = words(1, 12), words(2, 300)
    texts = [opening + " " + words(3, 200), opening + " " + words(4, 200), "one two " + body, "two one " + body]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r.a, r.b) for r in tables.dedup_lsh_candidates(spark, str(tmp_path)).collect()}
    assert ("doc:3", "doc:4") in pairs and ("doc:1", "doc:2") not in pairs
    assert {r.id: r.winner for r in tables.dedup_entities(spark, str(tmp_path)).collect()} == {"doc:4": "doc:3"}
    signed = {r.id: r.signature for r in tables.minhash_signature(spark, str(tmp_path)).collect()}
    assert signed["doc:3"] == T.minhash(T.trigram_shingles(T.norm(texts[2])))


def test_jaro_takes_the_first_free_place():
    def plain(a, b):
        reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
            if j is not None:
                taken.add(j)
                left.append(c)
        m, right = len(left), [b[j] for j in sorted(taken)]
        return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) // 2) / m) / 3 if m else 0.0

    rng = random.Random(7)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(2))
        assert a == b or T.jaro(a, b) == plain(a, b)


def test_closures_pass_the_old_bounds(spark):
    n = 19
    up = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n)] + [(f"c{n}", "c0")], "class_id string, base_id string")
    classes = up.select("class_id")
    methods = spark.createDataFrame([("top", f"c{n}", "run")], "id string, class_id string, name string")
    closure = resolve.class_closure(up, classes)
    assert closure.count() == (n + 1) ** 2
    assert {r.class_id for r in resolve.dispatch(closure, methods).collect()} == {f"c{i}" for i in range(n + 1)}
    scopes = spark.createDataFrame([(f"s{i}", f"s{i + 1}" if i < n else None) for i in range(n + 1)], "scope string, parent string")
    bound, uses = spark.createDataFrame([(f"s{n}", "x", "far")], "scope string, name string, value string"), spark.createDataFrame([(1, "s0", "x")], "use_id int, scope string, name string")
    assert [tuple(r) for r in resolve.scope_lookup(scopes, bound, uses).collect()] == [(1, "far")]


def test_reach_goes_past_a_hundred_calls(spark):
    n = 103
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, 0)], "source int, target int").coalesce(1).cache()
    roots = spark.createDataFrame([(0,)], "id int")
    assert {r.id for r in traverse.reachable(spark, edges, roots).collect()} == set(range(n + 1))
