import random

from lattice.llm import decontam

ITEMS = [
    (1, "A train leaves the old station at 15 km per hour and meets Anna after 3 hours near the river. How far did it go?"),
    (2, "the quick brown fox jumps over the lazy dog while seven quiet cats watch from a garden wall in silence"),
    (3, "two words"),
    (4, None),
    (5, "Every morning the baker counts his fresh loaves"),
]


def leaks(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, place int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, hash string")
    return {(r.doc_id, r.item_id): r for r in decontam.find_leaks(spark, d, b).collect()}


def noise(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def test_planted_passages(spark):
    changed = "A train leaves the old station at 42 miles per hour and meets Olga after 7 hours near the river. How far did it go?"
    mixed = "A train leaves the old station at 15 km per hour and meets Anna after 3 hours near the river."
    docs = [
        (10, noise(300, 1) + ". " + ITEMS[0][1] + " " + noise(300, 2)),
        (11, noise(50, 3) + ". " + changed + " " + noise(50, 4)),
        (12, noise(400, 5)),
        (13, noise(40, 6) + " " + ITEMS[1][1].upper().replace(" ", "\n") + "! " + noise(40, 7)),
        (14, "two words"),
        (15, " ".join(ITEMS[1][1].split()[:14]) + " " + noise(90, 8)),
        (16, " ".join(ITEMS[1][1].split()[:9]) + " " + noise(90, 9)),
        (17, mixed + " " + mixed),
        (18, "Every morning the baker counts his fresh loaves"),
        (19, noise(200_000, 10) + ". " + ITEMS[1][1]),
    ]
    got = leaks(spark, docs)
    assert {k[0] for k in got} == {10, 11, 13, 15, 17, 18, 19}
    assert got[10, 1].exact and not got[11, 1].exact and got[11, 1].n_slots > 0 and got[15, 2].exact


def test_slots_must_agree(spark):
    items = [(1, "add 5 to the first pile and then take 5 from the second pile until both piles hold 9 coins together")]
    same = "add 8 to the first pile and then take 8 from the second pile until both piles hold 2 coins together"
    torn = "add 8 to the first pile and then take 6 from the second pile until both piles hold 2 coins together"
    assert set(leaks(spark, [(1, same), (2, torn)], items)) == {(1, 1)}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, noise(rng.randint(10, 30), i)) for i in range(12)]
    docs = []
    for i in range(60):
        words = noise(120, 1000 + i).split()
        if i % 3 == 0:
            cut = items[i % 12][1].split()
            at, k = rng.randint(0, 100), rng.randint(6, len(cut))
            words[at:at] = cut[:k]
        docs.append((i, " ".join(words)))
    want = set()
    for d, t in docs:
        for i, item in items:
            a, b = t.split(), item.split()
            runs = max((sum(a[s + j : s + j + 8] == b[j : j + 8] for j in range(len(b) - 7) if s + j >= 0) for s in range(-len(b), len(a))), default=0)
            if runs >= min(decontam.MIN_WINDOWS, len(b) - 7):
                want.add((d, i))
    assert set(leaks(spark, docs, items)) == want


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, ITEMS[1][1]), (4, ITEMS[1][1]), (4, ITEMS[1][1])]
    assert set(leaks(spark, docs)) == {(None, 2), (4, 2)}
    assert leaks(spark, []) == {} and leaks(spark, docs, []) == {}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in decontam.decontaminate(spark, df, bench).collect()), key=str) == [(1, None), (2, "")]


def test_names_only_items_match_by_exact_values(spark):
    items = [(1, "Alice Brown met Carol Davis near Lake Geneva"), (2, "Alice Brown met Carol Davis near Lake Geneva while Emil Falk drove Otto Lind to Bern and Basel")]
    other = [(i, t.replace("Carol", "Clara")) for i, t in items]
    docs = [(10 * i + k, noise(30, k) + sep + t + ". " + noise(20, k + 7)) for i, t in items for k, sep in enumerate((". ", " ", "\n"))]
    docs += [(100 + i, noise(30, i) + ". " + t) for i, t in other]
    got = leaks(spark, docs, items)
    assert {d for d, i in got if i == 1} == {10, 11, 12, 20, 21, 22}  # not the one with another name: it has too few literals
    assert {d for d, i in got if i == 2 and got[d, i].exact} == {20, 21, 22, 102}  # 13 words of the last are the same


def test_decisions_are_by_row(spark):
    leak = noise(20, 1) + ". " + ITEMS[1][1]
    rows = [(None, leak, "a"), (None, noise(30, 2), "b"), (5, leak, "c"), (5, noise(30, 3), "d"), (6, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, leak string")
    out = decontam.decontaminate(spark, df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.columns == df.columns and sorted(r.leak for r in out.collect()) == ["b", "d", "e"]


def test_rows_of_one_id_are_not_matched_together(spark):
    words = ITEMS[1][1].split()
    torn = [(7, " ".join(words[:12]) + " " + noise(9, 4)), (7, noise(7, 5) + " " + " ".join(words[7:]))]
    halves = [(7, " ".join(words[:11] + ["zzz"] * 8)), (7, " ".join(["zzz"] * 8 + words[8:]))]
    assert leaks(spark, halves) == {} and set(leaks(spark, torn)) <= {(7, 2)}
