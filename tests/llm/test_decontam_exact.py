from test_decontam import leaks, noise

SHORT = "What is the height of the old tower that stands near the harbour"
TINY = "Every baker counts loaves"
DENSE = "In 1901 Anna Berg paid 300 Marks to Otto Lind and 450 Marks to Emil Falk of 12 Elm Street while Karl Voss lent 75 Marks"
MIXED = "the old clerk wrote down that Anna Berg owes 300 Marks 20 Pence 7 Crowns 12 Dimes"
ITEMS = [(1, SHORT), (2, TINY), (3, DENSE), (4, MIXED)]


def test_exact_copies_whatever_precedes_them(spark):
    before = [noise(40, 1) + " some heading\n", noise(40, 2) + ". ", "", noise(40, 3) + " 5 ", "Some Heading\n\n"]
    docs = [(10 * k + i, b + text + " " + noise(30, 50 + k)) for k, b in enumerate(before) for i, text in ITEMS]
    got = leaks(spark, docs, ITEMS)
    assert set(got) == {(10 * k + i, i) for k in range(len(before)) for i, _ in ITEMS}
    assert all(r.exact for r in got.values())
    lower = [(1, noise(40, 4) + " " + SHORT.replace("What", "what")), (2, noise(40, 5) + " Which" + SHORT[4:])]
    assert set(leaks(spark, lower, ITEMS)) == {(1, 1)}


def test_windows_with_few_literals_match_by_value_only(spark):
    other = DENSE.replace("300", "310").replace("450", "460").replace("75", "85").replace("1901", "1902").replace("12", "13")
    assert leaks(spark, [(1, noise(20, 6) + ". " + other)], ITEMS) == {}
    changed = MIXED.replace("Anna", "Olga").replace("300", "500").replace("20", "30")
    got = leaks(spark, [(1, noise(20, 7) + ". " + changed)], ITEMS)
    assert set(got) == {(1, 4)} and not got[1, 4].exact
