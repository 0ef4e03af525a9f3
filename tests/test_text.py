import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattice.functions import text as T
from lattice.sources.files import ignore_pattern, slice_bounds


@given(st.text(max_size=40))
def test_norm_id_is_idempotent(s):
    assert T.norm_id(T.norm_id(s)) == T.norm_id(s)


@pytest.mark.parametrize(("a", "b", "jaro", "winkler"), [("martha", "marhta", 0.9444, 0.9611), ("abcxyzqq", "abcxyzuv", 0.8333, 0.9), ("abcxyz", "abcuvw", 0.6667, 0.6667), ("", "a", 0, 0), ("same", "same", 1, 1)])
def test_textbook_similarities(a, b, jaro, winkler):
    assert round(T.jaro(a, b), 4) == jaro and round(T.jaro_winkler(a, b), 4) == winkler


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_damerau_within_one(a, b):
    near = {a}
    for i in range(len(a) + 1):
        near.add(a[:i] + a[i + 1 :])
        near |= {a[:i] + c + a[i:] for c in "abc"} | {a[:i] + c + a[i + 1 :] for c in "abc" if i < len(a)}
        if i + 1 < len(a):
            near.add(a[:i] + a[i + 1] + a[i] + a[i + 2 :])
    assert T.damerau_within_one(a, b) == (b in near)


def test_fold_and_entropy():
    assert T.norm("ﬁSS—Str.  x") == "fiss str x"
    assert T.entropy("aabb") == 1.0 and T.entropy("") == 0.0
    assert T.strip_marks("é") == "e"


def test_minhash_estimates_jaccard():
    a = [str(i).encode() for i in range(200)]
    b = a[:150] + [f"x{i}".encode() for i in range(50)]
    assert abs(np.mean(np.array(T.minhash(a)) == np.array(T.minhash(b))) - 150 / 250) < 0.15
    assert T.minhash([]) == [0xFFFFFFFF] * 128


@given(st.text(alphabet="ab\n#", max_size=200), st.integers(3, 40))
def test_slices_cover_the_text(text, most):
    cuts = slice_bounds(text, most)
    assert "".join(text[a:b] for a, b in cuts) == text and all(b - a <= most for a, b in cuts)


@pytest.mark.parametrize(("rule", "path", "hit"), [("*.pyc", "a/b.pyc", True), ("/build", "x/build/y", False), ("build/", "x/build/y", True), ("docs/**/x.md", "docs/a/b/x.md", True), ("a?c", "abc", True), ("a?c", "a/c", False)])
def test_ignore_patterns(rule, path, hit):
    import re

    assert bool(re.match(ignore_pattern(rule)[0], path)) == hit
