from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import similarity as S

WORDS = st.text("abc ", max_size=14)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_lcs_and_symmetry(a, b):
    assert S.lcs_length(a, b) == plain_lcs(a, b)
    for fn in (S.indel_ratio, S.token_sort_ratio, S.token_set_ratio, S.jaro_winkler, S.partial_ratio):
        assert 0 <= fn(a, b) <= 1 and abs(fn(a, b) - fn(b, a)) < 1e-9 or fn is S.jaro_winkler


def test_edges():
    assert S.indel_ratio("", "") == 1 and S.indel_ratio("", "a") == 0
    assert S.token_set_ratio("", "a") == 0 and S.token_set_ratio("a b", "b a c") == 1
    assert S.partial_ratio("bcd", "abcde") == 1
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert S.token_misses("wright horizon", "wright horizn group") == 0 and S.token_misses("a bb", "") == 2
