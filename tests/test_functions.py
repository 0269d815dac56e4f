"""Property tests for the exact rounding helpers (hypothesis generates the inputs)."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.functions.numeric import round_ratio
from keelson.functions.rounding import round_half_up

PAIRS = st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=300)
BIG = st.lists(st.tuples(st.integers(-10**24, 10**24), st.integers(1, 10**20)), min_size=1, max_size=100)


def _expected(a, b, digits, times):
    q = (Decimal(a) * times / Decimal(b)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
    return float(q)


@settings(max_examples=5, deadline=None)
@given(PAIRS)
def test_round_ratio_is_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", round_ratio("a", "b", 2, 100).alias("r")).collect()
    for row in got:
        assert row.r == _expected(row.a, row.b, 2, 100), (row.a, row.b, row.r)


@settings(max_examples=5, deadline=None)
@given(BIG)
def test_round_ratio_exact_beyond_bigint(spark, pairs):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string") \
        .selectExpr("cast(a as decimal(38,0)) a", "cast(b as decimal(38,0)) b")
    for row in df.select("a", "b", round_ratio("a", "b", 2, 100, wide=True).alias("r")).collect():
        assert row.r == _expected(int(row.a), int(row.b), 2, 100), (row.a, row.b, row.r)


def test_round_ratio_ties(spark):
    # 1/8 = 0.125 -> 0.13, -1/8 -> -0.13, 1/200*100 = 0.5 -> 0.5; NULL in, NULL out
    df = spark.createDataFrame([(1, 8, 1), (-1, 8, 1), (1, 200, 100), (None, 3, 1)], "a long, b long, t int")
    out = [r[0] for r in df.select(round_ratio("a", "b", 2, 1)).collect()]
    assert out[:2] == [0.13, -0.13] and out[3] is None
    assert df.select(round_ratio("a", "b", 2, 100)).collect()[2][0] == 0.5


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200))
def test_round_half_up_double_is_floor_form(spark, xs):
    import math
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", round_half_up(df.x, 3).alias("r")).collect():
        assert row.r == math.floor(row.x * 1000.0 + 0.5) / 1000.0


KEYS = st.text(alphabet=st.sampled_from(list('ab.$x"\\ ')), min_size=1, max_size=6)
JSONV = st.recursive(st.one_of(st.integers(), st.floats(allow_nan=False, allow_infinity=False), KEYS),
                     lambda kids: st.one_of(st.lists(kids, max_size=3), st.dictionaries(KEYS, kids, max_size=3)),
                     max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(KEYS, JSONV, max_size=4))
def test_key_prefilter_never_misses(doc):
    import json
    import re
    from keelson.operators.events import MAYBE_BAD_KEY, _first_bad_key
    text = json.dumps(doc)
    if _first_bad_key(text) is not None:
        assert re.search(MAYBE_BAD_KEY, text)
