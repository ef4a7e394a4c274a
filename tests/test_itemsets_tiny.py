"""Hand-worked support / confidence / lift on five baskets:
{A,B} {A,B,C} {A} {B,C} {A,B,C,D};  supports A=4 B=4 C=3 D=1, 5 orders."""

import pytest

from basketlens.operators import itemsets

RAW = None


def rows(df):
    return {tuple(r[c] for c in df.columns if c.startswith("product_")): r.asDict() for r in df.collect()}


def test_pairs(tiny):
    out = rows(itemsets.analyze(tiny, 2, min_co=1, limit=None, digits=RAW))
    assert len(out) == 6
    ab = out[("item1", "item2")]
    assert ab["co_occurrence"] == 3
    assert ab["support"] == pytest.approx(0.6)
    assert ab["confidence"] == pytest.approx(0.75)
    assert ab["lift"] == pytest.approx(3 * 5 / (4 * 4))
    bc = out[("item2", "item3")]
    assert bc["co_occurrence"] == 3 and bc["lift"] == pytest.approx(1.25)


def test_triplets_and_quads(tiny):
    out = rows(itemsets.analyze(tiny, 3, min_co=1, limit=None, digits=RAW))
    assert set(out) == {("item1", "item2", "item3"), ("item1", "item2", "item4"),
                        ("item1", "item3", "item4"), ("item2", "item3", "item4")}
    abc = out[("item1", "item2", "item3")]
    assert abc["co_occurrence"] == 2
    assert abc["support"] == pytest.approx(0.4)
    assert abc["confidence"] == pytest.approx(0.5)
    assert abc["lift"] == pytest.approx(2 * 25 / (4 * 4 * 3))
    quad = rows(itemsets.analyze(tiny, 4, min_co=1, limit=None, digits=RAW))
    q = quad[("item1", "item2", "item3", "item4")]
    assert q["co_occurrence"] == 1
    assert q["confidence"] == pytest.approx(1 / 3)
    assert q["lift"] == pytest.approx(125 / 48)


def test_threshold_order_and_limit(tiny):
    df = itemsets.analyze(tiny, 2, min_co=2, limit=2)
    got = [(r.product_1, r.product_2, r.co_occurrence) for r in df.collect()]
    # co >= 2: AB(3, lift .9375), AC(2, lift 2*5/12=.8333), BC(3, lift 1.25)
    assert got == [("item2", "item3", 3), ("item1", "item2", 3)]
    assert df.columns == ["product_1", "product_2", "co_occurrence", "support", "confidence", "lift"]


def test_default_rounding(tiny):
    r = itemsets.analyze(tiny, 3, min_co=1, limit=None).where("product_3 = 'item3'").first()
    assert r.lift == 1.0417 and r.support == 0.4


def test_search_and_directed(tiny):
    s = itemsets.search(tiny, "item4", n=2, min_co=1, limit=10)
    assert {(r.product_1, r.product_2) for r in s.collect()} == {
        ("item1", "item4"), ("item2", "item4"), ("item3", "item4")}
    d = itemsets.pairs_directed(tiny, "item3", min_co_exclusive=1, limit=5, digits=None).collect()
    # co > 1 with item3: BC (3, lift 1.25) then AC (2, lift 0.833)
    assert [(r.product_1, r.product_2) for r in d] == [("item2", "item3"), ("item1", "item3")]
    r = d[0]
    assert (r.co_occurrence_count, r.product1_count, r.product2_count) == (3, 4, 3)
    assert r.confidence_1_to_2 == pytest.approx(0.75) and r.confidence_2_to_1 == pytest.approx(1.0)


def test_top_metric_validation(tiny):
    with pytest.raises(ValueError):
        itemsets.top(tiny, 2, "bogus")
    with pytest.raises(ValueError):
        itemsets.analyze(tiny, 1, 1)
    top = itemsets.top(tiny, 2, "support", 2, min_co=1, pool=None).collect()
    assert [r.co_occurrence for r in top] == [3, 3]
