"""Property tests (hypothesis) on the operators."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline import operators as O

KEYS = st.sampled_from(["D1", "D2", "D3", None])
SKUS = st.sampled_from(["S1", "S2", None])
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(KEYS, SKUS), min_size=1, max_size=12),
       st.lists(st.one_of(st.none(), st.sampled_from(["D1_S1", "D2_S2", "D3_S1"])), max_size=4))
def test_kept_plus_deducted_is_everything(spark, facts, keys):
    f = spark.createDataFrame(facts, "doc_no string, sku string")
    k = spark.createDataFrame([(x,) for x in keys], "invoice_key string")
    assert O.deduct(f, k, "invoice_key").count() + O.only_deducted(f, k, "invoice_key").count() == len(facts)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["BO", "FG", "XX", None]),
                          st.integers(0, 1000)), min_size=1, max_size=15))
def test_pivot_preserves_recognised_total(spark, data):
    df = spark.createDataFrame([(k, f, Decimal(v)) for k, f, v in data], "k string, f string, v decimal(12,2)")
    out = O.pivot_sum(df, ["k"], "f", ["BO", "FG"], "v").collect()
    total = sum(r.BO + r.FG for r in out)
    assert total == sum(v for k, f, v in data if k is not None and f in ("BO", "FG"))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["c1", "c2", "c3"]), st.integers(0, 5), st.sampled_from(["x", "y"])),
                min_size=1, max_size=15), st.integers(1, 5))
def test_first_per_key_one_row_per_key(spark, data, parts):
    df = spark.createDataFrame(data, "k string, o int, p string").repartition(parts)
    out = {r.k: (r.o, r.p) for r in O.first_per_key(df, ["k"], ["o"]).collect()}
    expect = {}
    for k, o, p in sorted(data, key=lambda r: (r[1], r[2])):
        expect.setdefault(k, (o, p))
    assert out == expect


@SETTINGS
@given(st.lists(st.sampled_from(["k1", "k2", "k3", "k9", None]), min_size=1, max_size=20))
def test_left_lookup_with_unique_dimension_keeps_rows(spark, keys):
    fact = spark.createDataFrame([(k,) for k in keys], "k string")
    dim = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "k string, v int")
    assert O.lookup(fact, dim, "k", ["v"]).count() == len(keys)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["ITM_GOODS", "ITM_SALES_TAX", None]), st.integers(-5, 50)),
                min_size=1, max_size=10),
       st.lists(st.tuples(st.sampled_from(["BAD_ORDER", "CUSTOMER_RETURN", None]), st.integers(-5, 50)),
                min_size=1, max_size=10))
def test_sellout_total_is_invoices_minus_returns(spark, inv, ret):
    from datetime import date

    from ledgerline.params import Params
    from ledgerline.plans import net_sellout
    from tests.fixtures import INVOICE, RETURNS

    d = date(2026, 1, 5)
    invoice = spark.createDataFrame(
        [(d, "C", "n", "S", "I", "x", "Case", Decimal(q), Decimal(1), t, "D", "O", "E") for t, q in inv], INVOICE)
    returns = spark.createDataFrame(
        [(d, "R", "E", "C", "n", "S", "x", "MAIN BO", Decimal(1), "Case", Decimal(q), t) for t, q in ret], RETURNS)
    out = net_sellout({"invoice": invoice, "returns": returns}, Params(distributor="x"))
    total = sum(r.qty for r in out.collect())
    expect = sum(q for t, q in inv if t != "ITM_SALES_TAX") - sum(abs(q) for t, q in ret if t != "CUSTOMER_RETURN")
    assert total == expect


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["VAN(EXTRUCK)", "BOOK(Booking)", "OTHER", None]),
                          st.sampled_from(["Case", "Piece", None]),
                          st.one_of(st.none(), st.integers(0, 3)),
                          st.one_of(st.none(), st.integers(0, 200)),
                          st.one_of(st.none(), st.integers(0, 200)),
                          st.integers(0, 100)), min_size=1, max_size=12))
def test_volume_never_null_for_numeric_quantity(spark, data):
    from ledgerline.params import Params
    from ledgerline.plans.volume import with_volume

    df = spark.createDataFrame(
        [(ch, u, None if cs is None else Decimal(cs), None if nv is None else Decimal(nv),
          None if vp is None else Decimal(vp), Decimal(q), Decimal(q) * 3) for ch, u, cs, nv, vp, q in data],
        "channel string, uom string, case_size decimal(12,2), nonvan_price decimal(12,2), "
        "van_price decimal(12,2), qty decimal(12,2), value decimal(12,2)")
    out = with_volume(df, "value", Params(distributor="x")).collect()
    assert all(r.volume is not None for r in out)
