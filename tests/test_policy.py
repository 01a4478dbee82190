import threading
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest

from cinderfind.model import NoProvider, PricingUnavailable
from cinderfind.operators.embed import HashProvider, OpenAIProvider, requests
from cinderfind.plans.policy import Breaker, Charge, Ledger, Price, Reason, Reservation, Router


class Clock:
    def __init__(self):
        self.t = datetime(2026, 8, 23, 12, tzinfo=UTC)

    def __call__(self):
        return self.t

    def advance(self, **kw):
        self.t += timedelta(**kw)


PRICE = Price.usd("hash", "bow", "1", "v1")


def router(clock=None, **kw):
    clock = clock or Clock()
    kw = {"ledger": Ledger(now=clock), "breaker": Breaker(now=clock), "usd_per_million": "1"} | kw
    return Router(HashProvider(64), kw.pop("fallback", HashProvider(32)), **kw)


def test_order_of_reasons():
    assert router().select().reason is Reason.PRIMARY
    assert router(override="force_primary", daily_usd="0").select().reservation is None
    assert router(override="force_fallback").select().reason is Reason.OVERRIDE
    r = router(enabled=False).select()
    assert r.reason is Reason.DISABLED and r.is_fallback
    assert router(daily_usd="0.000001").select(estimated_tokens=2).reason is Reason.DAILY
    assert router(monthly_usd="0.000001").select(estimated_tokens=2).reason is Reason.MONTHLY
    assert router(daily_usd="0.000002").select(estimated_tokens=2).reason is Reason.PRIMARY
    with pytest.raises(NoProvider) as e:
        router(enabled=False, fallback=None).select()
    assert e.value.reason is Reason.DISABLED


def test_breaker():
    clock = Clock()
    r = router(clock)
    for _ in range(3):
        r.record_failure()
    assert r.select().reason is Reason.UNAVAILABLE
    clock.advance(seconds=60)
    assert r.select().reason is Reason.PRIMARY
    r.record_rate_limit(5)
    assert r.select().reason is Reason.RATE_LIMITED
    clock.advance(seconds=5)
    assert r.select().reason is Reason.PRIMARY
    r.record_rate_limit(0)
    clock.advance(seconds=59)
    assert r.select().reason is Reason.RATE_LIMITED
    r.record_usage(1)
    assert r.select().reason is Reason.PRIMARY
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            Breaker(*bad)


def test_reservations():
    clock = Clock()
    ledger = Ledger(now=clock)
    held = ledger.reserve(PRICE.charge(600_000), 10**9, None, 300)
    assert isinstance(held, Reservation) and ledger.spent_today() == 600_000_000
    assert ledger.reserve(PRICE.charge(600_000), 10**9, None, 300) is Reason.DAILY
    clock.advance(seconds=300)
    assert ledger.spent_today() == 0 and ledger.events()[0].status == "expired"
    ledger.commit(held, PRICE.charge(500_000))
    assert ledger.spent_today() == 500_000_000 and ledger.tokens_today("hash") == 500_000 and ledger.tokens_today("hash", "x") == 0
    for work in (lambda: ledger.commit(held, PRICE.charge(1)), lambda: ledger.release(held)):
        with pytest.raises(ValueError):
            work()
    other = ledger.reserve(PRICE.charge(1), None, None, 300)
    with pytest.raises(ValueError):
        ledger.commit(other, Price.usd("hash", "bow", "2", "v1").charge(1))
    ledger.release(other), ledger.release(other)
    clock.advance(days=1)
    assert ledger.spent_today() == 0 and ledger.spent_month() == 500_000_000
    clock.advance(days=30)
    assert ledger.spent_month() == 0


def test_no_overspend(tmp_path):
    path, start, got = str(tmp_path / "ledger.db"), threading.Barrier(2), []
    Ledger(path)

    def work():
        ledger = Ledger(path)
        start.wait()
        got.append(ledger.reserve(PRICE.charge(600_000), 10**9, None, 300))

    threads = [threading.Thread(target=work) for _ in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(isinstance(g, Reservation) for g in got) == [False, True]


def test_usage_and_prices(spark):
    r = router(daily_usd="1")
    chosen = r.select(texts=["abcd" * 4])
    assert r.record_usage(3, reservation=chosen.reservation).nanos == 3000
    assert Charge.total("p", "m", "standard", 3, "0.000000001").rate == 333334
    assert r.record_usage(10, usd="0.5").usd == Decimal("0.5")
    frame = r.ledger.events_frame(spark)
    assert frame.count() == 2 and {x.status for x in frame.collect()} == {"committed"}
    with pytest.raises(PricingUnavailable):
        Router(HashProvider(8), daily_usd="1")
    for kw in ({"override": "x"}, {"fallback": HashProvider(64)}, {"mode": ""}, {"prices": {}, "usd_per_million": "1"}):
        with pytest.raises(ValueError):
            router(**kw)
    for kw in ({}, {"estimated_tokens": -1}):
        with pytest.raises(ValueError):
            router(daily_usd="1").select(**kw)


def test_requests():
    assert [list(r) for r in requests([5, 5, 5, 9], 10, 10)] == [[0, 1], [2], [3]]
    assert [len(r) for r in requests([1] * 300, 128)] == [128, 128, 44]
    with pytest.raises(ValueError):
        list(requests([9000]))


def test_openai_client_is_ordered():
    class D:
        def __init__(self, index, v):
            self.index, self.embedding = index, v

    class Client:
        class embeddings:
            @staticmethod
            def create(model, input):
                return type("A", (), {"data": [D(i, [float(len(t))]) for i, t in reversed(list(enumerate(input)))], "usage": type("U", (), {"total_tokens": len(input)})})

    p = OpenAIProvider(client=Client, batch_size=2)
    assert p.embed_texts_with_usage(["a", "bb", "ccc"]) == ([[1.0], [2.0], [3.0]], 3)
    with pytest.raises(ValueError):
        p.embed_texts(["a", ""])
