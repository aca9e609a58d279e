"""Fetching through the cache, and the order of venues."""

import json

import pytest

from tickwell.sources import connectors as C


def test_fetch_goes_to_the_client_only_for_what_the_cache_lacks(spark, tmp_path):
    clients = {p: "tests.core.cached_client:page" for p in ("yahoo", "ccxt", "baostock")}
    ask = lambda symbols, **kw: C.fetch_cached(spark, symbols, clients, f"{tmp_path}/cache", **kw)
    got = ask(["AAPL", "BTC/USDT", "600519"])
    assert got.count() == 36 and {r.symbol for r in got.select("symbol").distinct().collect()} == {"AAPL", "BTC/USDT", "600519"}
    assert ask(["AAPL", "MSFT", "BTC/USDT"]).count() == 36
    files = [str(p.relative_to(f"{tmp_path}/cache")) for p in (tmp_path / "cache").rglob("part-*.parquet")]
    assert {f.split("/")[0] for f in files} == {"provider=yahoo", "provider=ccxt", "provider=baostock"} and all("market=auto/interval=1d/start=na/end=na" in f for f in files)
    before = len(files)
    assert ask(["AAPL", "MSFT"]).count() == 24 and len(list((tmp_path / "cache").rglob("part-*.parquet"))) == before
    assert ask(["MSFT"], force_refresh=True).count() == 12 and ask(["AAPL", "MSFT"]).count() == 24
    assert ask(["AAPL"], start="1970-01-03", end="1970-01-05").count() == 3
    assert ask(["NONE"]).count() == 0 and C.fetch_cached(spark, [], clients).count() == 0
    assert C.fetch_cached(spark, ["X"], clients, provider="yahoo").count() == 12
    with pytest.raises(ValueError, match="akshare"):
        ask(["830799.BJ"])


def test_venues_are_tried_in_order(spark, tmp_path):
    urls = C.rest_urls("BTCUSDT", "1h", 5, "https://example.org/{symbol}/{interval}/{limit}")
    assert [v for v, _ in urls] == ["binance_vision", "rest_template", "binance_fapi"] and urls[1][1] == "https://example.org/BTCUSDT/1h/5"
    assert [v for v, _ in C.rest_urls("B", "1h", 5, C.FAPI, prefer_vision=False)] == ["rest_template"]
    lines = lambda n: json.dumps([[str(i * 3_600_000), "1", "2", "0.5", "1.5", "9"] for i in range(n)])

    def get(url):
        if "vision" in url:
            raise OSError("down")
        return lines(3 if "example" in url else 12)

    bars, venue, note = C.venue_bars(spark, "BTCUSDT", get, f"{tmp_path}/v", template="https://example.org/{symbol}{interval}{limit}")
    assert (bars.count(), venue, note) == (12, "binance_fapi", None) and C.load_cache(spark, f"{tmp_path}/v", "binance_fapi", "1h").count() == 12
    bars, venue, note = C.venue_bars(spark, "BTCUSDT", lambda url: lines(2))
    assert bars.count() == 0 and venue == "none" and "too_few_rows=2" in note
