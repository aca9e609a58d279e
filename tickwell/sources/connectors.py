"""Where bars come from and results go to: a data source over a client, tiered loading with caches, sinks."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickwell.operators.market_rules import provider as provider_of
from tickwell.sources.bars import BARS, normalize, synthetic
from tickwell.sources.shared import stored

#: Public venues of candles.
VISION = "https://data-api.binance.vision/api/v3/klines?symbol={symbol}&interval={interval}&limit={limit}"
FAPI = "https://fapi.binance.com/fapi/v1/klines?symbol={symbol}&interval={interval}&limit={limit}"


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.options["symbols"].split(",") if s]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        page = getattr(importlib.import_module(module), name)
        limit, cursor, end = int(self.options.get("limit", 1000)), int(self.options.get("start", 0)), int(self.options.get("end", 1 << 62))
        while cursor <= end:
            rows = page(partition.symbol, self.options.get("interval", "1d"), cursor, limit)
            for ms, o, h, low, c, v in rows:
                if ms <= end:
                    yield (partition.symbol, datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None), float(o), float(h), float(low), float(c), float(v))
            if len(rows) < limit:
                return
            cursor = rows[-1][0] + 1


class BarsSource(DataSource):
    """``spark.read.format("bars_client")``: option ``client`` names a function ``module:name`` that gives a page of (ms, open, high, low, close, volume) for a symbol, an interval, a first time in ms and a limit. One partition a symbol, pages in turn."""

    @classmethod
    def name(cls) -> str:
        return "bars_client"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def fetch(spark: SparkSession, client: str, symbols: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(BarsSource)
    return spark.read.format("bars_client").options(client=client, symbols=",".join(symbols), **options).load()


def klines(spark: SparkSession, lines: DataFrame, symbol: str) -> DataFrame:
    """Bars of JSON texts (value), each an array of arrays [ms, open, high, low, close, volume, ...]."""
    k = lines.select(F.explode(F.from_json("value", "array<array<string>>")).alias("k"))
    at = (F.timestamp_millis(F.col("k")[0].cast("long"))).cast("timestamp_ntz")
    return k.select(F.lit(symbol).alias("symbol"), at.alias("ts"), *[F.col("k")[i].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])


def quote_lines(lines: DataFrame, symbol: str) -> DataFrame:
    """Bars of text lines ``date,open,close,high,low,volume``; lines that do not fit are left out."""
    p = F.split("value", ",")
    part = lambda i: F.try_element_at(p, F.lit(i + 1))
    rows = lines.select(F.lit(symbol).alias("symbol"), F.try_to_timestamp(part(0)).cast("timestamp_ntz").alias("ts"), *[part(i).try_cast("double").alias(n) for n, i in (("open", 1), ("high", 3), ("low", 4), ("close", 2), ("volume", 5))])
    return rows.where("ts IS NOT NULL AND close IS NOT NULL")


def save_cache(bars: DataFrame, path: str, provider: str, interval: str) -> None:
    """Parquet by provider and interval; a symbol is found by its column's statistics. The note of what was saved stays beside it, as column metadata."""
    note = json.dumps({"provider": provider, "interval": interval, "saved": datetime.now(UTC).isoformat()})
    bars = bars.withMetadata("close", {"note": note}).withColumns({"provider": F.lit(provider), "interval": F.lit(interval)})
    bars.write.mode("overwrite").partitionBy("provider", "interval").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_cache(spark: SparkSession, path: str, provider: str, interval: str, symbols: list[str] | None = None, min_rows: int = 1) -> DataFrame | None:
    """The cached bars, or None where there is no readable cache or too few rows."""
    try:
        rows = spark.read.parquet(path).where((F.col("provider") == provider) & (F.col("interval") == interval)).drop("provider", "interval")
        rows = rows.where(F.col("symbol").isin(symbols)) if symbols else rows
        return rows if rows.limit(min_rows).count() >= min_rows else None
    except Exception:  # noqa: BLE001  a cache that cannot be read is a miss
        return None


def fetch_cached(
    spark: SparkSession, symbols: list[str], clients: dict[str, str], folder: str | None = None, market: str = "auto", provider: str = "auto", interval: str = "1d", start: str | None = None, end: str | None = None,
    use_cache: bool = True, force_refresh: bool = False, **options: str,
) -> DataFrame:
    """Bars of ``symbols``, each by its own provider: from the cache in ``folder`` where it has the same request, else from the provider's client, and then saved.

    ``clients``: the client (``module:name``) of each provider. A request is known by provider, market, interval, start and end, which are the
    partitions of the cache, and by its symbol. What is missing of one provider is one read with a partition a symbol; a symbol that
    comes back empty is not saved. ``force_refresh`` reads all anew and overwrites; an unreadable cache is a miss.
    """
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string").select("symbol", (provider_of(F.col("symbol"), F.lit(market)) if provider == "auto" else F.lit(provider)).alias("provider"))
    routed: dict[str, list[str]] = {}
    for r in wanted.collect():  # a row a symbol asked for
        routed.setdefault(r.provider, []).append(r.symbol)
    if unknown := set(routed) - set(clients):
        raise ValueError(f"no client for {', '.join(sorted(map(str, unknown)))}")
    parts = []
    for name, own in routed.items():
        path = None if folder is None or not use_cache else f"{folder.rstrip('/')}/provider={name}/market={market}/interval={interval}/start={start or 'na'}/end={end or 'na'}"
        held = None
        if path is not None and not force_refresh:
            try:
                held = spark.read.schema(BARS).parquet(path).where(F.col("symbol").isin(own))
                have = {r.symbol for r in held.select("symbol").distinct().collect()}
            except Exception:  # noqa: BLE001  a cache that cannot be read is a miss
                held = None
        have = have if held is not None else set()
        if have:
            parts.append(held)
        if rest := [s for s in own if s not in have]:
            span = {k: str(int(datetime.fromisoformat(v).replace(tzinfo=UTC).timestamp() * 1000)) for k, v in (("start", start), ("end", end)) if v is not None}
            new = normalize(fetch(spark, clients[name], rest, interval=interval, **span, **options))
            if path is not None:
                # A forced refresh replaces the symbols that it read; others of the same request stay.
                new = stored(new, "fetched")
                keep = None
                if force_refresh:
                    try:
                        keep = stored(spark.read.schema(BARS).parquet(path).where(~F.col("symbol").isin(rest)), "kept")
                    except Exception:  # noqa: BLE001
                        keep = None
                if not new.isEmpty():
                    (new if keep is None else new.unionByName(keep)).write.mode("overwrite" if force_refresh else "append").parquet(path)
            parts.append(new)
    out = parts[0] if parts else spark.createDataFrame([], BARS)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rest_urls(symbol: str, interval: str, limit: int, template: str | None = None, prefer_vision: bool = True) -> list[tuple[str, str]]:
    """(venue, url) in the order in which they are tried, each url once; the futures venue is always the last resort."""
    made = [("binance_vision", VISION)] * prefer_vision + ([("rest_template", template)] if template else []) + [("binance_fapi", FAPI)]
    urls = [(venue, t.format(symbol=symbol, interval=interval, limit=limit)) for venue, t in made]
    return [(v, u) for i, (v, u) in enumerate(urls) if v != "binance_fapi" or u not in [x for _, x in urls[:i]]]


def venue_bars(spark: SparkSession, symbol: str, get: Callable[[str], str], folder: str | None = None, interval: str = "1h", limit: int = 500, template: str | None = None, prefer_vision: bool = True, least: int = 10) -> tuple[DataFrame, str, str | None]:
    """(bars, venue, note): the first of ``rest_urls`` that gives ``least`` bars, saved by venue and interval if there is a folder. ``get`` reads a url as text.

    If none does, the bars are empty, the venue is ``none`` and the note tells what each one said.
    """
    said = []
    for venue, url in rest_urls(symbol, interval, limit, template, prefer_vision):
        try:
            bars = normalize(klines(spark, spark.createDataFrame([(get(url),)], "value string"), symbol))
            n = bars.count()
            if n < least:
                said.append(f"{venue}:too_few_rows={n}")
                continue
        except Exception as e:  # noqa: BLE001  the next venue may do
            said.append(f"{venue}:{type(e).__name__}")
            continue
        if folder is not None:
            save_cache(bars, folder, venue, interval)
        return bars, venue, None
    return spark.createDataFrame([], BARS), "none", "; ".join(said) or "no_urls"


def load_bars(spark: SparkSession, source: str, tiers: dict[str, Callable[[], DataFrame | None]], min_rows: int = 10) -> tuple[DataFrame, str, str]:
    """(bars, tier used, note). ``auto`` tries rest, cache, parquet and fixture in turn; ``venue`` the same without the fixture; any other name only itself. A tier fails by raising, by None or with too few rows."""
    order = {"auto": ["rest", "cache", "parquet", "fixture"], "venue": ["rest", "cache", "parquet"]}.get(source, [source])
    notes = []
    for name in order:
        if name not in tiers and name != "fixture":
            notes.append(f"{name}: not given")
            continue
        try:
            rows = tiers[name]() if name in tiers else synthetic(spark)
            if rows is not None and rows.limit(min_rows).count() >= min_rows:
                return rows, name, "; ".join(notes) or "first choice"
            notes.append(f"{name}: fewer than {min_rows} rows")
        except Exception as e:  # noqa: BLE001  the next tier may do
            notes.append(f"{name}: {type(e).__name__}")
    raise ValueError(f"no bars from {source}: {'; '.join(notes)}")


def sample_kind(source_used: str) -> str:
    return {"rest": "venue", "cache": "venue", "parquet": "venue", "fixture": "synthetic_fixture"}.get(source_used, "unknown")


def read_file(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of a CSV or Parquet file, by suffix."""
    raw = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return normalize(raw, symbol if "symbol" not in raw.columns else None)


def write_journal(curve: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """The curve as Parquet and CSV, its summary as JSON lines."""
    curve.write.mode("overwrite").parquet(f"{path}/equity")
    curve.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/equity_csv")
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def append_json(rows: DataFrame, path: str) -> None:
    """Append-only log, without removing repeats."""
    rows.write.mode("append").json(path)


def html_report(summary: DataFrame, title: str, most: int = 1000) -> str:
    """A small summary as an HTML table, for presentation. Of more than ``most`` rows the first are shown, and the report says so."""
    import html

    rows, names = summary.limit(most + 1).collect(), summary.columns
    cell = lambda v: html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(r[n])}</td>" for n in names) + "</tr>" for r in rows[:most])
    cut = f"<p>The first {most} rows of more.</p>" if len(rows) > most else ""
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>{body}</table>{cut}</body></html>"
