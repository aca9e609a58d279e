"""Path-dependent books as folds: one pure step a bar, one group a session or scenario.

``FuturesBook`` is a margin book with a risk gate; ``EquityBook`` a cash book that rebalances to
weights. A fold runs as a grouped map over ordered bars here and as keyed state over a stream in
``tickwell.streaming``; both call the same step, so their rows agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

FLAT = 1e-12
DUST = 1e-6


@dataclass
class RiskLimits:
    """Caps on notional and leverage, the drawdown that ends a session, and the loss from its start that halts it until equity is ``hysteresis`` above the floor again."""

    order_notional: float = 5_000.0
    position_notional: float = 15_000.0
    daily_loss: float = 500.0
    leverage: float = 5.0
    drawdown: float = 0.15
    hysteresis: float = 0.0
    live: bool = False


@dataclass
class RiskGate:
    limits: RiskLimits
    start: float
    peak: float = 0.0
    worst: float = 0.0
    invalidated: bool = False
    halted: bool = False
    rejects: int = 0

    def __post_init__(self) -> None:
        self.peak = self.peak if self.peak > 0 else self.start

    @property
    def floor(self) -> float:
        return self.start - self.limits.daily_loss

    def drawdown(self, equity: float) -> float:
        return max(0.0, 1 - equity / self.peak) if self.peak > 0 else 0.0

    def update(self, equity: float) -> None:
        self.peak = max(self.peak, equity)
        now = (self.peak - equity) / self.peak if self.peak > 0 else 0.0
        self.worst = max(self.worst, now)
        if 0 < self.limits.drawdown <= now + FLAT:
            self.invalidated = True
        if self.halted:
            self.halted = equity < self.floor + self.limits.hysteresis
        else:
            self.halted = equity < self.floor

    def phase(self, liquidated: bool = False) -> str:
        states = (("LIQUIDATED", liquidated), ("INVALIDATED", self.invalidated), ("LOSS_HALTED", self.halted), ("LIVE_BLOCKED", self.limits.live))
        return next((name for name, on in states if on), "ACTIVE")

    def cut(self, target: float, mark: float, equity: float, qty: float, leverage: float) -> tuple[bool, float, str]:
        """Whether to trade, the leverage to go to, and why. Hard stops come first and only ever go flat; then the caps on leverage, position and order."""
        stop = "live_blocked" if self.limits.live else "invalid_mark_or_equity" if mark <= 0 or equity <= 0 else None
        flat = None if stop else "invalidated" if self.invalidated else "loss_halted" if self.halted else None
        if stop or flat:
            self.rejects += bool(stop) or abs(target) > FLAT
            return not stop, 0.0, stop or flat or ""
        sign = lambda x: 1.0 if x >= 0 else -1.0
        within = min(abs(target), min(self.limits.leverage, leverage) if leverage > 0 else self.limits.leverage)
        within = min(within, self.limits.position_notional / equity)
        wanted = within * sign(target)
        move = wanted * equity / mark - qty
        if abs(move) * mark > self.limits.order_notional + 1e-9:
            move = sign(move) * self.limits.order_notional / mark
            wanted = (qty + move) * mark / equity
            wanted = sign(wanted) * min(abs(wanted), self.limits.position_notional / equity)
        if abs(wanted) < FLAT < abs(target) and abs(move) * mark < 1e-9:
            self.rejects += 1
            return False, 0.0, "order_dust"
        return True, wanted, "ok" if abs(wanted - target) <= FLAT else "ok_clipped"


@dataclass
class FuturesBook:
    """Isolated-margin book of one symbol: wallet, signed quantity, entry price.

    Each leg pays its fee from the wallet; each bar pays funding on the notional (longs pay a positive
    rate). Exposure grows only as far as free margin goes. Equity below maintenance closes all for good.
    """

    wallet: float = 10_000.0
    fee_bps: float = 4.0
    maintenance: float = 0.005
    funding_rate: float = 0.0
    leverage: float = 3.0
    qty: float = 0.0
    entry: float = 0.0
    liquidated: bool = False
    funding: float = 0.0
    n_fills: int = 0
    fills: list[tuple] = field(default_factory=list)

    def equity(self, mark: float) -> float:
        return self.wallet + self.qty * (mark - self.entry)

    def margin(self, mark: float) -> float:
        return abs(self.qty) * mark / self.leverage

    def _open(self, size: float, price: float) -> float:
        """Add up to ``size`` (signed), as free margin allows; what was added."""
        rate = self.fee_bps / 1e4
        free = self.equity(price) - self.margin(price)
        most = max(0.0, free) / (price / self.leverage + price * rate)
        size = max(-most, min(most, size))
        if abs(size) < FLAT:
            return 0.0
        held = abs(self.qty)
        self.entry = (held * self.entry + abs(size) * price) / (held + abs(size))
        self.qty += size
        self.wallet -= abs(size) * price * rate
        return size

    def order(self, ts, size: float, price: float, note: str = "") -> None:  # noqa: ANN001
        """Trade ``size`` (signed) at ``price``: what is against the position closes it, the rest opens or adds. One fill."""
        if self.liquidated or abs(size) < FLAT or price <= 0:
            return
        before, gain, closed = self.wallet, 0.0, 0.0
        if self.qty * size < 0:
            closed = -self.qty if abs(size) >= abs(self.qty) else size
            gain = -closed * (price - self.entry)
            self.wallet += gain - abs(closed) * price * self.fee_bps / 1e4
            self.qty += closed
            if abs(self.qty) < FLAT:
                self.qty = self.entry = 0.0
        opened = self._open(size - closed, price) if abs(size - closed) > FLAT else 0.0
        if closed or opened:
            self.n_fills += 1
            self.fills.append((ts, "buy" if size > 0 else "sell", abs(closed + opened), price, before + gain - self.wallet, gain, note))

    def target(self, ts, leverage: float, mark: float, note: str = "") -> None:  # noqa: ANN001
        equity = self.equity(mark)
        size = leverage * equity / mark - self.qty if mark > 0 and equity > 0 else 0.0
        if abs(size) * mark >= DUST:
            self.order(ts, size, mark, note)

    def settle(self, mark: float) -> float:
        """Pay a bar's funding; the equity after it."""
        if self.funding_rate and not self.liquidated:
            paid = self.qty * mark * self.funding_rate
            self.wallet -= paid
            self.funding += paid
        return self.equity(mark)

    def check(self, ts, mark: float) -> None:  # noqa: ANN001
        need = abs(self.qty) * mark * self.maintenance
        if not self.liquidated and need > 0 and self.equity(mark) + 1e-9 < need:
            self.order(ts, -self.qty, mark, "liquidation")
            self.liquidated = True


STATE = "wallet double, qty double, entry double, liquidated boolean, funding double, n_fills long, start double, peak double, worst double, invalidated boolean, halted boolean, rejects long"
CURVE = "ts timestamp_ntz, close double, target double, allowed double, reason string, phase string, qty double, wallet double, equity double, funding double, drawdown double, n_fills long, n_rejects long"


@dataclass
class Session:
    """A book and its gate; ``step`` takes a bar and its wanted leverage to a row of CURVE, or to None once liquidated. Without ``watched`` the gate never sees the equity."""

    book: FuturesBook
    gate: RiskGate
    watched: bool = True

    @staticmethod
    def new(capital: float = 10_000.0, limits: RiskLimits | None = None, watched: bool = True, **book: float) -> Session:
        return Session(FuturesBook(wallet=capital, **book), RiskGate(limits or RiskLimits(), capital), watched)

    def state(self) -> tuple:
        """All that the next step needs besides the parameters: STATE."""
        b, g = self.book, self.gate
        return (b.wallet, b.qty, b.entry, b.liquidated, b.funding, b.n_fills, g.start, g.peak, g.worst, g.invalidated, g.halted, g.rejects)

    def resume(self, state: tuple) -> Session:
        b, g = self.book, self.gate
        b.wallet, b.qty, b.entry, b.liquidated, b.funding, b.n_fills, g.start, g.peak, g.worst, g.invalidated, g.halted, g.rejects = state
        return self

    def step(self, ts, close: float, target: float) -> tuple | None:  # noqa: ANN001
        book, gate = self.book, self.gate
        if book.liquidated:
            return None
        equity = book.equity(close)
        if self.watched:
            gate.update(equity)
        go, allowed, reason = gate.cut(target, close, max(equity, 1e-9), book.qty, book.leverage)
        if go:
            book.target(ts, allowed, close, reason)
        after = book.settle(close)
        qty, wallet = book.qty, book.wallet
        book.check(ts, close)  # the row shows the book before a liquidation
        if self.watched:
            gate.update(book.equity(close))
        return (ts, close, target, allowed, reason, gate.phase(book.liquidated), qty, wallet, after, book.funding, gate.drawdown(after), book.n_fills, gate.rejects)


def run_sessions(targets: DataFrame, by: Sequence[str] = ("symbol",), capital: float = 10_000.0, limits: RiskLimits | None = None, watched: bool = True, **book: float) -> DataFrame:
    """Curves of one session for each ``by`` over (by, ts, close, target), in time order. Scenarios run side by side; a session ends with its liquidation."""
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), CURVE])

    def run(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        session, out = Session.new(capital, limits, watched, **book), []
        for ts, close, target in one.sort_values("ts")[["ts", "close", "target"]].itertuples(index=False):
            if (row := session.step(ts, float(close), float(target))) is None:
                break
            out.append((*key, *row))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return targets.groupBy(*by).applyInPandas(run, schema)


@dataclass
class EquityBook:
    """Long-only cash book: sells first, then buys as far as the cash goes."""

    cash: float = 1_000_000.0
    fee_rate: float = 5e-4
    qty: dict[str, float] = field(default_factory=dict)
    fills: list[tuple] = field(default_factory=list)

    def equity(self, prices: dict[str, float]) -> float:
        return self.cash + sum(q * prices.get(s, 0.0) for s, q in self.qty.items())

    def trade(self, ts, symbol: str, delta: float, price: float) -> None:  # noqa: ANN001
        if delta < 0:
            delta = -min(-delta, self.qty.get(symbol, 0.0))
        else:
            delta = min(delta, max(0.0, self.cash) / (price * (1 + self.fee_rate)))
        if abs(delta) <= FLAT:
            return
        fee = abs(delta) * price * self.fee_rate
        self.cash -= delta * price + fee
        self.qty[symbol] = self.qty.get(symbol, 0.0) + delta
        if self.qty[symbol] <= FLAT:
            del self.qty[symbol]
        self.fills.append((ts, symbol, "buy" if delta > 0 else "sell", abs(delta), price, fee))

    def rebalance(self, ts, weights: dict[str, float], prices: dict[str, float], band: float = 0.0) -> None:  # noqa: ANN001
        for buying in (False, True):
            equity = self.equity(prices)
            for s in sorted({*weights, *self.qty}):
                price = prices.get(s)
                if not price or price <= 0:
                    continue
                gap = weights.get(s, 0.0) * equity - self.qty.get(s, 0.0) * price
                if (gap > 0) == buying and abs(gap) > band * equity and abs(gap) > FLAT:
                    self.trade(ts, s, gap / price, price)


def run_equity(plan: DataFrame, by: Sequence[str] = ("run_id",), capital: float = 1_000_000.0, fee_rate: float = 5e-4, band: float = 0.0) -> DataFrame:
    """(by, ts, cash, equity, gross, n_positions, n_fills): a book for each ``by`` over (by, ts, symbol, close, weight); a date whose weights are all null is only marked."""
    kinds = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "ts timestamp_ntz, cash double, equity double, gross double, n_positions long, n_fills long"])

    def run(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        book, out, last = EquityBook(capital, fee_rate), [], {}
        for ts, day in one.sort_values(["ts", "symbol"]).groupby("ts", sort=True):
            last.update({s: float(p) for s, p in zip(day["symbol"], day["close"], strict=True) if p == p})
            wanted = day.dropna(subset=["weight"])
            if len(wanted):
                book.rebalance(ts, dict(zip(wanted["symbol"], wanted["weight"].astype(float), strict=True)), last, band)
            equity = book.equity(last)
            out.append((*key, ts, book.cash, equity, (equity - book.cash) / equity if equity else 0.0, len(book.qty), len(book.fills)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return plan.groupBy(*by).applyInPandas(run, schema)
