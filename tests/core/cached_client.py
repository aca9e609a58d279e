"""A client of bars for tests."""


def page(symbol, interval, start, limit):
    every = [] if symbol == "NONE" else [[86_400_000 * i, 1, 2, 0.5, 1.5, len(symbol)] for i in range(12)]
    return [r for r in every if r[0] >= start][:limit]
