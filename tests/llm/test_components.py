from skyledger.llm import components as module


def counted(monkeypatch):
    tables, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: tables.append(df) or cut(df))
    return tables


def test_stars_take_no_round(frame, monkeypatch):
    tables = counted(monkeypatch)
    pairs = [(i % 7, i) for i in range(7, 60)] + [(None, 3), (9, None), (5, 5)]
    got = {r.node: r.component for r in module.components(frame(pairs, "a long, b long")).collect()}
    assert got == {i: i % 7 for i in range(60)}
    assert len(tables) == 1  # the links themselves


def test_a_round_that_ends_in_stars_is_the_last(frame, monkeypatch):
    tables = counted(monkeypatch)
    pairs = [(1, 2), (2, 3), (3, 4), (8, 9), (10, 9), (10, 10)]
    rows = module.components(frame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (10, 8)]
    assert len(tables) % 2 == 1 and len(tables) <= 5
