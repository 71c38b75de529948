import datetime as dt
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from modelweave import queries, scenarios
from modelweave.plans import lower, text

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(names, rows):
    """Rows as texts, columns by name, numbers without regard to their kind."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(str([_plain(r[k]) for k in order]) for r in rows)


def _plain(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = queries.queries()[name](spark, str(DATA))
    want = duck.execute(queries.oracle_sql()[name])
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())


def _expression(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["$this.line", "$this.age", "$this.days", "$this.twice", str(rng.randint(0, 9))])
    sides = [_expression(rng, depth - 1) for _ in range(2)]
    return f"({sides[0]}) {rng.choice('+-*')} ({sides[1]})"


def test_sql_text_equals_columns(spark):
    model, rng = scenarios.model(), random.Random(8)
    scope = model._scope(model.mapping_of("map::sales"))
    texts = [_expression(rng, 3) for _ in range(40)]
    texts += [f"({a}) {op} ({b})" for a, b, op in ((_expression(rng, 2), _expression(rng, 2), op) for op in (">", ">=", "<", "<=", "==") for _ in range(4))]
    texts += [f"!({a}) || ({b}) == ({c})" for a, b, c in zip(texts[-9:-6], texts[-6:-3], texts[-3:])]
    rows = [(1, dt.date(1995, 3, 1), dt.date(1997, 2, 1), 4, 1.5), (2, dt.date(1995, 12, 31), dt.date(1996, 1, 1), 1, None), (3, dt.date(1995, 1, 1), None, 7, 2.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, o_orderdate date, l_shipdate date, l_linenumber int, l_extendedprice double")
    nodes = [text.parse(t) for t in texts]
    by_column = df.select(*(lower.lower(n, scope, lower.ColumnTarget()).value.alias(f"c{k}") for k, n in enumerate(nodes))).collect()
    by_text = df.select(*(F.expr(lower.lower(n, scope, lower.SqlTarget()).value).alias(f"c{k}") for k, n in enumerate(nodes))).collect()
    for k, t in enumerate(texts):
        assert [r[k] for r in by_column] == [r[k] for r in by_text], t


def test_order_of_steps_in_text(spark):
    model = scenarios.model()
    rows = [(k, dt.date(1990 + k, 1, 1), dt.date(1995, 1, 1), k % 3, float(k * 7 % 10)) for k in range(10)]
    df = spark.createDataFrame(rows, "l_orderkey long, o_orderdate date, l_shipdate date, l_linenumber int, l_extendedprice double")
    first = "project([x|$x.key, x|$x.line, x|$x.amount], ['a', 'b', 'c'])->sort([desc('c'), asc('a')])"
    for more in ("take(5)->sort([asc('a')])", "take(5)->take(3)", "take(6)->filter(x|$x.b > 0)", "take(6)->groupBy([x|$x.b], [agg(x|$x.a, y|$y->count())], ['b', 'n'])", "sort([asc('a')])->take(4)", "filter(x|$x.c > 2 && $x.b > 0)->project([x|$x.a + $x.b], ['s'])"):
        asked = f"shop::Sale->getAll()->{first}->{more}"
        own = model.ask(spark, asked, "map::sales", lambda _: df).collect()
        by_text = spark.sql(model.explain(asked, "map::sales").replace("shop.sales", "{t}"), t=df).collect()
        assert sorted(own) == sorted(by_text) and own, more


def test_steps_read_what_came_out():
    with pytest.raises(ValueError, match="no column amount"):
        scenarios.model().explain("shop::Sale->getAll()->project([x|$x.key], ['a'])->filter(x|$x.amount > 1)", "map::sales")


def test_dates_in_text():
    node = text.parse("$this.ordered > %2020-02-29")
    assert text.to_text(node) == "$this.ordered > %2020-02-29"
    from modelweave.plans import ast

    assert ast.decode(ast.encode(node)) == node
