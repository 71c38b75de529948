import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

import modelweave as mw
from modelweave import Model
from modelweave.plans import ast, text
from modelweave.queries import model as own_model
from modelweave.sources import entities, tables
from modelweave.streaming import flow


def _m(lower, upper=1):
    return {"lowerBound": lower} if upper is None else {"lowerBound": lower, "upperBound": upper}


def _class(name, properties, derived=(), constraints=(), supers=()):
    return {
        "content": {
            "_type": "class", "package": "t", "name": name, "superTypes": [f"t::{s}" for s in supers],
            "properties": [{"name": n, "type": k, "multiplicity": m, "taggedValues": [{"tag": {"value": "doc"}, "value": f"doc of {n}"}]} for n, k, m in properties],
            "qualifiedProperties": [{"name": n, "body": [ast.encode(text.parse(b))], "returnType": k, "returnMultiplicity": _m(1)} for n, k, b in derived],
            "constraints": [{"name": n, "functionDefinition": b if isinstance(b, dict) else {"_type": "lambda", "parameters": [], "body": [ast.encode(text.parse(b))]}} for n, b in constraints],
        }
    }


def _mapping(name, of, columns):
    table = {"_type": "Table", "schema": "s", "table": name}
    rows = [{"_type": "relationalPropertyMapping", "property": {"property": p}, "relationalOperation": {"_type": "column", "column": c}} for p, c in columns.items()]
    return {"content": {"_type": "mapping", "package": "m", "name": name, "classMappings": [{"_type": "relational", "class": f"t::{of}", "mainTable": table, "propertyMappings": rows}]}}


PERSON = _class("Person", [("first", "String", _m(1)), ("born", "Date", _m(1))], [("initial", "String", "$this.first->substring(0,1)")], [("[first] is short", "$this.initial == 'A'")])
SKILL = {"content": {"_type": "Enumeration", "package": "t", "name": "Skill", "values": [{"value": "SQL"}, {"value": "R"}]}}
WORKER = _class(
    "Worker",
    [("id", "Integer", _m(1)), ("skill", "t::Skill", _m(0)), ("joined", "Date", _m(1)), ("stars", "Integer", _m(0))],
    [("age", "Integer", "$this.born->dateDiff($this.joined,DurationUnit.YEARS)"), ("twice", "Integer", "$this.age + $this.age")],
    [("[stars] positive", "$this.stars > 0"), ("[age] over 18", "$this.age > 18")],
    ["Person"],
)
COLUMNS = {"first": "first_name", "born": "birth", "id": "id", "skill": "skill", "joined": "joined_date", "stars": "n_stars"}
DOCS = [PERSON, SKILL, WORKER, _mapping("worker", "Worker", COLUMNS)]


@pytest.fixture(scope="module")
def model():
    return Model(entities.decode(DOCS))


def _worker(id=1, first="Ann", born=dt.date(1990, 5, 1), skill="SQL", joined=dt.date(2015, 1, 1), stars=3):
    return Row(first=first, born=born, id=id, skill=skill, joined=joined, stars=stars)


@pytest.fixture(scope="module")
def workers(spark, model):
    rows = [
        _worker(), _worker(id=None), _worker(id=3, skill="C"), _worker(id=4, joined=dt.date(2000, 1, 1)), _worker(id=None, skill="C"),
        _worker(id=6, born=None), _worker(id=7, stars=None), _worker(id=8, skill=None),
    ]
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in model.schema("t::Worker")])
    return spark.createDataFrame(rows, loose)


def test_schema(model):
    schema = model.schema("t::Worker")
    assert schema.simpleString() == "struct<first:string,born:date,id:int,skill:string,joined:date,stars:int>"
    assert [f.nullable for f in schema] == [False, False, False, True, False, True]
    assert schema["id"].metadata == {"comment": "doc of id"}
    assert model.schema("m::worker").names == list(COLUMNS.values())
    with pytest.raises(ValueError):
        model.schema("t::Skill")


@pytest.mark.parametrize(
    "name, kind",
    [("String", "string"), ("Boolean", "boolean"), ("Byte", "tinyint"), ("Binary", "binary"), ("Integer", "int"), ("Short", "smallint"), ("Number", "bigint"),
     ("Float", "float"), ("Decimal", "double"), ("Date", "date"), ("StrictDate", "date"), ("DateTime", "timestamp")],
)
def test_types(name, kind):
    own = Model(entities.decode([_class("A", [("x", name, _m(0)), ("y", name, _m(1, None))])]))
    assert own.schema("t::A").simpleString() == f"struct<x:{kind},y:array<{kind}>>"


def test_bad_entities(tmp_path, model):
    with pytest.raises(ValueError):
        Model(entities.decode([_class("A", [("x", "Odd", _m(0))])])).schema("t::A")
    with pytest.raises(ValueError, match="doesn't exist"):
        Model(entities.decode([_class("A", [("x", "t::B", _m(0))])]))
    with pytest.raises(ValueError, match="contains itself"):
        Model(entities.decode([_class("A", [("x", "t::A", _m(0))])])).schema("t::A")
    with pytest.raises(ValueError, match="no column"):
        Model(entities.decode([PERSON, _mapping("p", "Person", {"first": "f"})])).schema("m::p")
    with pytest.raises(ValueError):
        model.entity("t::None")
    with pytest.raises(ValueError):
        model.transformations("t::Worker")
    with pytest.raises(FileNotFoundError):
        Model.from_directory(str(tmp_path / "none"))
    (tmp_path / "file").write_text("")
    with pytest.raises(NotADirectoryError):
        Model.from_directory(str(tmp_path / "file"))
    with pytest.raises(ValueError, match="no entities"):
        Model.from_directory(str(tmp_path))
    (tmp_path / "a.json").write_text(json.dumps(PERSON))
    assert Model.from_directory(str(tmp_path)).entity_names() == {"t::Person"}
    assert "trade::mapping::order" in own_model().entity_names()


def test_expectation_texts(model):
    assert model.expectations("t::Worker") == {
        "[first] is mandatory": "first IS NOT NULL", "[born] is mandatory": "born IS NOT NULL", "[id] is mandatory": "id IS NOT NULL",
        "[skill] not allowed value": "skill IS NULL OR skill IN ('SQL', 'R')", "[joined] is mandatory": "joined IS NOT NULL",
    }
    assert model.expectations("m::worker")["[stars] positive"] == "(n_stars IS NOT NULL AND n_stars > 0)"
    assert model.expectations("m::worker")["[age] over 18"] == "year(joined_date) - year(birth) > 18"
    assert model.expectations("m::worker", compile=False)["[age] over 18"] == "$this.age > 18"
    assert model.derivations("m::worker", compile=False)["age"] == "$this.born->dateDiff($this.joined,DurationUnit.YEARS)"
    # a constraint of the supertype reads a derived property that the subclass lacks: it fails alone
    assert isinstance(model.expectations("m::worker")["[first] is short"], ValueError)
    assert "initial" in model.derivations("m::worker", inherit=True)


def test_bad_rule_fails_alone():
    bad = _class("A", [("x", "Integer", _m(1))], constraints=[("odd", {"_type": "lambda", "body": [{"_type": "odd"}], "parameters": []}), ("fine", "$this.x > 1")])
    own = Model(entities.decode([bad, _mapping("a", "A", {"x": "x"})]))
    got = own.expectations("m::a")
    assert isinstance(got["odd"], ValueError) and got["fine"] == "x > 1"


def test_medallion(spark, model, workers):
    checked = model.validate(model.transform(workers, "m::worker"), "m::worker")
    assert checked.schema["violations"].dataType == T.ArrayType(T.StringType(), False) or checked.schema["violations"].dataType.elementType == T.StringType()
    got = [sorted(r["violations"]) for r in checked.collect()]
    assert got == [
        [], ["[id] is mandatory"], ["[skill] not allowed value"], ["[age] over 18"], ["[id] is mandatory", "[skill] not allowed value"],
        ["[age] over 18", "[born] is mandatory"], ["[stars] positive"], [],
    ]
    counts = {r["violations"]: r["count"] for r in mw.violation_counts(checked).collect()}
    assert counts == {"[id] is mandatory": 2, "[skill] not allowed value": 2, "[age] over 18": 2, "[born] is mandatory": 1, "[stars] positive": 1}
    assert mw.explode_violations(checked).count() == 8
    derived = model.derive(checked, "m::worker").collect()
    assert (derived[0]["age"], derived[0]["twice"], derived[5]["age"]) == (25, 50, None)
    # SQL texts and columns agree
    by_text = mw.validate(model.transform(workers, "m::worker"), {k: v for k, v in model.expectations("m::worker").items() if isinstance(v, str)})
    assert [sorted(r["violations"]) for r in by_text.collect()] == got


def test_strict_query_keeps_clean_rows(spark, model, workers):
    frame = model.transform(workers, "m::worker")
    clean = {r["id"] for r in model.validate(frame, "m::worker").where(F.size("violations") == 0).collect()}
    assert {r["id"] for r in model.query(spark, "m::worker", lambda _: frame, strict=True).collect()} == clean
    loose = {r["id"] for r in model.query(spark, "m::worker", lambda _: frame).collect()}
    assert loose == clean | {4}  # the rule on a derived property isn't applied


def test_query_text_runs_as_sql(spark, model, workers):
    model.transform(workers, "m::worker").createOrReplaceTempView("worker")
    sql = model.sql("m::worker").replace("s.worker", "worker")
    assert sorted(spark.sql(sql).collect(), key=str) == sorted(model.query(spark, "m::worker", lambda _: spark.table("worker")).collect(), key=str)


@pytest.mark.parametrize(
    "question, sql",
    [
        ("t::Worker->getAll()->filter(x|$x.stars > 2)", "(`root`.n_stars is not null and `root`.n_stars > 2)"),
        ("t::Worker->getAll()->filter(x|$x.first->in(['a', 'b']))", "`root`.first_name in ('a', 'b')"),
        ("t::Worker->getAll()->filter(x|$x.id->isEmpty())", "`root`.id is null"),
        ("t::Worker->getAll()->filter(x|!$x.skill->isEmpty())", "not `root`.skill is null"),
        ("t::Worker->getAll()->filter(x|$x.age > 20)", "year(`root`.joined_date) - year(`root`.birth) > 20"),
    ],
)
def test_filter_sql(model, question, sql):
    assert model.explain(question, "m::worker") == f"select * from s.worker as `root` where {sql}"


def test_query_errors(spark, model):
    for bad in ("t::None->getAll()->filter(x|$x.a > 1)", "t::Worker->getAll()->filter(x|$x.nothing > 1)", "t::Worker->getAll()->jump(1)", "$x.a"):
        with pytest.raises(ValueError):
            model.explain(bad, "m::worker")


def test_nested_and_array_rules(spark):
    child = _class("Child", [("name", "String", _m(1)), ("level", "t::Skill", _m(0))])
    top = _class("Top", [("must", "t::Child", _m(1)), ("may", "t::Child", _m(0)), ("all", "t::Child", _m(0, None)), ("some", "String", _m(1, 3)), ("skills", "t::Skill", _m(0, None))])
    own = Model(entities.decode([SKILL, child, top]))
    rules = own.rules("t::Top")
    assert "[must.name] is mandatory" in rules and "[may.name] is mandatory" in rules and not any(n.startswith("[all.") for n in rules)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema("t::Top")])
    good, bad = ("n", "R"), ("n", "C")
    rows = [(good, good, [], ["a"], ["R", "SQL"]), (bad, None, None, [], ["R", "C"]), (None, good, None, ["a"] * 4, None)]
    got = [r["violations"] for r in own.validate(spark.createDataFrame(rows, schema), "t::Top").collect()]
    assert got == [
        [],
        ["[must.level] not allowed value", "[may.name] is mandatory", "[some] has invalid size", "[skills] not allowed value"],
        ["[must] is mandatory", "[must.name] is mandatory", "[some] has invalid size"],
    ]


def test_rename_swaps_and_passes_through(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, other int")
    assert mw.transform(df, {"a": "b", "b": "a", "none": "x"}).columns == ["b", "a", "other"]


def test_validate_without_rules(spark):
    assert mw.validate(spark.range(1), {}).collect()[0]["violations"] == []


def test_tables(spark, model, workers, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS s")
    name = model.create_table(spark, "m::worker", f"file://{tmp_path}/worker")
    assert name == "s.worker" == model.create_table(spark, "m::worker")
    assert all(f.nullable for f in spark.table(name).schema)
    frame = model.transform(workers, "m::worker")
    tables.append(frame, name)
    with pytest.raises(ValueError, match="has no column"):
        tables.append(frame.withColumn("new", F.lit(1)), name)
    tables.append(frame.withColumn("new", F.lit(1)), name, evolve=True)
    assert spark.table(name).where("new IS NULL").count() == 8 and spark.table(name).count() == 16
    assert tables.describe(spark, name).count() > 6
    with pytest.raises(NotImplementedError):
        tables.history(spark, name)
    text_ = mw.from_table(spark, "a::b", "s", "worker")
    assert mw.is_valid(text_) and mw.is_valid(mw.from_database(spark, "a::b", "s"))
    spark.sql("DROP TABLE s.worker")


def test_stream(spark, model, workers, tmp_path):
    workers.write.json(f"{tmp_path}/in")
    stream = flow.apply(model, "m::worker", flow.read_json(spark, model, f"{tmp_path}/in", "t::Worker"))
    flow.write(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.where(F.size("violations") > 0).count() == 6


def test_filters_and_columns_reach_the_scan(spark, tmp_path, model, workers):
    model.transform(workers, "m::worker").write.parquet(f"{tmp_path}/w")
    df = model.ask(spark, "t::Worker->getAll()->filter(x|$x.stars > 2)->project([x|$x.id], ['id'])", "m::worker", lambda _: spark.read.parquet(f"{tmp_path}/w"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_stars,2)" in plan and "ReadSchema: struct<id:int,n_stars:int>" in plan
