import pytest
from hypothesis import given
from hypothesis import strategies as st

from fluxmill.config import TARGETS, Env, Geofence, param
from fluxmill.plans.migrate import FOLDER, Runner, discover
from fluxmill.plans.statements import Executor, columns_view, list_tables, render, split_at, split_statements


@pytest.mark.parametrize("sql, n", [("a;b", 2), ("'x;y';z", 2), ("'it''s;';", 1), ("-- c;\nq", 1), ("/* ; */ q", 1), ("`a;b`", 1), ('"a;b"', 1), ("", 0), (";;", 0), ("f(a;b", 2), ("a /* b", 1)])
def test_split(sql, n):
    assert len(split_statements(sql)) == n


def test_split_drops_comments_but_not_their_marks_in_strings():
    assert split_statements("select '--x', \"/*y*/\" -- gone\n from t") == ["select '--x', \"/*y*/\" \n from t"]
    assert split_at("a = f(x, y), b = 'c,d'", ",") == ["a = f(x, y)", " b = 'c,d'"]


literal = st.text(alphabet=st.sampled_from(list("ab;-/*\"` \n")), max_size=8).map(lambda s: "'" + s.replace("'", "''") + "'")
plain = st.text(alphabet=st.sampled_from(list("abc ,")), min_size=1, max_size=6).filter(str.strip)


@given(st.lists(st.lists(st.one_of(literal, plain), min_size=1, max_size=4).map("".join).filter(str.strip), max_size=5))
def test_joined_statements_split_again(parts):
    assert split_statements(";".join(parts)) == [p.strip() for p in parts]


@given(st.text(alphabet=st.sampled_from(list("a;'\"`-/*\n")), max_size=40))
def test_any_text_splits_without_semicolons_outside_quotes(sql):
    for s in split_statements(sql):
        assert split_statements(s) in ([s], [s.strip()]) or "--" in s or "/*" in s or "'" in s or '"' in s or "`" in s


def test_render():
    assert render("${a}.${b} ${c}", {"a": 1, "b": "${a}"}) == "1.${a} ${c}"


def test_environments():
    assert {t: Env.from_params("/r", {"schema": t}).batches for t in TARGETS} == {"dev": 20, "test": 10, "prod": 5}
    env = Env.from_params("/r/", {"schema": " prod ", "geofence_name": "g", "geofence_min_lat": "1.5"})
    assert env.geofence == Geofence("g", min_lat=1.5) and env.table("t") == "telematics.prod.t"
    assert env.checkpoint_path("s") != Env.from_params("/r", {"schema": "dev"}).checkpoint_path("s")
    assert param(None, "x", " d ") == "d" and param({"x": " v "}, "x") == "v"
    with pytest.raises(AttributeError):
        env.schema = "other"


def test_migrations(spark, tmp_path):
    env = Env(str(tmp_path))
    runner = Runner(spark, env)
    assert [x[2] for x in runner.run("001")] == ["applied", "held back", "held back"]
    count = lambda: columns_view(spark, env).where("table_name = 'gold_truck_current_position'").count()
    assert count() == 11 and len(list_tables(spark, env)) == 7
    assert [x[2] for x in runner.run()] == ["already applied", "applied", "applied"] and count() == 14
    assert [x[2] for x in runner.run()] == ["already applied"] * 3
    assert [r["statements"] for r in runner.table().collect()] == [6, 2, 2]
    assert [r["comment"] for r in columns_view(spark, env).where("column_name = 'geofence_name'").collect()] == ["the box meant; it differs by environment"]
    # a lost ledger is rebuilt: tables and columns that are there don't stop it
    runner.ledger.delete(__import__("pyspark").sql.functions.lit(True))
    assert [x[2] for x in Runner(spark, env).run()] == ["applied"] * 3 and count() == 14


def test_edited_and_failing_migrations(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "001_a.sql").write_text("CREATE TABLE t (k STRING NOT NULL, v INT)")
    (folder / "002_b.sql").write_text("INSERT INTO t SELECT 'a', 1; INSERT INTO missing SELECT 1")
    env = Env(str(tmp_path / "e"))
    with pytest.raises(FileNotFoundError):
        Runner(spark, env, folder).run()
    assert set(Runner(spark, env, folder).applied()) == {"001"}
    (folder / "002_b.sql").write_text("UPDATE t SET v = v + 1 WHERE k = 'a'")
    (folder / "001_a.sql").write_text("CREATE TABLE IF NOT EXISTS t (k STRING NOT NULL, v INT) -- edited")
    assert [x[2] for x in Runner(spark, env, folder).run()] == ["applied", "applied"]
    assert Executor(spark, env).execute("SELECT v FROM t").first()["v"] == 2
    with pytest.raises(ValueError):
        Executor(spark, env).execute("CREATE TABLE t (k STRING)")
    with pytest.raises(ValueError):
        Executor(spark, env).execute("DELETE FROM other.t")


def test_files_are_what_the_ledger_expects():
    assert [len(split_statements(m.text)) for m in discover(FOLDER)] == [6, 2, 2]
