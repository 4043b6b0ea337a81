"""Plans and skew: what must hold when one repository, table or statement is very large."""

import random

import pytest
from pyspark.sql import functions as F

from scriptlode.operators import analytics as A, catalog as C, ddl as D, query_facts as QF, scopes as Q, statements as S
from scriptlode.plans import queries as P
from scriptlode.session import cut

from .conftest import make_scripts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_corpus():
    """One repository holds most files, and one of its tables most definitions and inserts."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        repo = "https://example.org/u/hot" if i % 4 else f"https://example.org/u/r{i}"
        t = "big" if i % 3 else f"t{i % 7}"
        cols = ", ".join(f"c{j} int" for j in range(rng.randint(1, 5)))
        rows.append((repo, f"{i:03d}.sql", rng.choice([
            f"create table {t} (id int primary key, {cols}, foreign key (id) references t1 (id));",
            f"insert into {t} (id, c{i % 9}) values (1, 2);",
            f"alter table {t} add key k (c1), add z{i % 4} int;",
            f"select x.id, sum(y.c1) from {t} x join big y on x.id = y.id where x.c2 = 1 group by x.id;",
            f"create unique index u on {t} (id, c0);"])))
    return rows


def snapshot(c, q):
    def rows(df):
        return sorted((tuple(str(v) for v in r) for r in df.collect()))
    return {"tables": rows(c.tables), "columns": rows(c.columns.select("repo_url", "table_name", "col_name", "origin", "file_id")),
            "keys": rows(c.keys.select("repo_url", "table_name", "stmt_id", "key_type", "cols")),
            "fks": rows(c.fks.drop("fk_id")), "refs": rows(q.refs), "conds": rows(q.conditions),
            "joins": rows(q.binary_joins), "queries": rows(q.queries)}


def test_results_do_not_depend_on_partitioning(spark):
    scripts = make_scripts(spark, hot_corpus())
    seen = []
    for shuffles, df in (("1", scripts.coalesce(1)), ("7", scripts.orderBy(F.md5("text")).repartition(5))):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        c = C.build_catalog(S.statements(df))
        seen.append(snapshot(c, QF.build_query_facts(S.query_statements(df), c)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
    assert seen[0]["tables"] and seen[0]["joins"]


@pytest.fixture(scope="module")
def loaded(spark):
    return P.catalog(spark, SF), P.query_facts(spark, SF)


def test_no_cross_joins_and_no_python_in_plans(spark, loaded):
    for name, query in P.all_queries().items():
        text = plan(query(spark, SF))
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
            assert operator not in text, (name, operator)


def test_picks_are_cut_before_the_shuffle(spark, loaded):
    c, q = loaded
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        versions = C.table_versions(P.facts(spark, SF))
        for df in (C.pick_tables(versions), C.first_owner(c.columns), C.table_keys(c.all_tables),
                   A.keep_first(A.table_signatures(c.tables, c.columns)), A.failure_sample(q.failures)):
            text = plan(df)
            assert "WindowGroupLimit" in text and "Partial" in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_statement_and_fact_extraction_does_not_shuffle(spark):
    scripts = P.scripts(spark, SF).select("repo_url", "file_id", "text")
    base = plan(scripts).count("Exchange")
    stmts = S.statements(scripts)
    flat = S.query_statements(scripts)
    for df in (stmts, D.create_facts(stmts), D.alter_facts(stmts), D.insert_columns(stmts), flat):
        assert plan(df).count("Exchange") == base


def test_scopes_use_one_shuffle(spark, tmp_path):
    S.query_statements(P.scripts(spark, SF)).write.parquet(str(tmp_path / "q"))
    stmts = spark.read.parquet(str(tmp_path / "q"))
    assert plan(Q.scopes(stmts)).count("Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns(spark, loaded):
    c, _ = loaded
    text = plan(A.type_frequency(c.columns))
    assert "ReadSchema: struct<col_type:string>" in text


def test_long_statements_keep_every_column(spark):
    wide = "create table wide (" + ", ".join(f"col_{i} int not null" for i in range(1800)) + ", primary key (col_7))"
    deep = "create table deep (a int check (" + "(" * 300 + "a" + ")" * 300 + "), b int, key (b))"
    facts = {r["table_name"]: r for r in D.create_facts(S.statements(make_scripts(spark, {"f": wide + ";" + deep}))).collect()}
    assert len(facts["wide"]["cols"]) == 1800 and facts["wide"]["keys"][0]["cols"] == ["col_7"]
    assert [x["col_name"] for x in facts["deep"]["cols"]] == ["a", "b"]
    many = "select a from t where " + " and ".join(f"t.c{i} = u.d{i}" for i in range(900))
    parts = Q.scope_parts(Q.scopes(S.query_statements(make_scripts(spark, {"f": many}))))
    assert Q.join_candidates(Q.comparisons(parts)).count() == 900


def test_whole_texts_are_used(spark):
    """A fact at the end of a long script is found."""
    text = "-- filler\n" * 30000 + "insert into t (a) values (1);\n" * 2000 + "create table last_one (z int);"
    stmts = S.statements(make_scripts(spark, {"f": text}))
    assert stmts.count() == 2001 and stmts.filter("stmt like '%last_one%'").count() == 1


def test_odd_texts_do_not_break_the_patterns(spark):
    """Very long runs of one kind must not exhaust the stack of an executor thread."""
    texts = ["create table a (x int);" + "\n \t" * 100000 + "\nselect x from a", "/*" + "*" * 200000 + "*/ select x from a",
             "select x from a where x in (" + "1, " * 15000 + "2)", "select x from a where " + "(" * 20000 + "x = 1" + ")" * 20000,
             "select " + "a." * 20000 + "x from a", "insert into a (x) values " + "(1), " * 9000, "'" * 40001 + " select x from a",
             "create table b (x int default '" + "(" * 30000 + "', y int)", "create table c (" + "[" * 20000 + ", z int)",
             "select x from a join " + "b join " * 6000 + "c", "alter table a add " + "," * 40000 + " add q int"]
    scripts = make_scripts(spark, {str(i): t for i, t in enumerate(texts)})
    stmts, parts = S.statements(scripts), Q.scope_parts(Q.scopes(S.query_statements(scripts)))
    assert {r["file_id"] for r in parts.select("file_id").collect()} >= {"0", "1", "2", "3", "4", "6", "9"}
    assert [r["col_name"] for r in D.alter_columns(D.alter_facts(stmts)).collect()] == ["q"]
    names = {r["table_name"]: [x["col_name"] for x in r["cols"]] for r in D.create_facts(stmts).collect()}
    assert names["a"] == ["x"] and names["b"] == ["x", "y"] and "z" in names["c"]
    assert QF.mentions(parts).filter("lcol = 'x'").count() > 5
    assert S.join_like(scripts).count() > len(texts)


def test_hot_name_is_split(spark, tmp_path):
    """One column of one table gets nearly all mentions; its partition is split in the lookup."""
    c = C.build_catalog(S.statements(make_scripts(spark, {"f": "create table hot (id int, k int); create table cold (x int)"})))
    rows = (spark.range(60000).select(
        F.concat(F.col("id").cast("string"), F.lit("#q0#r")).alias("stmt_id"), F.lit("https://example.org/u1/r1").alias("repo_url"),
        F.concat(F.md5(F.col("id").cast("string")), F.md5(F.lit("x") )).alias("file_id"), F.lit(0).alias("lo"), F.lit(0).alias("seq"),
        F.lit("projection").alias("kind"), F.lit("").alias("side"), F.lit("").alias("func"), F.md5((F.col("id") * 7).cast("string")).alias("atom"),
        F.lit("named").alias("mode"), F.array(F.lit(0), F.lit(0)).alias("c_pos"),
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("hot").alias("table_ref"), F.lit("id").alias("lcol")))
    rows.repartition(12).write.parquet(str(tmp_path / "m"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.shuffle.partitions": "8",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = QF.resolved(spark.read.parquet(str(tmp_path / "m")), c)
        found = df.collect()
        assert "isSkewJoin=true" in df._jdf.queryExecution().executedPlan().toString() or "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found) == 60000
    assert sum(r["col_name"] == "id" for r in found) == 60000 - 1200


def test_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """Urls compress so well that a small file is a large table in memory; the driver must not collect it for a join."""
    url = F.concat(F.lit("https://example.org/" + "u" * 150 + "/repo"), F.col("id").cast("string"))
    made = cut(spark.range(60000).select(url.alias("repo_url"), F.col("id").alias("a")))
    size = made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10 * 2 ** 20  # below Spark's own limit, although the rows take more
    joined = made.join(made.select("repo_url", F.col("a").alias("b")), "repo_url")
    assert joined.count() == 60000
    counted = joined.groupBy("b").count()
    counted.collect()
    assert "BroadcastHashJoin" not in plan(joined) and "BroadcastHashJoin" not in plan(counted)


def test_statements_are_read_once(spark, tmp_path, monkeypatch):
    """The catalog and a query that parses statements again share one written table of statements."""
    spark.createDataFrame([(i, i % 10) for i in range(20)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    calls, read = [], P.S.statements
    monkeypatch.setattr(P.S, "statements", lambda *a, **k: calls.append(1) or read(*a, **k))
    assert P.d4_resolve_table(spark, str(tmp_path)).collect() and calls == [1]


def _corpus_of(spark, folder, n=20):
    """A folder with `n` parts of all templates and two suppliers."""
    spark.createDataFrame([(i, i % 10) for i in range(n)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def _not_needed(*args, **kwargs):
    raise AssertionError("built without need")


def test_lookups_of_table_names_build_no_columns_and_keys(spark, tmp_path, monkeypatch):
    """The names of a catalog are enough for a lookup, and the whole catalog goes on from them with the same rows."""
    sf = _corpus_of(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(P.C, "build_columns", _not_needed)
        m.setattr(P.C, "build_catalog", _not_needed)
        narrow = sorted(map(tuple, P.d10_name_variants(spark, sf).collect()))
    whole = P.catalog(spark, sf)
    assert narrow and whole.lookup is P.catalog_names(spark, sf).lookup
    assert sorted(map(tuple, P.d10_name_variants(spark, sf).collect())) == narrow
    alone = C.build_catalog(P.stmts(spark, sf))
    for name in ("tables", "columns", "keys", "fks", "later_keys"):
        rows = [sorted(map(str, getattr(c, name).collect())) for c in (whole, alone)]
        assert rows[0] and rows[0] == rows[1], name


def test_join_conditions_build_no_other_facts(spark, tmp_path, monkeypatch):
    """Sides of conditions need no catalog, failed conditions only its names and columns; all facts go on from them with the same rows."""
    sf = _corpus_of(spark, tmp_path, 60)
    names = ("e7_side_resolution", "e11_unfound_tables", "e11_failures", "f5_failure_sample")
    with monkeypatch.context() as m:
        m.setattr(P.QF, "build_query_facts", _not_needed)
        m.setattr(P.C, "build_catalog", _not_needed)
        with monkeypatch.context() as m2:
            m2.setattr(P.C, "build_names", _not_needed)
            assert P.e7_side_resolution(spark, sf).count() > 0
        narrow = {n: sorted(map(str, getattr(P, n)(spark, sf).collect())) for n in names}
    onward, alone = P.query_facts(spark, sf), QF.build_query_facts(S.query_statements(P.scripts(spark, sf)), P.catalog(spark, sf))
    assert onward.conditions is P._made(spark, sf, "conditions").conditions
    for name in vars(alone):
        rows = [sorted(map(str, getattr(q, name).collect())) for q in (onward, alone)]
        assert rows[0] and rows[0] == rows[1], name
    for name in names:
        assert narrow[name] and sorted(map(str, getattr(P, name)(spark, sf).collect())) == narrow[name], name
