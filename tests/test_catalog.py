from pyspark.sql import functions as F

from scriptlode.operators import analytics as A, catalog as C, export as E

from .conftest import catalog_of, listed, make_scripts  # noqa: F401


def test_version_choice_and_lost_columns(spark):
    c = catalog_of(spark, {
        "a.sql": "create table t (id int, gone int)",
        "b.sql": "create table t (id int primary key, x int, y int)",
        "c.sql": "create table t (id int, x int, y int)",
        "d.sql": "create table u (id int)", "e.sql": "create table u (k int)"})
    assert listed(c.picked, "table_name", "file_id", "n_cols", "n_keys") == [
        ("t", "b.sql", 3, 1), ("u", "e.sql", 1, 0)]
    dropped = C.dropped_versions(c.versions, c.picked)
    assert listed(dropped, "table_name", "file_id") == [("t", "a.sql"), ("t", "c.sql"), ("u", "d.sql")]
    assert [n for _, n in listed(C.lost_columns(dropped), "stmt_id", "n_lost")] == [1, 0, 1]
    # Winners and dropped versions are all versions.
    assert c.picked.count() + dropped.count() == c.versions.count()


def test_resolution_stays_in_the_repository(spark):
    c = catalog_of(spark, [
        ("https://example.org/u/a", "1.sql", "create table p (id int primary key)"),
        ("https://example.org/u/b", "2.sql", "create table c (id int, foreign key (id) references p (id))")])
    assert listed(c.fks, "table_ref", "resolved") == [("c", False)]
    assert listed(C.fk_unresolved(c.fks), "table_ref", "cols", "ref_table", "ref_cols") == [("c", "id", "p", "id")]


def test_fk_declared_before_its_target(spark):
    c = catalog_of(spark, {
        "1.sql": "create table c (pid int, constraint f foreign key (PID) references S.P (ID));",
        "2.sql": "create table s.p (Id int primary key);"})
    assert listed(C.foreign_keys(c.fks), "table_name", "cols", "ref_name", "ref_cols") == [("c", "pid", "s.p", "Id")]


def test_exact_name_before_other_spellings(spark):
    c = catalog_of(spark, {"1.sql": """create table Trig (a int); create table trig (b int);
        create table dbo.trig (c int); create table x.only_here (d int); create table #tmp (e int)"""})
    refs = spark.createDataFrame([("https://example.org/u1/r1", n) for n in
                                  ("Trig", "trig", "TRIG", "dbo.Trig", "y.Only_Here", "public.tmp", "absent")],
                                 "repo_url string, table_ref string")
    got = dict(listed(C.resolve_table_variants(refs, c.all_tables), "table_ref", "table_name"))
    # TRIG equals trig but for case, and Trig only in lower case: the first form in order wins.
    assert got == {"Trig": "Trig", "trig": "trig", "TRIG": "trig", "dbo.Trig": "dbo.trig",
                   "y.Only_Here": "x.only_here", "public.tmp": "#tmp", "absent": None}
    plain = dict(listed(C.resolve_table(refs, c.all_tables), "table_ref", "table_name"))
    assert plain["public.tmp"] is None and plain["y.Only_Here"] == "x.only_here"
    # The stored index finds the same, with and without prefixes, and no lookup names two tables.
    assert dict(listed(C.resolve_table_variants(refs, c.all_tables, c.lookup), "table_ref", "table_name")) == got
    assert dict(listed(C.resolve_table(refs, c.all_tables, index=c.lookup), "table_ref", "table_name")) == plain
    assert c.lookup.count() == c.lookup.select("repo_url", "lookup").distinct().count()


def test_later_statements_make_tables_and_columns(spark):
    c = catalog_of(spark, {
        "1.sql": "create table t ([Id] int); insert into dbo.T (id, [Extra], two words) values (1, 2, 3)",
        "2.sql": "alter table late add x int; insert into s.Late (x, y) values (1, 2); insert into other select f(a) from t",
        "3.sql": "insert into New.One (a) values (1); insert into one (b) values (2)"})
    got = listed(c.columns.join(c.tables.select("repo_url", "table_name"), ["repo_url", "table_name"]),
                 "table_name", "col_name", "origin")
    assert got == [("New.One", "a", "insert"), ("New.One", "b", "insert"), ("late", "x", "alter"),
                   ("late", "y", "insert"), ("t", "Extra", "insert"), ("t", "Id", "create")]


def test_create_as_select(spark):
    c = catalog_of(spark, {"1.sql": """create table src (a int, B varchar(3));
        create view v as select distinct src.*, src.a as A2, max(B) top_b from src;
        create table if not exists w as select * from src where a = 1"""})
    got = listed(c.columns.filter(F.col("table_name").isin("v", "w")), "table_name", "col_name", "col_type")
    assert got == [("v", "A2", None), ("v", "B", "varchar"), ("v", "a", "int"), ("v", "top_b", None),
                   ("w", "B", "varchar"), ("w", "a", "int")]


def test_every_resolved_fk_column_exists(spark):
    c = catalog_of(spark, {"1.sql": """create table a (x int, y int, primary key (x));
        create table b (x int references a, y int references a(y), z int references a(nope), q int references gone(x))"""})
    resolved = C.foreign_keys(c.fks)
    ends = resolved.select("repo_url", "table_name", F.explode("cols").alias("col_name")).unionByName(
        resolved.select("repo_url", F.col("ref_name").alias("table_name"), F.explode("ref_cols").alias("col_name")))
    assert ends.join(c.columns, ["repo_url", "table_name", "col_name"], "left_anti").count() == 0
    assert resolved.count() == 2 and C.fk_unresolved(c.fks).count() == 2


def test_base_types(spark):
    c = catalog_of(spark, {"1.sql": "create table t (a datetime, b uniqueidentifier, c varchar(3), d nvarchar(4))"})
    assert listed(C.with_base_type(c.columns), "col_name", "base_type") == [
        ("a", "DateTime"), ("b", "ID"), ("c", "String"), ("d", None)]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_nearest_names_against_brute_force(spark):
    names = ["user", "users", "usr", "orders", "order", "u", "ab", "ba", "abc", "customer", "custmer", "t_1", "t_22"]
    asked = ["user", "odrer", "x", "bac", "customers", "t_2", "", "zzzzzz"]
    repo = "https://example.org/u/r"
    tables = spark.createDataFrame([(repo, n) for n in names], "repo_url string, table_name string")
    missing = spark.createDataFrame([(repo, n) for n in asked], "repo_url string, table_ref string")
    got = listed(C.nearest_names(missing, tables, 3), "table_ref", "rank", "distance", "table_name")
    want = []
    for a in asked:
        near = sorted((brute_distance(a, n), n) for n in names)
        want += [(a, i, d, n) for i, (d, n) in enumerate(near[:3], 1)]
    assert got == sorted(want, key=repr)


def test_nearest_names_of_a_large_repository(spark, monkeypatch):
    """Many blocks of a length, lengths far apart, a repository with fewer names than asked for."""
    import random
    monkeypatch.setattr(C, "BLOCK", 3)
    rng = random.Random(2)
    word = lambda lo, hi: "".join(rng.choice("abc_") for _ in range(rng.randint(lo, hi)))
    names = sorted({word(1, 4) for _ in range(60)} | {word(9, 14) for _ in range(60)} | {"Customers_Order_X1"})
    few = ["One", "twenty_two"]
    asked = [*{word(1, 16) for _ in range(40)}, "customer_orders", "a" * 40]
    repos = {"https://example.org/u/many": names, "https://example.org/u/few": few}
    tables = spark.createDataFrame([(r, n) for r, ns in repos.items() for n in ns], "repo_url string, table_name string")
    missing = spark.createDataFrame([(r, a) for r in repos for a in asked] + [("https://example.org/u/none", "x")], "repo_url string, table_ref string")
    got = listed(C.nearest_names(missing, tables, 3), "repo_url", "table_ref", "rank", "distance", "table_name")
    want = []
    for r, ns in repos.items():
        for a in asked:
            near = sorted((brute_distance(a.lower(), n.lower()), n) for n in ns)
            want += [(r, a, i, d, n) for i, (d, n) in enumerate(near[:3], 1)]
    assert got == sorted(want, key=repr)


def test_labels(spark):
    c = catalog_of(spark, {"1.sql": """create table "LoginTries" ("ipAddr" varchar(9) primary key not null, n int not null, note text);
        create table two (a int primary key, b int primary key, c int unique);
        create table three (a int, b int, primary key (a, b), unique (a));
        create table s.[My Tab] (x int unique not null)"""})
    rows = listed(E.label_rows(c.tables, c.columns, c.keys), "table", "column", "label")
    assert rows == sorted([
        ("login_tries", "ip_addr", "[UNIQUE]"), ("login_tries", "n", "[NOTNULL]"), ("login_tries", "note", ""),
        ("two", "a", "[NOTNULL]"), ("two", "b", "[NOTNULL]"), ("two", "c", ""),
        ("three", "a", "[NOTNULL]"), ("three", "b", "[NOTNULL]"), ("my_tab", "x", "[UNIQUE]")], key=repr)


def test_filters_and_clusters(spark):
    c = catalog_of(spark, [
        ("https://example.org/u/a", "1.sql", "create table t (a int not null, b int); create table plain (x int)"),
        ("https://example.org/u/b", "2.sql", "create table t (b int, a int); create table full_t (x int not null)")])
    labels = E.label_rows(c.tables, c.columns, c.keys)
    constraints, signatures = A.table_constraints(labels), A.table_signatures(c.tables, c.columns)
    assert listed(A.filter_tables(constraints, True, 0.5), "repo_url", "table_name") == [("https://example.org/u/a", "t")]
    assert listed(A.filter_tables(constraints, False, 1.0), "table_name") == [("full_t",), ("plain",), ("t",), ("t",)]
    assert listed(A.dup_clusters(signatures), "cluster_key", "n")[-1] == ("t:a___b", 2)
    assert A.keep_first(signatures).count() == 3
    stats = dict(listed(A.training_stats(c.all_tables, constraints, signatures, False, 1.0), "metric", "value"))
    assert stats == {"input_tables": 4, "skipped_no_constraint": 0, "skipped_high_notnull": 0, "duplicate_tables": 1,
                     "output_tables": 3, "unique_columns": 0, "notnull_columns": 2, "none_columns": 2}
