"""Expected rows written by hand: the case groups of FIXTURES.md in texts of our own."""

import pytest

from scriptlode.operators import ddl as D, statements as S

from .conftest import catalog_of, listed, make_scripts

# name: (script, {table: (columns, keys)}, foreign keys)
CASES = {
    "keys_added_later": ("""
      CREATE TABLE ferry_run (berth smallint NOT NULL, vessel char(8), sails_on datetime NOT NULL);
      ALTER TABLE ferry_run ADD KEY by_vessel (vessel), ADD PRIMARY KEY (berth);""",
        {"ferry_run": ("berth smallint!,vessel char,sails_on datetime!", ["PrimaryKey berth", "CandidateKey vessel"])}, []),
    "two_column_key_and_unique_index": ("""
      create table harvest (plot bigint not null, season bigint not null, tons float,
        unique index h_once (season, tons), primary key (plot, season));""",
        {"harvest": ("plot bigint!,season bigint!,tons float", ["PrimaryKey plot,season", "UniqueIndex season,tons"])}, []),
    "comma_before_the_bracket": ("create table moon (orbit int, primary key (orbit),);", {"moon": ("orbit int", ["PrimaryKey orbit"])}, []),
    "key_inside_a_column": ("create table lens (serial_no varchar(12) not null primary key, focal numeric(6,2));",
                            {"lens": ("serial_no varchar!,focal numeric", ["PrimaryKey serial_no"])}, []),
    "reference_without_columns": ("""
      create table observatory (site int primary key, altitude int);
      create table dome (site int primary key references observatory, turns boolean not null);""",
        {"observatory": ("site int,altitude int", ["PrimaryKey site"]), "dome": ("site int,turns boolean!", ["PrimaryKey site"])},
        ["dome site -> observatory site"]),
    "reference_with_too_many_columns": ("""
      create table colour (hue int primary key, tone int);
      create table paint (hue int primary key references colour (hue, tone));""",
        {"colour": ("hue int,tone int", ["PrimaryKey hue"]), "paint": ("hue int", ["PrimaryKey hue"])}, []),
    "indexes_and_plain_keys": ("""
      create table choir (voice int not null, singer int, hall varchar(5), key in_hall (hall), index (voice, singer));""",
        {"choir": ("voice int!,singer int,hall varchar", ["CandidateKey hall", "Index voice,singer"])}, []),
    "foreign_key_clauses": ("""
      create table river (river_no int, mouth text, primary key (river_no));
      create table lock_gate (gate int, river_no int, foreign key (river_no) references river (river_no) on update cascade);""",
        {"river": ("river_no int,mouth text", ["PrimaryKey river_no"]), "lock_gate": ("gate int,river_no int", [])},
        ["lock_gate river_no -> river river_no"]),
    "named_constraints": ("""
      create table shelf (aisle int, level int, label text, constraint shelf_key primary key (aisle, level), constraint one_label unique (label));
      create table box (aisle int, level int, constraint on_shelf foreign key (aisle, level) references SHELF (aisle, level));""",
        {"shelf": ("aisle int,level int,label text", ["PrimaryKey aisle,level", "UniqueKey label"]), "box": ("aisle int,level int", [])},
        ["box aisle,level -> shelf aisle,level"]),
    "unique_in_all_spellings": ("""
      create table badge (a int, b int, c int, d int unique, unique (a), unique key two (b, c), key plain (c));""",
        {"badge": ("a int,b int,c int,d int", ["UniqueColumn d", "UniqueKey a", "UniqueKey b,c", "CandidateKey c"])}, []),
    "comment_attributes": ("""
      create table tide (at_hour int comment 'Stunde, (0-23)', height decimal(4,1) comment '高さ', key (at_hour)); -- done""",
        {"tide": ("at_hour int,height decimal", ["CandidateKey at_hour"])}, []),
    "brackets_and_commas_first": ("""
      create table [wind]
        ( [knots] int not null
        , [from_dir] nvarchar(3)
        )""", {"wind": ("knots int!,from_dir nvarchar", [])}, []),
    "constraint_primary_key_by_alter": ("""
      create table sky.cloud (kind text not null, base int, constraint low check ((base) < (9000)));
      alter table only sky.cloud add constraint cloud_key primary key (kind, base);""",
        {"sky.cloud": ("kind text!,base int", ["PrimaryKey kind,base"])}, []),
    "blank_in_a_name": ("create table `oven` (`max heat` int, `brand` text); alter table `oven` add primary key (`max heat`);",
                        {"oven": ("max heat int,brand text", ["PrimaryKey max heat"])}, []),
    "foreign_keys_by_alter": ("""
      create table bee (hive int, queen int); create table hive_box (hive int primary key, wood text);
      alter table bee add foreign key (hive) references hive_box (hive);
      alter table bee add constraint by_wood foreign key (queen) references hive_box (wood) on delete set null;""",
        {"bee": ("hive int,queen int", []), "hive_box": ("hive int,wood text", ["PrimaryKey hive"])},
        ["bee hive -> hive_box hive", "bee queen -> hive_box wood"]),
    "unique_by_alter": ("""
      create table knot (rope int, turns int, tag int);
      alter table knot add unique key r (rope, turns); alter table knot add unique index t (tag);
      alter table knot add constraint both_ways unique (turns, tag);""",
        {"knot": ("rope int,turns int,tag int", ["UniqueKey rope,turns", "UniqueIndex tag", "UniqueKey turns,tag"])}, []),
    "create_index": ("""
      create table mill (wheel int, stone int);
      create unique index one_wheel on mill (wheel); create index stones on mill using btree (stone desc);""",
        {"mill": ("wheel int,stone int", ["UniqueIndex wheel", "Index stone"])}, []),
    "column_references": ("""
      CREATE TABLE p (id int PRIMARY KEY, k int);
      CREATE TABLE c (a int NOT NULL REFERENCES p(id), b int REFERENCES p, d int FOREIGN KEY REFERENCES p(k) ON DELETE CASCADE, x geo REFERENCES p(id));""",
        {"p": ("id int,k int", ["PrimaryKey id"]), "c": ("a int!,b int,d int", [])},
        ["c a -> p id", "c b -> p id", "c d -> p k"]),
    "alter_mixed": ("""
      CREATE TABLE t (id int);
      ALTER TABLE t ADD COLUMN note text NOT NULL, ADD INDEX date_idx (id), ADD PRIMARY KEY (nope), ADD id int, ADD k varchar(3), ADD UNIQUE (k);""",
        {"t": ("id int,note text!,k varchar", ["UniqueKey k"])}, []),
}


@pytest.fixture(scope="module")
def built(spark):
    """All cases in one catalog, a repository each."""
    c = catalog_of(spark, [(f"https://example.org/u/{n}", "a.sql", case[0]) for n, case in CASES.items()])
    take = lambda df, *cols: [r.asDict() for r in df.select("repo_url", *cols).collect()]
    return {"columns": take(c.columns, "table_name", "col_name", "col_type", "not_null", "origin", "stmt_seq", "ord"),
            "keys": take(c.keys, "table_name", "key_type", "cols"),
            "indexes": take(c.indexes(), "table_name", "index_type", "cols"),
            "fks": take(c.fks.filter("resolved"), "table_name", "cols", "ref_name", "ref_cols")}


@pytest.mark.parametrize("name", CASES)
def test_case(built, name):
    _, tables, fks = CASES[name]
    mine = {k: [r for r in rows if r["repo_url"].endswith("/" + name)] for k, rows in built.items()}
    rank = {"create": 0, "alter": 1, "insert": 2}
    cols = {}
    for r in sorted(mine["columns"], key=lambda r: (rank[r["origin"]], r["stmt_seq"], r["ord"])):
        cols.setdefault(r["table_name"], []).append(f"{r['col_name']} {r['col_type']}" + "!" * r["not_null"])
    assert {t: ",".join(v) for t, v in cols.items()} == {t: v[0] for t, v in tables.items()}
    keys = sorted((r["table_name"], r["key_type"], ",".join(r["cols"])) for r in mine["keys"])
    assert keys == sorted((t, *k.split(" ", 1)) for t, v in tables.items() for k in v[1])
    got = [f"{r['table_name']} {','.join(r['cols'])} -> {r['ref_name']} {','.join(r['ref_cols'])}" for r in mine["fks"]]
    assert sorted(got) == sorted(fks)
    index_keys = [k for k in keys if k[1] in ("Index", "UniqueIndex")]
    assert sorted((r["table_name"], r["index_type"], ",".join(r["cols"])) for r in mine["indexes"]) == index_keys


def test_split_needs_no_semicolons(spark):
    text = "create table a (x int)\ncreate view v as select x from a\ninsert into a (x) values (1) alter table a add y int"
    rows = S.statements(make_scripts(spark, {"f": text}))
    assert [k for _, k in sorted((r["stmt_seq"], r["kind"]) for r in rows.collect())] == [
        "create_table", "create_as_select", "insert", "alter_table"]


def test_size_guard_bounds(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (49999, 50000, 50001)], "stmt string")
    assert S.size_guard(rows).count() == 1
    assert S.size_guard(rows, query=True).count() == 2


def test_long_statements_are_read(spark):
    wide = "create table wide (" + ", ".join(f"column_number_{i} varchar(30) not null" for i in range(2000)) + ")"
    rows = "insert into fresh (one, two) values " + ", ".join(f"({i}, 'value {i}')" for i in range(12000))
    assert len(wide) > 50000 and len(rows) > 200000
    columns = catalog_of(spark, {"a.sql": wide + ";\n" + rows}).columns.groupBy("table_name").count().collect()
    assert {r[0]: r[1] for r in columns} == {"wide": 2000, "fresh": 2}
    assert S.statements(make_scripts(spark, {"a.sql": wide}), limit=50000).count() == 0


def test_clause_kinds(spark):
    text = """create table t (a int, comment on x, constraint q check (a > 1), index_no int, unique_flag int,
              key_part int, unique index u (a), check (a > 0))"""
    kinds = listed(D.classify_clause(D.clauses(S.statements(make_scripts(spark, {"f": text})))),
                   "clause_seq", "clause_kind")
    assert [k for _, k in kinds] == ["column", "comment", "constraint_other", "column", "column", "column",
                                     "unique_index", "column"]


def test_join_only_statements(spark):
    text = "select a from t, u where t.i = u.i;\nselect a from t where x = 1;\nselect a from t join u on t.i = u.i;\nselect a from t join u"
    scripts = make_scripts(spark, {"f": text})
    assert S.query_statements(scripts).count() == 4
    assert S.query_statements(scripts, join_only=True).count() == 2
