import os

from pyspark.sql import functions as F

from scriptlode.operators import analytics as A, export as E, statements as S, store as ST
from scriptlode.plans import queries as P
from scriptlode.sources import scripts as R

from .conftest import catalog_of, facts_of, listed


def test_read_scripts_and_manifest(spark, tmp_path):
    files = tmp_path / "files"
    (files / "deep" / "er").mkdir(parents=True)
    (files / "h1.sql").write_bytes("create table t (x int) -- é".encode("utf-8"))
    (files / "h2.sql").write_bytes("create table u (x int) -- é".encode("latin-1"))
    (files / "skip.txt").write_text("no script")
    (files / "deep" / "h1.sql").write_text("create table inner_one (x int)")
    (files / "deep" / "er" / "a b%20+c.sql").write_text("create table odd_name (x int)")
    (files / "deep" / "h3.sql").write_text("")
    base = "https://example.org/me/repo"
    lines = [f"{h}\t{base}/blob/main/{h}.sql\t{base}/raw/{h}.sql" for h in ("h1", "h1", "h2", "absent", "deep/h1", "deep/h3", "deep/er/a b%20+c")]
    lines.append(f"h1\t{base}/blob/main/h1.sql\t{base}/raw/z/h1.sql")
    (tmp_path / "list.tsv").write_text("\n".join(lines) + "\n")
    scanned = R.read_scripts(spark, str(tmp_path / "files"))
    scripts = R.scripts_from(R.read_manifest(spark, str(tmp_path / "list.tsv")), scanned)
    assert listed(scripts, "repo_url", "user", "repo_name", "file_id", "text") == [
        (base, "me", "repo", "deep/er/a b%20+c.sql", "create table odd_name (x int)"),
        (base, "me", "repo", "deep/h1.sql", "create table inner_one (x int)"),
        (base, "me", "repo", "deep/h3.sql", ""),
        (base, "me", "repo", "h1.sql", "create table t (x int) -- é"),
        (base, "me", "repo", "h2.sql", "create table u (x int) -- é")]
    stmts = S.statements(scripts)
    assert stmts.count() == stmts.select("stmt_id").distinct().count() == 4
    manifest = R.read_manifest(spark, str(tmp_path / "list.tsv"))
    assert R.script_urls(manifest, scanned).filter("file_id = 'h1.sql'").count() == 2


def test_stored_batches(spark, tmp_path):
    """From folder and manifest to stored facts; a batch that is run again replaces itself, also with less; an open one is not read."""
    def corpus(n, texts):
        folder = tmp_path / f"in{n}"
        (folder / "sub").mkdir(parents=True, exist_ok=True)
        lines = []
        for i in range(9):
            file = folder / "sub" / f"f{i}.sql"
            file.unlink(missing_ok=True)
            if i < len(texts):
                file.write_text(texts[i])
                base = f"https://example.org/u{n}/r{i}"
                lines.append(f"sub/f{i}\t{base}/blob/main/f{i}.sql\t{base}/raw/f{i}.sql")
        (tmp_path / f"list{n}.tsv").write_text("\n".join(lines) + "\n")
        ST.run_batch(spark, str(folder), str(tmp_path / f"list{n}.tsv"), out, f"b{n}")

    def stats():
        return dict(tuple(r) for r in A.corpus_stats(ST.load_catalog(spark, out), ST.load_query_facts(spark, out)).collect())

    out = str(tmp_path / "store")
    one = ["create table a (x int primary key, y int);\nselect a.y, count(a.x) from a join b on a.x = b.x where a.y = 2 group by a.y;\ncreate table b (x int references a (x))",
           "create table c (x int);\ncreate index i on c (x)"]
    corpus(1, one)
    corpus(2, ["create table d (z varchar(3), w int unique)"])
    first = stats()
    assert (first["tables"], first["columns"], first["foreign_keys"], first["queries"], first["binary_joins"], first["nonempty_repos"]) == (4, 6, 1, 1, 1, 3)
    corpus(1, one)
    assert stats() == first
    corpus(1, one[1:])
    again = stats()
    assert (again["tables"], again["foreign_keys"], again["queries"], again["indexes"]) == (2, 0, 0, 1)
    ST._replace(spark.createDataFrame([("b2", ST._OPEN, 0, "")], ST._LEDGER), f"{out}/ledger")
    assert stats()["tables"] == 1


def test_read_log(spark, tmp_path):
    (tmp_path / "run.log").write_text("\n".join([
        "create table total: 10, create table succ: 8, create table except: 2", "create table succ: 5", "noise",
        "repo parse done", "query_succ: 3, query_except: 1", "query_succ: 0, query_except: 0"]))
    lines = R.read_log(spark, str(tmp_path / "run.log"))
    assert lines.count() == 5
    assert [r["coverage"] for r in A.log_coverage(lines).collect()] == [0.75]
    assert tuple(A.log_totals(lines).first()) == (10, 8, 2, 1, 0.8)


def test_repo_selection(spark):
    rows = spark.createDataFrame([(f"https://example.org/u{i % 3}/r{i}", f"u{i % 3}", f"{i}.sql") for i in range(400)],
                                 "repo_url string, user string, file_id string")
    assert R.limit_repos(rows, 5).select("repo_url").distinct().count() == 5
    assert {r["user"] for r in R.first_users(rows, 2).collect()} == {"u0", "u1"}
    some = R.sample_repos(rows, 25, "s")
    assert 60 < some.count() < 140 and some.count() == R.sample_repos(rows.repartition(7), 25, "s").count()
    assert R.sample_repos(rows, 100).count() == 400 and R.sample_repos(rows, 0).count() == 0


def test_training_files(spark, tmp_path):
    c = catalog_of(spark, {"1.sql": "create table tA (id int primary key, firstName text, n int not null); create table b (x int)"})
    labels = E.label_rows(c.tables, c.columns, c.keys)
    signatures = A.table_signatures(c.tables, c.columns)
    E.write_training(labels, A.dup_clusters(signatures), str(tmp_path / "out"), "seed")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "rows")).collect()]
    assert sorted(lines) == ["1.sql,b,x,", "1.sql,t_a,first_name,", "1.sql,t_a,id,[UNIQUE]", "1.sql,t_a,n,[NOTNULL]"]
    mine = [x for x in lines if ",t_a," in x]
    assert mine == ["1.sql,t_a,id,[UNIQUE]", "1.sql,t_a,first_name,", "1.sql,t_a,n,[NOTNULL]"]
    assert spark.read.text(str(tmp_path / "out" / "clusters")).count() == 2


def test_catalog_batches_merge(spark, tmp_path):
    path = str(tmp_path / "cat")
    for i in (1, 2):
        c = catalog_of(spark, [(f"https://example.org/u/r{i}", "1.sql", f"create table t{i} (x int)")])
        E.write_catalog({"tables": c.tables, "columns": c.columns}, path, buckets=3)
    assert listed(E.read_catalog(spark, path, "tables"), "table_name") == [("t1",), ("t2",)]
    assert E.read_catalog(spark, path, "columns").count() == 2


def test_views_and_counts(spark):
    text = {"1.sql": "create table a (x int, y int, primary key (x)); create table b (x int references a(x));",
            "2.sql": "select a.y, sum(b.x) s from a join b on a.x = b.x where a.y = 3 group by a.y;\n\nselect zz from nowhere"}
    c, q = catalog_of(spark, text), facts_of(spark, text)
    from scriptlode.operators import catalog as C
    view = {r["table_name"]: r for r in E.table_view(c.tables, c.columns, c.keys, C.foreign_keys(c.fks)).collect()}
    assert [x["col_name"] for x in view["a"]["cols"]] == ["x", "y"] and view["a"]["keys"][0]["cols"] == ["x"]
    assert view["b"]["fks"][0]["ref_name"] == "a" and view["a"]["fks"] is None
    row = E.query_view(q.queries, q.binary_joins, q.refs).collect()
    assert len(row) == 1 and row[0]["joins"][0]["l_table"] == "a" and row[0]["has_groupby"]
    outcomes = A.query_outcomes(q.statements, q.queries).select("kind", "ok").unionByName(
        A.statement_outcomes(S.statements(spark.createDataFrame(
            [("r", "f", "create table ok (x int); create table broken; alter table t add x int; create index i on t (x); insert into t select 1")],
            "repo_url string, file_id string, text string"))).select("kind", "ok"))
    assert listed(A.extraction_counts(outcomes), "kind", "status", "n") == [
        ("alter_table", "ok", 1), ("create_index", "ok", 1), ("create_table", "failed", 1), ("create_table", "ok", 1),
        ("insert", "failed", 1), ("query", "failed", 1), ("query", "ok", 1)]
    stats = dict(listed(A.corpus_stats(c, q), "metric", "value"))
    assert (stats["tables"], stats["columns"], stats["primary_keys"], stats["foreign_keys"], stats["queries"],
            stats["binary_joins"], stats["queries_with_selection"]) == (2, 3, 1, 1, 1, 1, 1)
    assert listed(A.type_frequency(c.columns), "col_type", "n") == [("int", 3)]
    assert A.table_sample(c.tables, 5, 2).count() == 1 and A.table_sample(c.tables, 5, 3).count() == 0


def test_join_like_blocks(spark):
    text = "SELECT a FROM t, u WHERE 1\n\nselect a from t where b = 1\n  \nupdate t set x = 1"
    rows = spark.createDataFrame([("r", "f", text)], "repo_url string, file_id string, text string")
    assert listed(S.join_like(rows), "block_seq", "join_like") == [(0, True), (1, False), (2, False)]
    assert S.join_like(rows).filter(F.col("join_like")).count() == 1


def test_script_folders_stand_on_shelves(spark):
    """The script folders of a query are written below few folders, each by one task, not all below one."""
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    P.a1_script_decode(spark, "/root/testdata/sf0.001")
    made = [f for f in os.listdir(shared) if f not in before and f.startswith("scripts-")]
    tops = [f for f in os.listdir(f"{shared}/{made[0]}") if not f.startswith(("_", "."))]
    assert len(made) == 1 and 1 < len(tops) <= P.SHELVES and all(f.startswith("shelf=") for f in tops)


def test_tasks_write_script_files_as_sparks_writer_does(spark, tmp_path):
    """Tasks write the same lines into the same folders as Spark's writer, without its checksum files; a second attempt changes nothing."""
    rows = spark.createDataFrame([(n % 3, str(n), line) for n in range(20) for line in (b"a\nb \xe9" * n, None if n % 2 else b"\xc3\xa9")],
                                 "shelf int, name string, line binary")
    plain = rows.select("shelf", "name", F.col("line").cast("string").alias("value")).repartition("shelf")
    plain.write.partitionBy("shelf", "name").text(str(tmp_path / "spark"))
    for _ in range(2):
        P._write_scripts(rows, str(tmp_path / "tasks"))

    def contents(folder):
        return {tuple(f.relative_to(folder).parts[:2]): sorted(f.read_bytes().split(b"\n")) for f in folder.glob("shelf=*/name=*/*.txt")}

    assert len(contents(tmp_path / "tasks")) == 20 and contents(tmp_path / "tasks") == contents(tmp_path / "spark")
    assert sum(f.is_file() for f in (tmp_path / "tasks").rglob("*")) == 20
    read = {r.file_id.rsplit("/", 1)[0]: r.text for r in R.read_scripts(spark, str(tmp_path / "tasks"), "*.txt").collect()}
    assert read["shelf=2/name=2"].encode("latin-1").count(b"\n") == 4 and len(read) == 20


def test_manifest_query_makes_one_file_for_each_script(spark):
    """The scripts that the manifest is held against are written as one file each: no checksum stands beside it."""
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    found = P.a2_manifest_files(spark, "/root/testdata/sf0.001").count()
    made = [f for f in os.listdir(shared) if f not in before and f.startswith("scripts-")]
    files = [f for folder, _, names in os.walk(f"{shared}/{made[0]}") for f in names if "name=" in folder]
    assert len(made) == 1 and len(files) == found > 0
