"""Statement shaping: split scripts, filter by stage, clean, classify. No operator here shuffles."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.fixed import STATEMENT_LIMIT

_DDL_HEADS = r"(?i)(create table|alter table|create index|create unique index|insert into|create view)"


def _stmt_id(kind: str) -> Column:
    """File, position, repository. The file comes first: repository urls share a long prefix, and
    sorts on the id should be settled by its first bytes."""
    return F.concat_ws("#", "file_id", F.concat(F.lit(kind), F.col("stmt_seq").cast("string")), "repo_url")


def ddl_statements(scripts: DataFrame) -> DataFrame:
    """One row per non-blank DDL piece: split before each statement head and at semicolons."""
    pieces = F.split(F.regexp_replace("text", _DDL_HEADS, ";\n$1"), ";")
    return (scripts.select("repo_url", "file_id", F.posexplode(pieces).alias("stmt_seq", "stmt"))
            .filter(F.trim(F.regexp_replace("stmt", r"\s", " ")) != "")
            .withColumn("stmt_id", _stmt_id("d")))


def stage_of(stmt: Column) -> Column:
    """create, alter or insert; null for a statement of no DDL stage."""
    low = F.lower(stmt)
    return (F.when(low.contains("create table") | low.contains("create temporary table")
                   | low.contains("create view"), "create")
            .when(low.contains("alter table") | low.contains("create index")
                  | low.contains("create unique index"), "alter")
            .when(low.contains("insert"), "insert"))


def stage_filter(stmts: DataFrame) -> DataFrame:
    return stmts.withColumn("stage", stage_of(F.col("stmt"))).filter(F.col("stage").isNotNull())


def size_guard(stmts: DataFrame, query: bool = False, limit: int = STATEMENT_LIMIT) -> DataFrame:
    """Leave out over-long statements; a query may be exactly as long as the limit. Extraction uses it only on
    request: statements of any length are read otherwise."""
    n = F.length("stmt")
    return stmts.filter(n <= limit if query else n < limit)


def clean_statements(stmts: DataFrame) -> DataFrame:
    """Comments out, white space collapsed, COMMENT attributes and sizes out."""
    return (stmts.withColumn("stmt", X.clean_stmt(X.normalize_text(F.col("stmt"))))
            .filter(F.col("stmt") != ""))


def kind_of(stmt: Column) -> Column:
    low = F.lower(stmt)
    return (F.when((low.contains("create table") | low.contains("create temporary table")
                    | low.contains("create view"))
                   & low.contains(" as select "), "create_as_select")
            .when(low.contains("create table"), "create_table")
            .when(low.contains("create temporary table"), "create_table")
            .when(low.contains("alter table"), "alter_table")
            .when(low.contains("create index"), "create_index")
            .when(low.contains("create unique index"), "create_unique_index")
            .when(low.contains("insert"), "insert")
            .otherwise("other"))


def classify_stmt(stmts: DataFrame) -> DataFrame:
    return stmts.withColumn("kind", kind_of(F.col("stmt")))


def statements(scripts: DataFrame, limit: int | None = None) -> DataFrame:
    """Clean, classified DDL statements: repo_url, file_id, stmt_seq, stmt, stmt_id, stage, kind.

    The same steps as the operators above, but done on the pieces before they become rows: a
    filter on a cleaned text would otherwise be pushed down and clean the text again. `limit`, if given,
    leaves out pieces of that many characters or more.
    """
    pieces = F.split(F.regexp_replace("text", _DDL_HEADS, ";\n$1"), ";")
    staged = F.filter(
        F.transform(pieces, lambda s, i: F.struct(
            i.alias("stmt_seq"), s.alias("raw"), stage_of(s).alias("stage"))),
        lambda p: p["stage"].isNotNull() if limit is None else p["stage"].isNotNull() & (F.length(p["raw"]) < limit))
    cleaned = F.transform(staged, lambda p: F.struct(
        p["stmt_seq"].alias("stmt_seq"), p["stage"].alias("stage"),
        X.clean_stmt(X.normalize_text(p["raw"])).alias("stmt")))
    rows = F.transform(F.filter(cleaned, lambda p: p["stmt"] != ""), lambda p: F.struct(
        p["stmt_seq"].alias("stmt_seq"), p["stmt"].alias("stmt"), p["stage"].alias("stage"),
        kind_of(p["stmt"]).alias("kind")))
    return (scripts.select("repo_url", "file_id", F.inline(rows))
            .withColumn("stmt_id", _stmt_id("d"))
            .select("repo_url", "file_id", "stmt_seq", "stmt", "stmt_id", "stage", "kind"))


def has_from_comma(low: Column) -> Column:
    """A comma between the first 'from' and the following 'where'."""
    return F.substring_index(F.get(F.split(low, "from"), F.lit(1)), "where", 1).contains(",")


def query_statements(scripts: DataFrame, join_only: bool = False, limit: int | None = None) -> DataFrame:
    """Query statements: blocks end at blank lines and semicolons and hold 'select ' and 'from '.

    join_only also asks for a join, or a where with a comma in the from clause, and a comparison. `limit`,
    if given, leaves out longer statements.
    """
    def wanted(piece):
        low = F.lower(piece)
        keep = low.contains("select ") & low.contains("from ")
        if join_only:
            joins = low.contains("join ") | (low.contains("where ") & has_from_comma(low))
            keep = keep & joins & piece.rlike("[=<>]")
        return keep

    pieces = F.split(F.regexp_replace("text", r"\r?\n(?:[ \t\r]*+\n)++", ";"), ";")
    numbered = F.transform(pieces, lambda s, i: F.struct(i.alias("stmt_seq"), s.alias("raw")))
    cleaned = F.transform(F.filter(numbered, lambda p: wanted(p["raw"])), lambda p: F.struct(
        p["stmt_seq"].alias("stmt_seq"), X.normalize_text(p["raw"]).alias("stmt")))
    rows = scripts.select("repo_url", "file_id", F.inline(F.filter(cleaned, lambda p: p["stmt"] != "")))
    rows = rows if limit is None else size_guard(rows, query=True, limit=limit)
    return rows.withColumn("stmt_id", _stmt_id("q"))


def join_like(scripts: DataFrame) -> DataFrame:
    """Blocks between blank lines, flagged when they look like a join query."""
    blocks = F.split("text", r"\r?\n(?:[ \t\r]*+\n)++")
    rows = (scripts.select("repo_url", "file_id", F.posexplode(blocks).alias("block_seq", "block"))
            .withColumn("block", F.lower("block")).filter(F.trim(F.regexp_replace("block", r"\s", " ")) != ""))
    low = F.col("block")
    like = (low.contains("select") & low.contains("from")
            & (low.contains("join") | (low.contains("where") & has_from_comma(low))))
    return rows.withColumn("join_like", F.coalesce(like, F.lit(False)))
