"""DDL facts. A statement is bounded by the size guard, so its clauses, columns, keys and foreign
keys are worked out as arrays inside the statement's row: one scan of the text and no shuffle.
The per-kind operators then explode those arrays.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.fixed import KNOWN_TYPE_WORDS

_KNOWN_TYPE = "|".join(KNOWN_TYPE_WORDS)
_COLS = r"\(([^()]*)\)"
_NO_COLUMN_HEAD = r"^(?:check|exclude|fulltext|spatial|period|like|primary|foreign|index|unique|key)\b"
_FK = rf"(?i)foreign\s+key[^(]*{_COLS}\s*references\s*({X.NAME})\s*(?:{_COLS})?"
_FK_TABLE = rf"(?i)foreign\s+key[^(]*\([^()]*\)\s*references\s*({X.NAME})"
_REF = rf"(?i)\breferences\s+({X.NAME})\s*(?:{_COLS})?"

# Name, header and target of each statement kind.
_CREATE_NAME = rf"(?i)\bcreate (?:temporary )?table (?:if not exists )?({X.NAME})"
_CTAS_NAME = rf"(?i)\bcreate (?:temporary table|table|view) (?:if not exists )?({X.NAME})"
_ALTER_NAME = rf"(?i)\balter table (?:only )?(?:if exists )?(?:only )?({X.NAME})"
_INDEX_ON = rf"(?i)\son\s+(?:only\s+)?({X.NAME})\s*(?:using\s+\w+\s*)?\(\(?([^()]*)\)"
_INSERT_INTO = rf"(?i)\binsert\s+(?:into\s+)?({X.NAME})\s*{_COLS}"


def _name(stmt: Column, pattern: str) -> Column:
    return F.nullif(X.clean_ident(F.regexp_extract(stmt, pattern, 1)), F.lit(""))


def table_headers(stmts: DataFrame) -> DataFrame:
    """Create-table statements with the table name; the name is null when none was found."""
    return (stmts.filter(F.col("kind") == "create_table")
            .withColumn("table_name", _name(F.col("stmt"), _CREATE_NAME)))


def _with_clauses(stmts: DataFrame) -> DataFrame:
    body = X.first_group(X.mask_punctuated_literals(F.col("stmt")))
    return (table_headers(stmts)
            .withColumn("clauses", F.coalesce(X.split_top(body), F.array().cast("array<string>"))))


def clauses(stmts: DataFrame) -> DataFrame:
    """One row per clause of a create-table body, in order."""
    return _with_clauses(stmts).select(
        "repo_url", "file_id", "stmt_id", "table_name",
        F.posexplode("clauses").alias("clause_seq", "clause"))


def clause_kind(clause: Column) -> Column:
    """First match wins."""
    low = F.lower(clause)
    constraint = low.rlike(r"^constraint\b")
    return (F.when(low.startswith("comment on"), "comment")
            .when(constraint & low.contains("primary key"), "constraint_pk")
            .when(constraint & low.contains("foreign key"), "constraint_fk")
            .when(constraint & low.contains("unique"), "constraint_unique")
            .when(constraint, "constraint_other")
            .when(low.rlike(r"^primary key\b"), "table_pk")
            .when(low.contains("primary key"), "inline_pk")
            .when(low.rlike(r"^foreign key\b"), "foreign_key")
            .when(low.rlike(r"^unique key\b"), "unique_key")
            .when(low.rlike(r"^key\b[^(]*\("), "key")
            .when(low.rlike(r"^unique index\b"), "unique_index")
            .when(low.rlike(r"^unique\b"), "unique")
            .when(low.rlike(r"^index\b[^(]*\("), "index")
            .when(low.rlike(r"\breferences\b"), "column_ref")
            .otherwise("column"))


def classify_clause(rows: DataFrame) -> DataFrame:
    return rows.withColumn("clause_kind", clause_kind(F.col("clause")))


def _first_ident(c: Column) -> Column:
    return X.clean_ident(F.regexp_extract(c, rf"^({X.IDENT})", 1))


def _type_after_name(c: Column) -> Column:
    return F.nullif(X.norm_type(F.regexp_extract(c, rf"^{X.IDENT}\s+([^\s,(]+)", 1)), F.lit(""))


def _facts(clause_array) -> Column:
    """At most one column, one key and one foreign key per clause.

    Built in steps, each adding fields to the clause's struct, so that no expression is repeated.
    """
    kinds = F.transform(clause_array, lambda c: F.struct(
        c.alias("clause"), F.lower(c).alias("low"), clause_kind(c).alias("kind"),
        _first_ident(c).alias("name"), _type_after_name(c).alias("typ")))
    return F.transform(F.transform(F.transform(kinds, _column_step), _key_step), _fact_step)


def _column_step(f: Column) -> Column:
    plain = f["kind"].isin("column", "column_ref")
    ok = (F.when(plain, f["typ"].rlike(_KNOWN_TYPE) & ~f["low"].rlike(_NO_COLUMN_HEAD))
          .when(f["kind"] == "inline_pk", f["typ"].isNotNull() & (f["typ"] != "primary"))
          .otherwise(False))
    return f.withField("plain", plain).withField(
        "is_column", F.coalesce(ok & (f["name"] != ""), F.lit(False)))


def _key_step(f: Column) -> Column:
    kind, clause = f["kind"], f["clause"]
    key_type = (F.when(kind.isin("constraint_pk", "table_pk"), "PrimaryKey")
                .when((kind == "inline_pk") & f["is_column"], "PrimaryKey")
                .when(kind.isin("constraint_unique", "unique_key", "unique"), "UniqueKey")
                .when(kind == "unique_index", "UniqueIndex")
                .when(kind == "key", "CandidateKey")
                .when(kind == "index", "Index")
                .when(f["plain"] & f["is_column"] & f["low"].contains("unique"), "UniqueColumn"))
    listed = (F.when(kind.isin("constraint_pk", "table_pk"),
                     X.group_of(clause, rf"(?i)primary\s+key[^(]*{_COLS}"))
              .when(kind == "constraint_unique", X.group_of(clause, rf"(?i)\bunique\b[^(]*{_COLS}"))
              .otherwise(X.group_of(clause, rf"^[^(]*{_COLS}")))
    is_fk = kind.isin("constraint_fk", "foreign_key")
    refs = kind.isin("column_ref", "inline_pk") & f["low"].contains(" references ") & f["is_column"]
    return (f.withField("key_type", key_type).withField("listed", listed)
            .withField("is_fk", is_fk).withField("refs", refs)
            .withField("target", F.when(is_fk, _name(clause, _FK_TABLE)).when(refs, _name(clause, _REF)))
            .withField("given", F.when(is_fk, X.group_of(clause, _FK, 3))
                       .when(refs, X.group_of(clause, _REF, 2)))
            .withField("from_cols", F.when(is_fk, X.group_of(clause, _FK, 1)).when(refs, f["name"])))


def _fact_step(f: Column, seq: Column) -> Column:
    key_cols = F.when(f["is_column"], F.array(f["name"])).otherwise(X.ident_list(f["listed"]))
    fk = f["target"].isNotNull() & f["from_cols"].isNotNull()
    own_names = f["is_fk"] | f["low"].contains("foreign key references")
    return F.struct(
        seq.alias("seq"), f["kind"].alias("kind"),
        F.when(f["is_column"], f["name"]).alias("col_name"),
        F.when(f["is_column"], f["typ"]).alias("col_type"),
        (f["is_column"] & f["low"].contains("not null")).alias("not_null"),
        F.when(f["is_column"] | f["listed"].isNotNull(), f["key_type"]).alias("key_type"),
        F.when(f["key_type"].isNotNull(), key_cols).alias("key_cols"),
        F.when(fk, X.ident_list(f["from_cols"])).alias("fk_cols"),
        F.when(fk, f["target"]).alias("ref_table"),
        X.ident_list(F.when(own_names, F.coalesce(f["given"], f["from_cols"])).otherwise(f["given"]))
        .alias("ref_cols"))


def _named_columns(facts) -> Column:
    return F.transform(
        F.filter(facts, lambda f: f["col_name"].isNotNull()),
        lambda f: F.struct(f["seq"].alias("ord"), f["col_name"].alias("col_name"),
                           F.lower(f["col_name"]).alias("lcol"), f["col_type"].alias("col_type"),
                           f["not_null"].alias("not_null"), f["kind"].alias("clause_kind")))


def _declared_keys(facts) -> Column:
    return F.transform(
        F.filter(facts, lambda f: f["key_type"].isNotNull()),
        lambda f: F.struct(f["seq"].alias("seq"), f["kind"].alias("clause_kind"),
                           f["key_type"].alias("key_type"), f["key_cols"].alias("cols")))


def _spelled(names, cols: str, lcols: str) -> Column:
    """Key columns in declared order, spelled as in the column definitions; null when one is
    missing."""
    at = F.transform(names, lambda n: F.array_position(lcols, F.lower(n)).cast("int"))
    return F.when(F.forall(names, lambda n: F.array_contains(lcols, F.lower(n))),
                  F.transform(at, lambda p: F.get(F.col(cols), p - 1)["col_name"]))


def create_facts(stmts: DataFrame) -> DataFrame:
    """One row per create-table statement with its arrays:

    cols (ord, col_name, lcol, col_type, not_null, clause_kind), declared (all keys as written),
    keys (keys whose columns all exist, spelled as defined) and fks (raw references).
    """
    with_facts = _with_clauses(stmts).withColumn("facts", _facts(F.col("clauses")))
    with_cols = (
        with_facts.withColumn("named", _named_columns(F.col("facts")))
        .withColumn("names", F.col("named.lcol"))
        # The first of equal column names is kept.
        .withColumn("cols", F.filter("named", lambda c, i:
                                     F.array_position("names", c["lcol"]) == i + F.lit(1)))
        .withColumn("lcols", F.col("cols.lcol"))
        .withColumn("declared", _declared_keys(F.col("facts"))))
    keys = F.filter(
        F.transform("declared", lambda k: F.struct(
            k["seq"].alias("seq"), k["clause_kind"].alias("clause_kind"),
            k["key_type"].alias("key_type"), _spelled(k["cols"], "cols", "lcols").alias("cols"))),
        lambda k: k["cols"].isNotNull())
    fks = F.transform(
        F.filter("facts", lambda f: f["ref_table"].isNotNull()),
        lambda f: F.struct(f["seq"].alias("seq"), f["kind"].alias("clause_kind"),
                           f["fk_cols"].alias("cols"), f["ref_table"].alias("ref_table"),
                           f["ref_cols"].alias("ref_cols")))
    return (with_cols.withColumn("keys", keys).withColumn("fks", fks)
            .withColumn("lname", F.lower("table_name"))
            .select("repo_url", "file_id", "stmt_seq", "stmt_id", "table_name", "lname",
                    "cols", "lcols", "declared", "keys", "fks"))


_HEAD = ("repo_url", "file_id", "stmt_id", "table_name")


def column_defs(facts: DataFrame) -> DataFrame:
    """One row per accepted column definition."""
    return facts.select(*_HEAD, F.inline("cols"))


def declared_keys(facts: DataFrame) -> DataFrame:
    """One row per key as written, valid or not."""
    return facts.select(*_HEAD, F.inline("declared"))


def inline_pk(facts: DataFrame) -> DataFrame:
    return declared_keys(facts).filter(
        (F.col("key_type") == "PrimaryKey") & (F.col("clause_kind") == "inline_pk"))


def table_pk(facts: DataFrame) -> DataFrame:
    return declared_keys(facts).filter(F.col("clause_kind").isin("table_pk", "constraint_pk"))


def unique_keys(facts: DataFrame) -> DataFrame:
    return declared_keys(facts).filter(F.col("key_type").startswith("Unique"))


def candidate_keys(facts: DataFrame) -> DataFrame:
    return declared_keys(facts).filter(F.col("key_type") == "CandidateKey")


def indexes(facts: DataFrame) -> DataFrame:
    """Index entries: INDEX and UNIQUE INDEX clauses; each is also a key."""
    return (declared_keys(facts).filter(F.col("key_type").isin("Index", "UniqueIndex"))
            .withColumnRenamed("key_type", "index_type"))


def raw_fks(facts: DataFrame, *clause_kinds: str) -> DataFrame:
    """Foreign keys as written. ref_cols is null when the primary key of the target is meant."""
    rows = facts.select(*_HEAD, F.inline("fks"))
    return rows.filter(F.col("clause_kind").isin(*clause_kinds)) if clause_kinds else rows


def constraint_fk(facts: DataFrame) -> DataFrame:
    return raw_fks(facts, "constraint_fk")


def fk_clause(facts: DataFrame) -> DataFrame:
    return raw_fks(facts, "foreign_key")


def column_fk(facts: DataFrame) -> DataFrame:
    return raw_fks(facts, "column_ref")


def inline_pk_fk(facts: DataFrame) -> DataFrame:
    return raw_fks(facts, "inline_pk")


def ctas_items(stmts: DataFrame) -> DataFrame:
    """One row per output item of a create-as-select: a column name, or a star with its source."""
    plain = X.outer_text(F.col("stmt"))
    listed = F.regexp_replace(F.regexp_extract(plain, r"(?i)\bas select\s+(.*?)\s+from\s", 1),
                              r"(?i)\bdistinct\b", "")
    source = _name(plain, rf"(?i)\bas select\s+.*?\s+from\s+({X.NAME})")
    rows = (stmts.filter(F.col("kind") == "create_as_select")
            .withColumn("table_name", _name(plain, _CTAS_NAME))
            .withColumn("source", source)
            .select("repo_url", "file_id", "stmt_seq", "stmt_id", "table_name", "source",
                    F.posexplode(F.split(listed, ",")).alias("item_seq", "item"))
            .withColumn("item", F.trim("item"))
            .filter(F.col("table_name").isNotNull() & (F.col("item") != "")))
    item = F.col("item")
    last_word = X.clean_ident(F.element_at(F.split(item, r"\s+"), -1))
    star = item.rlike(r"^(?:\S+\.)?\*$")
    prefix = X.clean_ident(F.regexp_extract(item, r"^(\S+)\.\*$", 1))
    return rows.withColumn("is_star", star).withColumn(
        "star_source", F.when(star, F.coalesce(F.nullif(prefix, F.lit("")), "source"))).withColumn(
        "col_name", F.when(~star, X.last_part(last_word))).drop("source")


def _alter_statements(stmts: DataFrame) -> DataFrame:
    rest = F.regexp_replace("stmt", r"^.*?" + _ALTER_NAME, "")
    return (stmts.filter(F.col("kind") == "alter_table")
            .withColumn("table_ref", _name(F.col("stmt"), _ALTER_NAME))
            .withColumn("clauses", X.split_top(X.mask_punctuated_literals(rest))))


def alter_clauses(stmts: DataFrame) -> DataFrame:
    """One row per clause of an alter-table statement."""
    return _alter_statements(stmts).filter(F.col("table_ref").isNotNull()).select(
        "repo_url", "file_id", "stmt_seq", "stmt_id", "table_ref",
        F.posexplode("clauses").alias("clause_seq", "clause"))


def alter_kind(clause: Column) -> Column:
    low = F.lower(clause)
    constraint = low.contains("add constraint")
    return (F.when(low.contains("primary key"),
                   F.when(constraint | low.contains("add primary key"), "pk"))
            .when(low.contains("foreign key"),
                  F.when(constraint | low.contains("add foreign key"), "fk"))
            .when(low.contains("add unique key"), "unique_key")
            .when(low.contains("add unique index"), "unique_index")
            .when(low.rlike(r"\badd unique\b") | (constraint & low.contains("unique")), "unique_key")
            .when(low.contains("add key"), "key")
            .when(low.rlike(r"^add\b") & ~constraint, "column"))


def alter_facts(stmts: DataFrame) -> DataFrame:
    """What each alter clause adds: a key, a foreign key or a column; each clause by itself.

    Worked out inside the statement's row, as for create-table clauses.
    """
    kinds = F.transform("clauses", lambda c, i: F.struct(
        i.alias("clause_seq"), c.alias("clause"), alter_kind(c).alias("kind"),
        F.regexp_replace(c, r"(?i)^add\s+(?:column\s+)?(?:if not exists\s+)?", "").alias("tail")))
    known = F.filter(kinds, lambda f: f["kind"].isNotNull())
    facts = F.filter(F.transform(known, _alter_step), lambda f: f["ok"])
    return (_alter_statements(stmts).filter(F.col("table_ref").isNotNull())
            .select("repo_url", "file_id", "stmt_seq", "stmt_id", "table_ref", F.inline(facts)).drop("ok"))


def _alter_step(f: Column) -> Column:
    kind, clause, tail = f["kind"], f["clause"], f["tail"]
    is_column, is_fk = kind == "column", kind == "fk"
    listed = (F.when(kind == "pk", X.group_of(clause, rf"(?i)primary\s+key[^(]*{_COLS}"))
              .when(kind == "key", X.group_of(clause, rf"(?i)\bkey\b[^(]*{_COLS}"))
              .when(is_fk, X.group_of(clause, _FK, 1))
              .when(~is_column, X.group_of(clause, rf"(?i)\bunique\b[^(]*{_COLS}")))
    key_type = (F.when(kind == "pk", "PrimaryKey").when(kind == "key", "CandidateKey")
                .when(kind == "unique_index", "UniqueIndex").when(kind == "unique_key", "UniqueKey"))
    col_type = _type_after_name(tail)
    good_column = (_first_ident(tail) != "") & col_type.rlike(_KNOWN_TYPE) & ~F.lower(tail).rlike(_NO_COLUMN_HEAD)
    target = F.when(is_fk, _name(clause, _FK_TABLE))
    ok = (F.when(is_column, good_column).when(is_fk, listed.isNotNull() & target.isNotNull())
          .otherwise(listed.isNotNull()))
    return F.struct(
        f["clause_seq"].alias("clause_seq"), key_type.alias("key_type"), X.ident_list(listed).alias("cols"),
        target.alias("ref_table"),
        F.when(is_fk, X.ident_list(F.coalesce(X.group_of(clause, _FK, 3), listed))).alias("ref_cols"),
        F.when(is_column, _first_ident(tail)).alias("col_name"), F.when(is_column, col_type).alias("col_type"),
        F.lower(clause).contains("not null").alias("not_null"), F.coalesce(ok, F.lit(False)).alias("ok"))


_ALTER_HEAD = ("repo_url", "file_id", "stmt_seq", "stmt_id", "clause_seq", "table_ref")


def alter_keys(facts: DataFrame) -> DataFrame:
    """Keys added by alter table: primary, unique, unique index and candidate keys."""
    return facts.filter(F.col("key_type").isNotNull()).select(*_ALTER_HEAD, "key_type", "cols")


def alter_pk(facts: DataFrame) -> DataFrame:
    return alter_keys(facts).filter(F.col("key_type") == "PrimaryKey")


def alter_unique(facts: DataFrame) -> DataFrame:
    return alter_keys(facts).filter(F.col("key_type").startswith("Unique"))


def alter_key(facts: DataFrame) -> DataFrame:
    return alter_keys(facts).filter(F.col("key_type") == "CandidateKey")


def alter_fk(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("ref_table").isNotNull()).select(*_ALTER_HEAD, "cols", "ref_table", "ref_cols")


def alter_columns(facts: DataFrame) -> DataFrame:
    """Columns named by ADD [COLUMN], before the check whether they exist."""
    return facts.filter(F.col("col_name").isNotNull()).select(
        *_ALTER_HEAD, "col_name", "col_type", "not_null")


def create_index(stmts: DataFrame) -> DataFrame:
    """Keys from CREATE [UNIQUE] INDEX ... ON t (cols)."""
    rows = stmts.filter(F.col("kind").isin("create_index", "create_unique_index"))
    return (rows.withColumn("table_ref", _name(F.col("stmt"), _INDEX_ON))
            .withColumn("cols", X.ident_list(X.group_of(F.col("stmt"), _INDEX_ON, 2)))
            .withColumn("key_type", F.when(F.lower("stmt").contains("create unique index"),
                                           "UniqueIndex").otherwise("Index"))
            .filter(F.col("table_ref").isNotNull() & F.col("cols").isNotNull())
            .select("repo_url", "file_id", "stmt_seq", "stmt_id", F.lit(0).alias("clause_seq"),
                    "table_ref", "key_type", "cols"))


def insert_columns(stmts: DataFrame) -> DataFrame:
    """Columns named by INSERT lists, before the check whether they exist."""
    head = X.before_kw(F.col("stmt"), "values")
    rows = (stmts.filter(F.col("kind") == "insert")
            .withColumn("table_ref", _name(head, _INSERT_INTO))
            .withColumn("cols", X.ident_list(X.group_of(head, _INSERT_INTO, 2)))
            .filter(F.col("table_ref").isNotNull() & ~F.col("table_ref").contains(" ")))
    return (rows.select("repo_url", "file_id", "stmt_seq", "stmt_id", "table_ref",
                        F.posexplode("cols").alias("clause_seq", "col_name"))
            .filter(~F.col("col_name").contains(" ")))


_TARGETS = {"create": _CREATE_NAME, "ctas": _CTAS_NAME, "alter": _ALTER_NAME, "index": _INDEX_ON,
            "insert": _INSERT_INTO}


def target_name(stmt: Column, kind: str) -> Column:
    """Table a statement is about; null when the statement has not the form of its kind."""
    return _name(stmt, _TARGETS[kind])
