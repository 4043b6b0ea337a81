"""DuckDB counterparts of the registered queries.

Text operators are recomputed from the texts with DuckDB's own functions. Facts are not parsed
from text here: they are stated per corpus template (what each template declares), and resolved by
joins. So the comparison checks the text extraction against an independent source.
"""

from ..functions.fixed import base_type_rows
from ..sources.corpus import _sql_text, corpus_sql

_COMMENT = r"(''[^''\n]*'')|--[^\n]*|(?s:/\*.*?\*/)|#[ \t][^\n]*"
_Q = "''"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(name: str, cols: str, rows) -> str:
    body = ",\n".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


# --- what each template declares ------------------------------------------------------------------

# template, position, kind of each DDL statement
_DDL = [(0, 1, "create_table"), (1, 1, "create_table"), (2, 1, "create_table"), (3, 1, "create_table"),
        (4, 1, "alter_table"), (4, 3, "alter_table"), (5, 1, "create_unique_index"), (5, 3, "create_index"),
        (5, 5, "create_as_select"), (6, 1, "insert"), (6, 3, "insert"), (6, 5, "create_as_select")]

# template, position, name, type, not null, clause kind, clause text of each column
_COLUMNS = [
    (0, 0, "id", "int", True, "inline_pk", "`id` int NOT NULL PRIMARY KEY"),
    (0, 1, "userName", "varchar", True, "column", "`userName` varchar NOT NULL"),
    (0, 2, "price", "decimal", False, "column", "`price` decimal DEFAULT NULL"),
    (0, 3, "status", "char", False, "column", "`status` char default 'v'"),
    (0, 4, "note", "text", False, "column", "`note` text"),
    (1, 0, "id", "integer", False, "inline_pk", "id integer primary key"),
    (1, 1, "userName", "varchar", True, "column", "userName varchar not null"),
    (1, 2, "price", "float", False, "column", "price float"),
    (1, 3, "status", "char", False, "column", "status char"),
    (1, 4, "note", "text", False, "column", "note text"),
    (1, 5, "created_at", "timestamp", True, "column", "created_at timestamp not null"),
    (2, 0, "id", "int", True, "column", "id int NOT NULL"),
    (2, 1, "code", "varchar", True, "column", "code varchar NOT NULL"),
    (2, 2, "userName", "varchar", False, "column", "userName varchar"),
    (2, 3, "kind", "int", False, "column", "kind int CHECK ((kind > ))"),
    (2, 4, "depth", "int", False, "column",
     "depth int CHECK ((kind + (id * (id + (kind + (id))))) > coalesce(kind, id))"),
    (3, 0, "id", "bigint", False, "inline_pk", '"id" bigint PRIMARY KEY REFERENCES "{V}" ("id") ON DELETE CASCADE'),
    (3, 1, "ref_id", "int", True, "column_ref", '"ref_id" int NOT NULL REFERENCES {V}(id)'),
    (3, 2, "code", "varchar", False, "column", '"code" varchar UNIQUE'),
    (3, 3, "kind", "int", False, "column", '"kind" int'),
]

# template, position, clause kind, key type, columns, clause text (None: the column's own clause)
_KEYS = [
    (0, 0, "inline_pk", "PrimaryKey", "id", None), (1, 0, "inline_pk", "PrimaryKey", "id", None),
    (1, 6, "constraint_unique", "UniqueKey", "userName,status", "constraint uq_user unique (userName, status)"),
    (2, 5, "table_pk", "PrimaryKey", "id,code", "PRIMARY KEY (id, code)"),
    (2, 6, "unique_key", "UniqueKey", "code", "UNIQUE KEY uk_code (code ASC)"),
    (2, 7, "key", "CandidateKey", "userName", "KEY ix_user (userName)"),
    (2, 8, "key", "CandidateKey", "nope", "KEY ix_bad (nope)"),
    (2, 9, "index", "Index", "kind", "INDEX ix_kind (kind)"),
    (2, 10, "unique_index", "UniqueIndex", "kind,id", "UNIQUE INDEX ux_kind (kind, id DESC)"),
    (2, 11, "unique", "UniqueKey", "kind,code", "UNIQUE (kind, code)"),
    (3, 0, "inline_pk", "PrimaryKey", "id", None), (3, 2, "column", "UniqueColumn", "code", None),
]

# template, position, clause kind, columns, target, target columns, clause text
_FKS = [
    (3, 0, "inline_pk", "id", "{V}", "id", None), (3, 1, "column_ref", "ref_id", "{V}", "id", None),
    (3, 4, "constraint_fk", "kind", "{U}", "kind", "CONSTRAINT fk_kind FOREIGN KEY (kind) REFERENCES {U} (kind)"),
    (3, 5, "foreign_key", "code", "public.{U}", "code",
     "FOREIGN KEY (code) REFERENCES public.{U} ON DELETE CASCADE"),
]

# statement position, clause position, table, what it adds, columns, target, target columns, text
_ALTERS = [
    (1, 0, "{T}", "PrimaryKey", "id", None, None, "ADD PRIMARY KEY (id)"),
    (1, 1, "{T}", "fk", "id,kind", "{U}", "id,kind",
     "ADD CONSTRAINT fk_u FOREIGN KEY (id, kind) REFERENCES {U} (id, kind)"),
    (1, 2, "{T}", "UniqueKey", "userName", None, None, "ADD UNIQUE KEY uk_n (userName)"),
    (1, 3, "{T}", "column", "extra", "varchar", None, "ADD COLUMN extra varchar"),
    (1, 4, "{T}", "CandidateKey", "price", None, None, "ADD KEY kx (price)"),
    (1, 5, "{T}", "PrimaryKey", "id,price", None, None, "ADD CONSTRAINT pk_p PRIMARY KEY (id, price)"),
    (1, 6, "{T}", "UniqueKey", "price", None, None, "ADD CONSTRAINT uq_p UNIQUE (price)"),
    (3, 0, "a_{k}", "fk", "id", "{U}", "id", "ADD FOREIGN KEY (id) REFERENCES {U} (id)"),
    (3, 1, "a_{k}", "column", "id", "int", None, "ADD id int"),
    (3, 2, "a_{k}", "none", "", None, None, "ADD INDEX ix (id)"),
    (3, 3, "a_{k}", "UniqueIndex", "id", None, None, "ADD UNIQUE INDEX ux (id)"),
]

# template, query position, scope lo, hi, parent lo, depth, join type, own text
_END = 2147483647
_SCOPES = [
    (5, 2, 0, _END, -1, 0, "inner", "CREATE TABLE c_{k} AS SELECT * FROM {T}"),
    (6, 2, 0, _END, -1, 0, "inner", "create view v_{k} as select {T}.id, userName as who, {U}.* from {T}, {U}"),
    (7, 0, 0, _END, -1, 0, "inner",
     "SELECT a.id, b.userName FROM {T} a INNER JOIN {U} AS b ON a.id = b.id WHERE a.status = '' AND b.price >= 10 AND a.kind < b.kind"),
    (7, 2, 0, _END, -1, 0, "left",
     "select a.code from {V} as a left join {T} b on (a.code = b.code) left outer join {U} c on c.id = b.id where 3 < c.kind or b.nosuch = a.id"),
    (8, 0, 0, _END, -1, 0, "inner", "SELECT userName, COUNT(id) AS n, max(price) from {TU} GROUP BY userName"),
    (8, 2, 0, 5, -1, 0, "inner", "select status st, Sum(price) total FROM {T} where kind = 3 group by st"),
    (8, 2, 6, _END, -1, 0, "inner", "select code, count(*) from {U} group by code"),
    (9, 0, 0, _END, -1, 0, "inner", "select x.id, y.n from {T} x join (#1) y on x.id = y.rid and y.kind <= x.kind"),
    (9, 0, 1, 7, 0, 1, "inner", "select id as rid, kind, count(id) as n from {U} where kind > 2 group by id, kind"),
    (9, 1, 0, _END, -1, 0, "inner",
     "select * from {T} , {U} where {T}.id = {U}.id and {T}.code <> {U}.code and userName = note"),
    (9, 2, 0, _END, -1, 0, "inner", "select t.price from {T} t where exists (#1)"),
    (9, 2, 1, 6, 0, 1, "inner", "select 1 from {U} u where u.id = t.id and u.status in ('', '')"),
    (9, 3, 0, _END, -1, 0, "right",
     "with w (rid, amount) as (#5), deep as (#9) select w.amount, t.note from {T} t join w on t.id = w.rid right join deep d on d.zid = t.id"),
    (9, 3, 5, 7, 0, 1, "inner", "select u.id, u.price from {U} u where u.kind = 4"),
    (9, 3, 9, 15, 0, 1, "inner", "select z.rid as zid from (#11) z where z.rid > 0"),
    (9, 3, 11, 13, 9, 2, "inner", "select id as rid, code from {T} where code = ''"),
    (9, 4, 0, _END, -1, 0, "full", "with recursive r as (#1) select r.id from r full join {T} x on x.id == r.id"),
    (9, 4, 1, 3, 0, 1, "inner", "select id, kind from {U}"),
    (9, 4, 4, 5, 0, 1, "inner", "select c.id, c.kind from {U} c join r on c.kind = r.id"),
    (9, 5, 0, _END, -1, 0, "inner",
     "select extract(year from f(g(h(j(t.created_at))))) as y, t.note from {T} t join {U} u on u.id = t.id and u.kind >= current_date where (t.status = '')"),
]

# template, query, lo, position, alias (None: the table's own name), table (None: derived), child
_SCOPE_TABLES = [
    (5, 2, 0, 0, None, "{T}", -1), (6, 2, 0, 0, None, "{T}", -1), (6, 2, 0, 1, None, "{U}", -1),
    (7, 0, 0, 0, "a", "{T}", -1), (7, 0, 0, 1, "b", "{U}", -1),
    (7, 2, 0, 0, "a", "{V}", -1), (7, 2, 0, 1, "b", "{T}", -1), (7, 2, 0, 2, "c", "{U}", -1),
    (8, 0, 0, 0, None, "{TU}", -1), (8, 2, 0, 0, None, "{T}", -1), (8, 2, 6, 0, None, "{U}", -1),
    (9, 0, 0, 0, "x", "{T}", -1), (9, 0, 0, 1, "y", None, 1), (9, 0, 1, 0, None, "{U}", -1),
    (9, 1, 0, 0, None, "{T}", -1), (9, 1, 0, 1, None, "{U}", -1),
    (9, 2, 0, 0, "t", "{T}", -1), (9, 2, 1, 0, "u", "{U}", -1),
    (9, 3, 0, 0, "t", "{T}", -1), (9, 3, 0, 1, "w", None, 5), (9, 3, 0, 2, "d", None, 9),
    (9, 3, 5, 0, "u", "{U}", -1), (9, 3, 9, 0, "z", None, 11), (9, 3, 11, 0, None, "{T}", -1),
    (9, 4, 0, 0, "r", None, 1), (9, 4, 0, 1, "x", "{T}", -1), (9, 4, 1, 0, None, "{U}", -1),
    (9, 4, 4, 0, "c", "{U}", -1), (9, 4, 4, 1, "r", None, 1),
    (9, 5, 0, 0, "t", "{T}", -1), (9, 5, 0, 1, "u", "{U}", -1),
]

# template, query, lo, position, text, operator name (None: dropped), left table and column, right
# table and column (table '?': no prefix), derived; no columns: not a join candidate
_ATOMS = [
    (7, 0, 0, 0, "a.id = b.id", "Eq", "{T}", "id", "{U}", "id", False),
    (7, 0, 0, 1, "a.status = ''", "Eq", None, None, None, None, False),
    (7, 0, 0, 2, "b.price >= 10", "GtEq", None, None, None, None, False),
    (7, 0, 0, 3, "a.kind < b.kind", "Lt", "{T}", "kind", "{U}", "kind", False),
    (7, 2, 0, 0, "a.code = b.code", "Eq", "{V}", "code", "{T}", "code", False),
    (7, 2, 0, 1, "c.id = b.id", "Eq", "{U}", "id", "{T}", "id", False),
    (7, 2, 0, 2, "3 < c.kind", "Lt", None, None, None, None, False),
    (7, 2, 0, 3, "b.nosuch = a.id", "Eq", "{T}", "nosuch", "{V}", "id", False),
    (8, 2, 0, 0, "kind = 3", "Eq", None, None, None, None, False),
    (9, 0, 0, 0, "x.id = y.rid", "Eq", "{T}", "id", "{U}", "id", True),
    (9, 0, 0, 1, "y.kind <= x.kind", "LtEq", "{U}", "kind", "{T}", "kind", True),
    (9, 0, 1, 0, "kind > 2", "Gt", None, None, None, None, False),
    (9, 1, 0, 0, "{T}.id = {U}.id", "Eq", "{T}", "id", "{U}", "id", False),
    (9, 1, 0, 1, "{T}.code <> {U}.code", None, None, None, None, None, False),
    (9, 1, 0, 2, "userName = note", "Eq", "?", "username", "?", "note", False),
    (9, 2, 1, 0, "u.id = t.id", "Eq", "{U}", "id", "{T}", "id", False),
    (9, 3, 0, 0, "t.id = w.rid", "Eq", "{T}", "id", "{U}", "id", True),
    (9, 3, 0, 1, "d.zid = t.id", "Eq", "{T}", "id", "{T}", "id", True),
    (9, 3, 5, 0, "u.kind = 4", "Eq", None, None, None, None, False),
    (9, 3, 9, 0, "z.rid > 0", "Gt", None, None, None, None, False),
    (9, 3, 11, 0, "code = ''", "Eq", None, None, None, None, False),
    (9, 4, 0, 0, "x.id == r.id", "Eq", "{T}", "id", "{U}", "id", True),
    (9, 4, 4, 0, "c.kind = r.id", "Eq", "{U}", "kind", "{U}", "id", True),
    (9, 5, 0, 0, "u.id = t.id", "Eq", "{U}", "id", "{T}", "id", False),
    (9, 5, 0, 1, "u.kind >= current_date", "GtEq", "{U}", "kind", "?", "current_date", False),
    (9, 5, 0, 2, "t.status = ''", "Eq", None, None, None, None, False),
]

# template, query, lo, position of the candidates with a side that is no column
_UNLISTED = {(9, 5, 0, 1)}

# template, query, lo, atom position, side, place, table, column: further tables of a derived side
_MORE_TABLES = [(9, 4, 0, 0, "r", 1, "{U}", "id"), (9, 4, 4, 0, "r", 1, "{U}", "id")]

# template, query, kind, function, table, column ('*': all columns)
_REFS = [
    (5, 2, "projection", "", "{T}", "*"), (6, 2, "projection", "", "{T}", "id"),
    (6, 2, "projection", "", "{T}", "username"), (6, 2, "projection", "", "{U}", "username"),
    (6, 2, "projection", "", "{U}", "*"),
    (7, 0, "projection", "", "{T}", "id"), (7, 0, "projection", "", "{U}", "username"),
    (7, 0, "selection", "", "{T}", "status"), (7, 0, "selection", "", "{U}", "price"),
    (7, 2, "projection", "", "{V}", "code"), (7, 2, "selection", "", "{U}", "kind"),
    (8, 0, "projection", "", "{T}", "username"), (8, 0, "projection", "", "{T}", "id"),
    (8, 0, "projection", "", "{T}", "price"), (8, 0, "aggregate", "count", "{T}", "id"),
    (8, 0, "aggregate", "max", "{T}", "price"), (8, 0, "groupby", "", "{T}", "username"),
    (8, 2, "projection", "", "{T}", "status"), (8, 2, "projection", "", "{T}", "price"),
    (8, 2, "projection", "", "{U}", "code"), (8, 2, "aggregate", "sum", "{T}", "price"),
    (8, 2, "selection", "", "{T}", "kind"), (8, 2, "groupby", "", "{T}", "status"),
    (8, 2, "groupby", "", "{U}", "code"),
    (9, 0, "projection", "", "{T}", "id"), (9, 0, "projection", "", "{U}", "id"),
    (9, 0, "projection", "", "{U}", "kind"), (9, 0, "aggregate", "count", "{U}", "id"),
    (9, 0, "selection", "", "{U}", "kind"), (9, 0, "groupby", "", "{U}", "id"),
    (9, 0, "groupby", "", "{U}", "kind"),
    (9, 1, "projection", "", "{T}", "*"), (9, 1, "projection", "", "{U}", "*"),
    (9, 2, "projection", "", "{T}", "price"),
    (9, 3, "projection", "", "{U}", "price"), (9, 3, "projection", "", "{T}", "note"),
    (9, 3, "projection", "", "{U}", "id"), (9, 3, "projection", "", "{T}", "id"),
    (9, 3, "projection", "", "{T}", "code"), (9, 3, "selection", "", "{U}", "kind"),
    (9, 3, "selection", "", "{T}", "id"), (9, 3, "selection", "", "{T}", "code"),
    (9, 4, "projection", "", "{U}", "id"), (9, 4, "projection", "", "{U}", "kind"),
    (9, 5, "projection", "", "{T}", "note"), (9, 5, "selection", "", "{T}", "status"),
]

# template, query, lo, expression, output name, function of the items of nested scopes
_INNER_ITEMS = [(9, 0, 1, "id", "rid", ""), (9, 0, 1, "kind", "kind", ""), (9, 0, 1, "id", "n", "count"),
                (9, 3, 5, "u.id", "rid", ""), (9, 3, 5, "u.price", "amount", ""), (9, 3, 9, "z.rid", "zid", ""),
                (9, 3, 11, "id", "rid", ""), (9, 3, 11, "code", "code", ""), (9, 4, 1, "id", "id", ""),
                (9, 4, 1, "kind", "kind", ""), (9, 4, 4, "c.id", "id", ""), (9, 4, 4, "c.kind", "kind", "")]

# template, query position, is a union, is join-like
_QUERIES = [(5, 2, False, False), (6, 2, False, False), (7, 0, False, True), (7, 2, False, True),
            (8, 0, False, False), (8, 2, True, False), (9, 0, False, True), (9, 1, False, True),
            (9, 2, False, False), (9, 3, False, True), (9, 4, True, True), (9, 5, False, True)]


def _render(col: str) -> str:
    """Replace template names inside a stated value."""
    expr = col
    for name in ("TU", "T", "U", "V", "k"):
        expr = f"replace({expr}, '{{{name}}}', f.\"{name}\")"
    return expr


def _base() -> str:
    """Stated facts joined to the files: one CTE per fact."""
    planted = [
        _values("p_ddl", "tpl, seq, kind", _DDL),
        _values("p_col", "tpl, ord, col_name, col_type, not_null, clause_kind, clause", _COLUMNS),
        _values("p_key", "tpl, seq, clause_kind, key_type, cols, clause", _KEYS),
        _values("p_fk", "tpl, seq, clause_kind, cols, ref_table, ref_cols, clause", _FKS),
        _values("p_alter", "seq, clause_seq, table_ref, adds, cols, target, target_cols, clause", _ALTERS),
        _values("p_scope", "tpl, q, lo, hi, parent_lo, depth, join_type, own_text", _SCOPES),
        _values("p_tab", "tpl, q, lo, pos, alias, table_ref, child", _SCOPE_TABLES),
        _values("p_atom", "tpl, q, lo, atom_seq, atom, op, l_ref, l_col, r_ref, r_col, derived, listed",
                [(*a, a[:4] not in _UNLISTED) for a in _ATOMS]),
        _values("p_more", "tpl, q, lo, atom_seq, side, pos, table_ref, lcol", _MORE_TABLES),
        _values("p_ref", "tpl, q, kind, func, table_ref, lcol", _REFS),
        _values("p_item", "tpl, q, lo, expr, out, func", _INNER_ITEMS),
        _values("p_query", "tpl, q, is_union, join_like", _QUERIES),
        _values("p_type", "col_type, base_type", base_type_rows()),
    ]
    ddl_id = "f.file_id || '#d%s#' || f.repo_url"
    q_id = "f.file_id || '#q' || p.q || '#' || f.repo_url"
    derived = f"""
    created AS (
      SELECT f.repo_url, f."user", f.file_id, f.tpl, f."T" AS table_name, f."U", f."V", 1 AS stmt_seq,
             {ddl_id % '1'} AS stmt_id,
             (SELECT count(*) FROM p_col c WHERE c.tpl = f.tpl) AS n_cols,
             (SELECT count(*) FROM p_key k WHERE k.tpl = f.tpl AND k.cols <> 'nope')
             + (SELECT count(*) FROM p_fk k WHERE k.tpl = f.tpl) AS n_keys
      FROM files f WHERE f.tpl IN (0, 1, 2, 3)),
    c_col AS (
      SELECT v.repo_url, v.file_id, v.stmt_id, v.stmt_seq, v.table_name, c.ord, c.col_name,
             lower(c.col_name) AS lcol, c.col_type, c.not_null, c.clause_kind
      FROM created v JOIN p_col c USING (tpl)),
    c_key AS (
      SELECT v.repo_url, v.file_id, v.stmt_id, v.stmt_seq, v.table_name, k.seq, k.clause_kind, k.key_type, k.cols
      FROM created v JOIN p_key k USING (tpl)),
    c_fk AS (
      SELECT f.repo_url, f.file_id, {ddl_id % '1'} AS stmt_id, 1 AS stmt_seq, f."T" AS table_name, k.seq,
             k.clause_kind, k.cols, {_render('k.ref_table')} AS ref_table, k.ref_cols
      FROM files f JOIN p_fk k USING (tpl)),
    c_clause AS (
      SELECT v.stmt_id, ord AS clause_seq, {_render('clause')} AS clause, clause_kind
      FROM files f JOIN created v USING (file_id, repo_url)
      JOIN (SELECT tpl, ord, clause, clause_kind FROM p_col
            UNION SELECT tpl, seq, clause, clause_kind FROM p_key WHERE clause IS NOT NULL
            UNION SELECT tpl, seq, clause, clause_kind FROM p_fk WHERE clause IS NOT NULL) x ON x.tpl = f.tpl),
    first_pick AS (
      SELECT * FROM created QUALIFY row_number() OVER (
        PARTITION BY repo_url, table_name ORDER BY n_cols DESC, n_keys DESC, file_id DESC, stmt_seq DESC) = 1),
    first_col AS (
      SELECT c.* FROM c_col c JOIN first_pick USING (stmt_id)),
    made_col AS (
      SELECT f.repo_url, f.file_id, 5 AS stmt_seq, {ddl_id % '5'} AS stmt_id, 'c_' || f."k" AS table_name,
             0 AS item, c.ord, c.col_name, c.col_type
      FROM files f JOIN first_col c ON f.tpl = 5 AND c.repo_url = f.repo_url AND c.table_name = f."T"
      UNION ALL
      SELECT f.repo_url, f.file_id, 5, {ddl_id % '5'}, 'v_' || f."k", i, 0, n, NULL
      FROM files f, (VALUES (0, 'id'), (1, 'who')) x(i, n) WHERE f.tpl = 6
      UNION ALL
      SELECT f.repo_url, f.file_id, 5, {ddl_id % '5'}, 'v_' || f."k", 2, c.ord, c.col_name, c.col_type
      FROM files f JOIN first_col c ON f.tpl = 6 AND c.repo_url = f.repo_url AND c.table_name = f."U"),
    ctas_col AS (
      SELECT *, lower(col_name) AS lcol FROM made_col
      QUALIFY row_number() OVER (PARTITION BY stmt_id, lower(col_name) ORDER BY item, ord) = 1),
    versions AS (
      SELECT repo_url, file_id, stmt_seq, stmt_id, table_name, n_cols, n_keys FROM created
      UNION ALL
      SELECT repo_url, file_id, stmt_seq, stmt_id, table_name, count(*), 0 FROM ctas_col GROUP BY ALL),
    picked AS (
      SELECT * FROM versions QUALIFY row_number() OVER (
        PARTITION BY repo_url, table_name ORDER BY n_cols DESC, n_keys DESC, file_id DESC, stmt_seq DESC) = 1),
    all_def AS (
      SELECT stmt_id, repo_url, file_id, stmt_seq, table_name, ord, col_name, lcol, col_type, not_null FROM c_col
      UNION ALL
      SELECT stmt_id, repo_url, file_id, stmt_seq, table_name,
             row_number() OVER (PARTITION BY stmt_id ORDER BY item, ord) - 1, col_name, lcol, col_type, false
      FROM ctas_col),
    base_col AS (
      SELECT d.*, 'create' AS origin FROM all_def d JOIN picked USING (stmt_id)),
    alter_rows AS (
      SELECT f.repo_url, f.file_id, a.seq AS stmt_seq, f.file_id || '#d' || a.seq || '#' || f.repo_url AS stmt_id, a.clause_seq,
             {_render('a.table_ref')} AS table_ref, a.adds, a.cols, {_render('a.target')} AS target, a.target_cols,
             {_render('a.clause')} AS clause
      FROM files f, p_alter a WHERE f.tpl = 4),
    alter_new AS (
      SELECT repo_url, table_ref AS table_name, min(file_id) AS file_id,
             arg_min(stmt_seq, (file_id, stmt_seq)) AS stmt_seq
      FROM alter_rows a WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.repo_url = a.repo_url AND p.table_name = a.table_ref)
      GROUP BY 1, 2),
    tables_a AS (
      SELECT repo_url, table_name, file_id, stmt_seq FROM picked
      UNION ALL SELECT repo_url, table_name, file_id, stmt_seq FROM alter_new),
    alter_col AS (
      SELECT repo_url, table_ref AS table_name, lower(cols) AS lcol, cols AS col_name, target AS col_type,
             false AS not_null, 'alter' AS origin, file_id, stmt_seq, clause_seq AS ord
      FROM alter_rows a WHERE adds = 'column'
        AND NOT EXISTS (SELECT 1 FROM base_col b WHERE b.repo_url = a.repo_url AND b.table_name = a.table_ref AND b.lcol = lower(a.cols))
      QUALIFY row_number() OVER (PARTITION BY repo_url, table_ref, lower(cols) ORDER BY file_id, stmt_seq, clause_seq) = 1),
    columns_a AS (
      SELECT repo_url, table_name, lcol, col_name, col_type, not_null, origin, file_id, stmt_seq, ord FROM base_col
      UNION ALL SELECT repo_url, table_name, lcol, col_name, col_type, not_null, origin, file_id, stmt_seq, ord FROM alter_col),
    insert_rows AS (
      SELECT f.repo_url, f.file_id, seq AS stmt_seq, f.file_id || '#d' || seq || '#' || f.repo_url AS stmt_id, {_render('x.t')} AS table_ref, ord, col_name
      FROM files f, (VALUES (1, '{{T}}', 0, 'id'), (1, '{{T}}', 1, 'userName'), (1, '{{T}}', 2, 'memo'),
                            (3, 'log_{{k}}', 0, 'id'), (3, 'log_{{k}}', 1, 'msg')) x(seq, t, ord, col_name)
      WHERE f.tpl = 6),
    insert_new AS (
      SELECT repo_url, table_ref AS table_name, min(file_id) AS file_id,
             arg_min(stmt_seq, (file_id, stmt_seq)) AS stmt_seq
      FROM insert_rows a WHERE NOT EXISTS (SELECT 1 FROM tables_a p WHERE p.repo_url = a.repo_url AND p.table_name = a.table_ref)
      GROUP BY 1, 2),
    all_tables AS (
      SELECT * FROM tables_a UNION ALL SELECT repo_url, table_name, file_id, stmt_seq FROM insert_new),
    insert_col AS (
      SELECT repo_url, table_ref AS table_name, lower(col_name) AS lcol, col_name, CAST(NULL AS VARCHAR) AS col_type,
             false AS not_null, 'insert' AS origin, file_id, stmt_seq, ord
      FROM insert_rows a
      WHERE NOT EXISTS (SELECT 1 FROM columns_a b WHERE b.repo_url = a.repo_url AND b.table_name = a.table_ref AND b.lcol = lower(a.col_name))
      QUALIFY row_number() OVER (PARTITION BY repo_url, table_ref, lower(col_name) ORDER BY file_id, stmt_seq, ord) = 1),
    all_col AS (
      SELECT * FROM columns_a UNION ALL SELECT * FROM insert_col),
    final_tables AS (
      SELECT * FROM all_tables t WHERE EXISTS (
        SELECT 1 FROM all_col c WHERE c.repo_url = t.repo_url AND c.table_name = t.table_name)),
    index_rows AS (
      SELECT f.repo_url, f.file_id, seq AS stmt_seq, f.file_id || '#d' || seq || '#' || f.repo_url AS stmt_id, {_render('x.t')} AS table_ref,
             f."T" AS table_name, key_type, cols
      FROM files f, (VALUES (1, 'app.{{T}}', 'UniqueIndex', 'id,code'), (3, '{{T}}', 'Index', 'status')) x(seq, t, key_type, cols)
      WHERE f.tpl = 5),
    later_key AS (
      SELECT repo_url, file_id, stmt_seq, stmt_id, clause_seq, table_ref AS table_name, adds AS key_type, cols
      FROM alter_rows WHERE adds NOT IN ('fk', 'column', 'none')
      UNION ALL
      SELECT i.repo_url, i.file_id, i.stmt_seq, i.stmt_id, 0, t.table_name, i.key_type, i.cols
      FROM index_rows i LEFT JOIN tables_a t ON t.repo_url = i.repo_url AND t.table_name = i.table_name),
    later_checked AS (
      SELECT k.*, NOT EXISTS (
        SELECT 1 FROM (SELECT unnest(string_split(k.cols, ',')) AS c) x
        WHERE NOT EXISTS (SELECT 1 FROM columns_a b WHERE b.repo_url = k.repo_url AND b.table_name = k.table_name AND b.lcol = lower(x.c))) AS valid
      FROM later_key k),
    all_key AS (
      SELECT k.repo_url, k.table_name, k.stmt_id, k.seq AS clause_seq, k.file_id, k.stmt_seq, k.key_type, k.cols
      FROM c_key k JOIN picked USING (stmt_id) WHERE k.cols <> 'nope'
      UNION ALL
      SELECT repo_url, table_name, stmt_id, clause_seq, file_id, stmt_seq, key_type, cols FROM later_checked WHERE valid),
    fk_refs AS (
      SELECT DISTINCT repo_url, table_name AS table_ref, cols, ref_table, ref_cols FROM c_fk
      UNION
      SELECT repo_url, table_ref, cols, target, target_cols FROM alter_rows WHERE adds = 'fk'),
    fk_named AS (
      SELECT k.*, t.table_name AS ref_name
      FROM fk_refs k LEFT JOIN all_tables t
        ON t.repo_url = k.repo_url AND t.table_name = replace(k.ref_table, 'public.', '')),
    fk_part AS (
      SELECT k.*, unnest(string_split(cols, ',')) AS c, unnest(string_split(ref_cols, ',')) AS rc FROM fk_named k),
    fk_done AS (
      SELECT p.repo_url, p.table_ref, p.cols, p.ref_table, p.ref_cols, p.ref_name,
             bool_and(a.lcol IS NOT NULL AND b.lcol IS NOT NULL) AS resolved
      FROM fk_part p
      LEFT JOIN all_col a ON a.repo_url = p.repo_url AND a.table_name = p.table_ref AND a.lcol = lower(p.c)
      LEFT JOIN all_col b ON b.repo_url = p.repo_url AND b.table_name = p.ref_name AND b.lcol = lower(p.rc)
      GROUP BY ALL),
    fk_resolved AS (
      SELECT DISTINCT repo_url, table_ref AS table_name, cols, ref_name, ref_cols FROM fk_done WHERE resolved),
    q_all AS (
      SELECT f.repo_url, f.file_id, {q_id} AS stmt_id, p.* EXCLUDE (tpl) FROM files f JOIN p_query p USING (tpl)),
    q_scope AS (
      SELECT {q_id} AS stmt_id, p.lo, p.hi, p.parent_lo, p.depth, p.join_type, {_render('p.own_text')} AS own_text
      FROM files f JOIN p_scope p USING (tpl)),
    q_tab AS (
      SELECT f.repo_url, {q_id} AS stmt_id, p.lo, p.pos, {_render('p.table_ref')} AS table_ref, p.alias, p.child
      FROM files f JOIN p_tab p USING (tpl)),
    q_atom AS (
      SELECT f.repo_url, f.file_id, {q_id} AS stmt_id, p.lo, p.atom_seq, {_render('p.atom')} AS atom, p.op,
             {_render('p.l_ref')} AS l_ref, p.l_col, {_render('p.r_ref')} AS r_ref, p.r_col, p.derived, p.listed
      FROM files f JOIN p_atom p USING (tpl)),
    q_more AS (
      SELECT f.repo_url, {q_id} AS stmt_id, p.lo, p.atom_seq, p.side, p.pos, {_render('p.table_ref')} AS table_ref, p.lcol
      FROM files f JOIN p_more p USING (tpl)),
    owner AS (
      SELECT repo_url, lcol, table_name, col_name, file_id, stmt_seq FROM all_col
      QUALIFY row_number() OVER (PARTITION BY repo_url, lcol ORDER BY file_id, stmt_seq, table_name) = 1),
    side AS (
      SELECT a.repo_url, a.stmt_id, a.lo, a.atom_seq, 'l' AS side, a.l_ref AS ref, a.l_col AS lcol FROM q_atom a WHERE l_ref IS NOT NULL AND listed
      UNION ALL
      SELECT a.repo_url, a.stmt_id, a.lo, a.atom_seq, 'r', a.r_ref, a.r_col FROM q_atom a WHERE r_ref IS NOT NULL AND listed),
    side_cand AS (
      SELECT s.repo_url, s.stmt_id, s.lo, s.atom_seq, s.side, 0 AS pos, s.ref AS table_ref, s.lcol FROM side s WHERE ref <> '?'
      UNION ALL
      SELECT s.repo_url, s.stmt_id, s.lo, s.atom_seq, s.side, t.pos, t.table_ref, s.lcol
      FROM side s JOIN q_tab t USING (stmt_id, lo) WHERE s.ref = '?'
      UNION ALL
      SELECT repo_url, stmt_id, lo, atom_seq, side, pos, table_ref, lcol FROM q_more),
    side_done AS (
      SELECT s.stmt_id, s.lo, s.atom_seq, s.side, s.ref, s.lcol,
             coalesce(arg_min(c.table_name, k.pos) FILTER (c.table_name IS NOT NULL),
                      CASE WHEN s.ref = '?' THEN any_value(o.table_name) END) AS table_name,
             coalesce(arg_min(c.col_name, k.pos) FILTER (c.table_name IS NOT NULL),
                      CASE WHEN s.ref = '?' THEN any_value(o.col_name) END) AS col_name,
             coalesce(bool_or(t.table_name IS NOT NULL), false) AND s.ref <> '?' AS has_table
      FROM side s
      LEFT JOIN side_cand k ON k.stmt_id = s.stmt_id AND k.lo = s.lo AND k.atom_seq = s.atom_seq AND k.side = s.side
      LEFT JOIN all_tables t ON t.repo_url = s.repo_url AND t.table_name = lower(k.table_ref)
      LEFT JOIN all_col c ON c.repo_url = s.repo_url AND c.table_name = lower(k.table_ref) AND c.lcol = s.lcol
      LEFT JOIN owner o ON o.repo_url = s.repo_url AND o.lcol = s.lcol
      GROUP BY s.stmt_id, s.lo, s.atom_seq, s.side, s.ref, s.lcol),
    cond AS (
      SELECT a.repo_url, a.file_id, a.stmt_id, a.lo, a.atom_seq, a.atom AS condition, a.op, a.derived,
             l.table_name AS l_table, l.col_name AS l_col, r.table_name AS r_table, r.col_name AS r_col,
             CASE WHEN l.table_name IS NULL THEN 'left' WHEN r.table_name IS NULL THEN 'right' END AS side,
             CASE WHEN l.table_name IS NULL THEN CASE WHEN l.has_table THEN 'column' ELSE 'table' END
                  WHEN r.table_name IS NULL THEN CASE WHEN r.has_table THEN 'column' ELSE 'table' END END AS reason,
             CASE WHEN l.table_name IS NULL THEN CASE WHEN l.has_table THEN l.lcol WHEN l.ref <> '?' THEN l.ref END
                  WHEN r.table_name IS NULL THEN CASE WHEN r.has_table THEN r.lcol WHEN r.ref <> '?' THEN r.ref END END AS name
      FROM q_atom a
      JOIN side_done l ON l.stmt_id = a.stmt_id AND l.lo = a.lo AND l.atom_seq = a.atom_seq AND l.side = 'l'
      JOIN side_done r ON r.stmt_id = a.stmt_id AND r.lo = a.lo AND r.atom_seq = a.atom_seq AND r.side = 'r'),
    fail AS (SELECT * FROM cond WHERE reason IS NOT NULL),
    pair AS (
      SELECT repo_url, file_id, stmt_id, lo, least(l_table, r_table) AS l_table, greatest(l_table, r_table) AS r_table,
             CASE WHEN l_table > r_table
                  THEN r_col || ' ' || CASE op WHEN 'Lt' THEN 'Gt' WHEN 'Gt' THEN 'Lt' WHEN 'LtEq' THEN 'GtEq' WHEN 'GtEq' THEN 'LtEq' ELSE op END || ' ' || l_col
                  ELSE l_col || ' ' || op || ' ' || r_col END AS c,
             CASE WHEN l_table > r_table THEN r_col ELSE l_col END AS lc,
             CASE WHEN l_table > r_table THEN l_col ELSE r_col END AS rc, op
      FROM cond WHERE reason IS NULL),
    joins AS (
      SELECT repo_url, file_id, stmt_id, lo, l_table, r_table, string_agg(DISTINCT c, ',' ORDER BY c) AS conditions,
             count(DISTINCT c) AS n FROM pair GROUP BY ALL),
    refs AS (
      SELECT DISTINCT f.repo_url, f.file_id, {q_id} AS stmt_id, p.kind, p.func, c.table_name, c.col_name
      FROM files f JOIN p_ref p USING (tpl)
      JOIN all_col c ON c.repo_url = f.repo_url AND c.table_name = {_render('p.table_ref')} AND (c.lcol = p.lcol OR p.lcol = '*')),
    queries AS (
      SELECT stmt_id, any_value(repo_url) AS repo_url, sum(j)::BIGINT AS n_joins, sum(n)::BIGINT AS n_conditions,
             bool_or(kind = 'projection') AS has_projection, bool_or(kind = 'aggregate') AS has_aggregate,
             bool_or(kind = 'selection') AS has_selection, bool_or(kind = 'groupby') AS has_groupby
      FROM (SELECT repo_url, stmt_id, kind, 0 AS j, 0 AS n FROM refs
            UNION ALL SELECT repo_url, stmt_id, 'join', 1, n FROM joins) GROUP BY stmt_id),
    mark AS (
      SELECT repo_url, table_name, lower(c) AS lcol, bool_or(key_type = 'PrimaryKey') AS in_pk, bool_or(single) AS single
      FROM (SELECT repo_url, table_name, key_type, unnest(string_split(cols, ',')) AS c, NOT contains(cols, ',') AS single
            FROM all_key WHERE key_type IN ('PrimaryKey', 'UniqueColumn')) GROUP BY 1, 2, 3),
    n_pk AS (
      SELECT repo_url, table_name, count(*) AS n FROM all_key WHERE key_type = 'PrimaryKey' GROUP BY 1, 2),
    label AS (
      SELECT c.repo_url, c.table_name, c.col_name, c.lcol, t.file_id AS file, c.table_name AS "table",
             lower(regexp_replace(c.col_name, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS "column",
             CASE WHEN coalesce(m.single, false) AND coalesce(n.n, 0) <= 1 THEN '[UNIQUE]'
                  WHEN c.not_null OR coalesce(m.in_pk, false) THEN '[NOTNULL]' ELSE '' END AS label,
             c.not_null OR coalesce(m.in_pk, false) AS not_null_col
      FROM all_col c JOIN all_tables t USING (repo_url, table_name)
      LEFT JOIN mark m USING (repo_url, table_name, lcol) LEFT JOIN n_pk n USING (repo_url, table_name)),
    signature AS (
      SELECT t.repo_url, t.table_name, t.file_id,
             t.table_name || ':' || (SELECT string_agg(c.col_name, '___' ORDER BY c.col_name) FROM all_col c
                                     WHERE c.repo_url = t.repo_url AND c.table_name = t.table_name) AS cluster_key
      FROM final_tables t),
    constraints AS (
      SELECT repo_url, table_name, count(*) AS n_cols, count(*) FILTER (label = '[UNIQUE]') AS n_unique,
             count(*) FILTER (label = '[NOTNULL]') AS n_notnull, count(*) FILTER (label = '') AS n_none,
             count(*) FILTER (not_null_col) AS n_not_null_cols,
             count(*) FILTER (not_null_col) / count(*) AS notnull_share
      FROM label GROUP BY 1, 2),
    kept AS (
      SELECT * FROM constraints WHERE notnull_share <= 0.5 AND n_none < n_cols),
    kept_first AS (
      SELECT * FROM kept JOIN signature USING (repo_url, table_name)
      QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY repo_url, file_id, table_name) = 1),
    log_in AS (
      SELECT CASE o_orderkey % 4
               WHEN 0 THEN 'create table total: ' || o_orderkey || ', create table succ: ' || o_custkey || ', create table except: 1'
               WHEN 1 THEN 'repo parse done'
               WHEN 2 THEN 'query_succ: ' || o_custkey || ', query_except: ' || o_orderkey
               ELSE 'create: ' || o_orderkey || '.sql' END AS value, o_orderkey, o_custkey FROM orders),
    normal AS (
      SELECT repo_url, file_id, trim(regexp_replace(regexp_replace(text, '{_COMMENT}', '\\1', 'g'), '\\s+', ' ', 'g')) AS text FROM scripts),
    piece AS (
      SELECT repo_url, file_id, seq - 1 AS stmt_seq, s AS stmt, file_id || '#d' || (seq - 1) || '#' || repo_url AS stmt_id
      FROM (SELECT repo_url, file_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS seq
            FROM (SELECT *, string_split(regexp_replace(text,
                    '(?i)(create table|alter table|create index|create unique index|insert into|create view)',
                    ';' || chr(10) || '\\1', 'g'), ';') AS parts FROM scripts))
      WHERE regexp_matches(s, '\\S')),
    staged AS (
      SELECT *, CASE WHEN regexp_matches(stmt, '(?i)create (temporary )?table|create view') THEN 'create'
                     WHEN regexp_matches(stmt, '(?i)alter table|create (unique )?index') THEN 'alter'
                     WHEN regexp_matches(stmt, '(?i)insert') THEN 'insert' END AS stage FROM piece),
    cleaned AS (
      SELECT stmt_id, stage, regexp_replace(regexp_replace(
               trim(regexp_replace(regexp_replace(stmt, '{_COMMENT}', '\\1', 'g'), '\\s+', ' ', 'g')),
               '(?i)\\s+comment\\s*=?\\s*''[^'']*''\\s*([,;)]|$)', '\\1', 'g'), '\\(\\s*\\d[\\d\\s,]*\\)', '', 'g') AS stmt
      FROM staged WHERE stage IS NOT NULL),
    block AS (
      SELECT repo_url, file_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS seq
      FROM (SELECT *, string_split(regexp_replace(text, '\\r?\\n([ \\t\\r]*\\n)+', ';', 'g'), ';') AS parts FROM scripts)),
    query_stmt AS (
      SELECT stmt_id, stmt, s FROM (
        SELECT file_id || '#q' || seq || '#' || repo_url AS stmt_id, s,
               trim(regexp_replace(regexp_replace(s, '{_COMMENT}', '\\1', 'g'), '\\s+', ' ', 'g')) AS stmt
        FROM block WHERE contains(lower(s), 'select ') AND contains(lower(s), 'from ')))
    """
    return "WITH " + corpus_sql() + ",\n" + ",\n".join(planted) + "," + derived


_C_KEY = "SELECT stmt_id, table_name, seq::BIGINT AS seq, clause_kind, key_type, cols FROM c_key WHERE "
_C_FK = "SELECT stmt_id, table_name, seq::BIGINT AS seq, cols, ref_table, ref_cols FROM c_fk WHERE clause_kind = "
_A_KEY = ("SELECT stmt_id, clause_seq::BIGINT AS clause_seq, table_ref, adds AS key_type, cols "
          "FROM alter_rows WHERE adds ")
_VER = "repo_url, table_name, stmt_id, n_cols::BIGINT AS n_cols, n_keys::BIGINT AS n_keys"
_ATOM = "SELECT stmt_id, lo::BIGINT AS lo, atom_seq::BIGINT AS atom_seq, "
_DROPPED = """(SELECT v.*, p.stmt_id AS saved_stmt_id, p.n_cols AS saved_n_cols, p.n_keys AS saved_n_keys
               FROM versions v JOIN picked p USING (repo_url, table_name) WHERE v.stmt_id <> p.stmt_id)"""
_VARIANTS = "unnest(['dbo.' || \"T\", '#' || \"T\", '@' || \"T\", 'public.' || \"T\", 'mydb.' || \"TU\", \"T\"])"
_LOOKUP = "coalesce({0}, '') AS {0}"


def _final() -> dict[str, str]:
    f = {}
    f["a1_script_decode"] = "SELECT file_id, text || ' é' AS text FROM scripts"
    f["a2_manifest_files"] = 'SELECT repo_url, "user", repo_name, file_id, raw_url FROM scripts'
    f["a3_repo_grouping"] = 'SELECT repo_url, "user", repo_name, (3 * count(*))::BIGINT AS n_lines FROM files GROUP BY 1, 2, 3'
    f["a4_repo_limit"] = """SELECT repo_url, file_id FROM files WHERE repo_url IN (
        SELECT DISTINCT repo_url FROM files ORDER BY 1 LIMIT 10)"""
    f["a4_first_users"] = """SELECT "user", repo_url, file_id FROM files WHERE "user" IN (
        SELECT DISTINCT "user" FROM files ORDER BY 1 LIMIT 10)"""
    f["a4_repo_sample"] = """SELECT repo_url, file_id FROM files
        WHERE CAST('0x' || substr(md5(repo_url || 's'), 1, 4) AS INTEGER) % 100 < 25"""
    f["a4_repos_with_tables"] = "SELECT repo_url, count(*) AS n_tables FROM final_tables GROUP BY 1 HAVING count(*) >= 3"
    f["a5_log_lines"] = "SELECT value FROM log_in WHERE o_orderkey % 4 < 3"

    f["b1_ddl_statements"] = "SELECT stmt_id, stmt_seq::BIGINT AS stmt_seq, stmt FROM piece"
    f["b2_stage_filter"] = "SELECT stmt_id, stage FROM staged WHERE stage IS NOT NULL"
    f["b3_size_guard"] = """SELECT 'ddl' AS guard, doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE length(text) < 50000
        UNION ALL SELECT 'query', doc_id, length(text)::BIGINT FROM documents WHERE length(text) <= 50000"""
    f["b4_normalize_text"] = "SELECT file_id, text FROM normal"
    f["b5_clean_statements"] = "SELECT stmt_id, stmt FROM cleaned WHERE stmt <> ''"
    f["b6_classify_stmt"] = "SELECT f.file_id || '#d' || p.seq || '#' || f.repo_url AS stmt_id, p.kind FROM files f JOIN p_ddl p USING (tpl)"
    f["b7_query_statements"] = "SELECT stmt_id, stmt FROM query_stmt"
    f["b7_join_statements"] = "SELECT stmt_id, stmt FROM query_stmt JOIN q_all USING (stmt_id) WHERE join_like"
    f["b8_strip_hints"] = "SELECT stmt_id, replace(replace(replace(stmt, '(nolock)', ''), '(+)', ''), '(-)', '') AS stmt FROM query_stmt"
    f["b9_join_like"] = r"""SELECT file_id, (seq - 1)::BIGINT AS block_seq,
            contains(b, 'select') AND contains(b, 'from') AND (contains(b, 'join')
              OR (contains(b, 'where') AND contains(split_part(split_part(b, 'from', 2), 'where', 1), ','))) AS join_like
        FROM (SELECT file_id, lower(unnest(parts)) AS b, generate_subscripts(parts, 1) AS seq
              FROM (SELECT *, string_split(regexp_replace(text, '\r?\n([ \t\r]*\n)+', chr(1), 'g'), chr(1)) AS parts FROM scripts))
        WHERE regexp_matches(b, '\S')"""
    f["b10_clean_identifiers"] = """SELECT p_partkey, 'App.' || p_brand AS ident, 'varchar' AS type_base,
            lower(p_type) AS cast_type, p_name AS "after", p_name AS "before", p_brand AS table_name FROM part"""
    f["b11_to_snake"] = r"""SELECT p_partkey, lower(regexp_replace('part' || (
            SELECT string_agg(upper(substr(w, 1, 1)) || lower(substr(w, 2)), ' ' ORDER BY i) FROM (
              SELECT unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i))
            || 'HTTPCode2X_' || p_brand, '([a-z])([A-Z])', '\1_\2', 'g')) AS snake FROM part"""

    f["c1_table_headers"] = "SELECT stmt_id, table_name FROM created"
    f["c2_clauses"] = "SELECT stmt_id, clause_seq::BIGINT AS clause_seq, clause FROM c_clause"
    f["c3_clause_kinds"] = "SELECT stmt_id, clause_seq::BIGINT AS clause_seq, clause_kind FROM c_clause"
    f["c4_column_defs"] = "SELECT stmt_id, table_name, ord::BIGINT AS ord, col_name, lcol, col_type FROM c_col"
    f["c5_not_null"] = "SELECT stmt_id, col_name, not_null FROM c_col"
    f["c6_inline_pk"] = _C_KEY + "key_type = 'PrimaryKey' AND clause_kind = 'inline_pk'"
    f["c7_table_pk"] = _C_KEY + "key_type = 'PrimaryKey' AND clause_kind <> 'inline_pk'"
    f["c8_constraint_fk"] = _C_FK + "'constraint_fk'"
    f["c9_fk_clause"] = _C_FK + "'foreign_key'"
    f["c10_column_fk"] = _C_FK + "'column_ref'"
    f["c11_inline_pk_fk"] = _C_FK + "'inline_pk'"
    f["c12_unique_keys"] = _C_KEY + "key_type LIKE 'Unique%'"
    f["c13_candidate_keys"] = _C_KEY + "key_type = 'CandidateKey'"
    f["c14_indexes"] = """SELECT stmt_id, table_name, seq::BIGINT AS seq, key_type AS index_type, cols
        FROM c_key WHERE key_type IN ('Index', 'UniqueIndex')"""
    f["c15_ctas_columns"] = "SELECT stmt_id, table_name, lcol, col_name, coalesce(col_type, '') AS col_type FROM ctas_col"
    f["c16_alter_pk"] = _A_KEY + "= 'PrimaryKey'"
    f["c17_alter_fk"] = """SELECT stmt_id, clause_seq::BIGINT AS clause_seq, table_ref, cols, target AS ref_table,
        target_cols AS ref_cols FROM alter_rows WHERE adds = 'fk'"""
    f["c18_alter_unique"] = _A_KEY + "LIKE 'Unique%'"
    f["c19_alter_key"] = _A_KEY + "= 'CandidateKey'"
    f["c20_alter_columns"] = """SELECT repo_url, table_name, lcol, col_name, col_type, file_id,
        stmt_seq::BIGINT AS stmt_seq, ord::BIGINT AS ord FROM alter_col"""
    f["c21_alter_clauses"] = "SELECT stmt_id, clause_seq::BIGINT AS clause_seq, table_ref, clause FROM alter_rows"
    f["c21_later_tables"] = """SELECT repo_url, table_name, file_id, stmt_seq::BIGINT AS stmt_seq FROM alter_new
        UNION ALL SELECT repo_url, table_name, file_id, stmt_seq::BIGINT FROM insert_new"""
    f["c22_create_index"] = "SELECT stmt_id, table_ref, key_type, cols FROM index_rows"
    f["c23_insert_columns"] = """SELECT repo_url, table_name, lcol, col_name, file_id,
        stmt_seq::BIGINT AS stmt_seq, ord::BIGINT AS ord FROM insert_col"""

    f["d1_pick_tables"] = f"SELECT {_VER} FROM picked"
    f["d2_dropped_versions"] = f"""SELECT {_VER}, saved_stmt_id, saved_n_cols::BIGINT AS saved_n_cols,
        saved_n_keys::BIGINT AS saved_n_keys FROM {_DROPPED}"""
    f["d3_lost_columns"] = f"""SELECT d.repo_url, d.table_name, d.stmt_id,
        (SELECT count(*) FROM all_def a WHERE a.stmt_id = d.stmt_id AND a.lcol NOT IN (
           SELECT b.lcol FROM all_def b WHERE b.stmt_id = d.saved_stmt_id))::BIGINT AS n_lost FROM {_DROPPED} d"""
    f["d4_resolve_table"] = """SELECT DISTINCT k.repo_url, k.ref_table AS table_ref, coalesce(t.table_name, '') AS table_name
        FROM c_fk k LEFT JOIN all_tables t ON t.repo_url = k.repo_url AND t.table_name = split_part(k.ref_table, '.', -1)"""
    f["d5_key_validity"] = "SELECT stmt_id, clause_seq::BIGINT AS clause_seq, coalesce(table_name, '') AS table_name, key_type, valid FROM later_checked"
    f["d6_canonical_cols"] = """SELECT k.repo_url, k.table_name, k.stmt_id, k.clause_seq::BIGINT AS clause_seq, k.key_type,
        (SELECT string_agg(c.col_name, ',' ORDER BY x.i) FROM (
           SELECT unnest(string_split(k.cols, ',')) AS w, generate_subscripts(string_split(k.cols, ','), 1) AS i) x
         JOIN all_col c ON c.repo_url = k.repo_url AND c.table_name = k.table_name AND c.lcol = lower(x.w)) AS cols
        FROM all_key k"""
    f["d7_foreign_keys"] = "SELECT * FROM fk_resolved"
    f["d7_fk_unresolved"] = "SELECT repo_url, table_ref, cols, ref_table, ref_cols FROM fk_done WHERE NOT resolved"
    f["d8_final_tables"] = "SELECT repo_url, table_name, file_id, stmt_seq::BIGINT AS stmt_seq FROM final_tables"
    f["d9_base_types"] = """SELECT coalesce(base_type, '') AS base_type, count(*) AS n
        FROM all_col LEFT JOIN p_type USING (col_type) GROUP BY 1"""
    f["d10_name_variants"] = f"""SELECT DISTINCT r.repo_url, r.table_ref, coalesce(t.table_name, '') AS table_name
        FROM (SELECT repo_url, {_VARIANTS} AS table_ref FROM files) r
        LEFT JOIN all_tables t ON t.repo_url = r.repo_url
          AND t.table_name = lower(ltrim(split_part(r.table_ref, '.', -1), '#@'))"""
    f["d11_resolve_column"] = """SELECT DISTINCT r.repo_url, r.table_ref, n.lcol, coalesce(t.table_name, '') AS table_name,
          coalesce(c.col_name, '') AS col_name
        FROM (SELECT repo_url, unnest(["TU", "V"]) AS table_ref FROM files) r
        CROSS JOIN (VALUES ('username'), ('id'), ('memo'), ('extra'), ('absent')) n(lcol)
        LEFT JOIN all_tables t ON t.repo_url = r.repo_url AND t.table_name = lower(r.table_ref)
        LEFT JOIN all_col c ON c.repo_url = r.repo_url AND c.table_name = t.table_name AND c.lcol = n.lcol"""
    f["d12_nearest_names"] = """SELECT repo_url, table_ref, table_name, distance::BIGINT AS distance, rank::BIGINT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY repo_url, table_ref ORDER BY distance, table_name) AS rank FROM (
            SELECT m.repo_url, m.table_ref, t.table_name, levenshtein(lower(m.table_ref), lower(t.table_name)) AS distance
            FROM (SELECT DISTINCT repo_url, name AS table_ref FROM fail WHERE reason = 'table' AND name IS NOT NULL) m
            JOIN final_tables t USING (repo_url))) WHERE rank <= 3"""
    f["d13_first_owner"] = """SELECT repo_url, lcol, table_name, col_name, file_id, stmt_seq::BIGINT AS stmt_seq FROM owner"""

    f["e1_scopes"] = """SELECT stmt_id, lo::BIGINT AS lo, hi::BIGINT AS hi, parent_lo::BIGINT AS parent_lo,
        depth::BIGINT AS depth, own_text FROM q_scope"""
    f["e2_scope_tables"] = """SELECT stmt_id, lo::BIGINT AS lo, pos::BIGINT AS t_pos,
        coalesce(alias, lower(table_ref)) AS alias, coalesce(table_ref, '') AS table_ref, child::BIGINT AS child FROM q_tab"""
    f["e3_join_type"] = "SELECT stmt_id, lo::BIGINT AS lo, join_type FROM q_scope"
    f["e4_comparisons"] = _ATOM + "atom FROM q_atom"
    f["e5_join_candidates"] = _ATOM + "atom FROM q_atom WHERE l_ref IS NOT NULL"
    f["e6_operator_names"] = _ATOM + "op AS op_name FROM q_atom WHERE op IS NOT NULL"
    f["e7_side_resolution"] = _ATOM + "side, lower(table_ref) AS table_ref, lcol FROM side_cand"
    f["e8_limit_conditions"] = _ATOM + "atom FROM q_atom WHERE l_ref IS NOT NULL AND listed"
    f["e9_derived_joins"] = _ATOM + "op, l_table, l_col, r_table, r_col FROM cond WHERE reason IS NULL AND derived"
    f["e10_binary_joins"] = """SELECT j.stmt_id, j.lo::BIGINT AS lo, j.l_table, j.r_table, s.join_type, j.conditions
        FROM joins j JOIN q_scope s USING (stmt_id, lo)"""
    f["e11_failures"] = """SELECT stmt_id, lo::BIGINT AS lo, condition, side, reason, coalesce(name, '') AS name FROM fail"""
    f["e11_unfound_tables"] = """SELECT DISTINCT repo_url, name AS table_ref FROM fail
        WHERE reason = 'table' AND name IS NOT NULL"""
    for key, kind in (("e12_projections", "projection"), ("e13_selections", "selection"), ("e15_groupbys", "groupby")):
        f[key] = f"SELECT stmt_id, table_name, col_name FROM refs WHERE kind = '{kind}'"
    f["e14_aggregates"] = "SELECT stmt_id, func, table_name, col_name FROM refs WHERE kind = 'aggregate'"
    f["e16_queries"] = "SELECT * EXCLUDE (repo_url) FROM queries"
    f["e17_union_flag"] = "SELECT stmt_id, is_union FROM q_all"
    f["e18_inner_selects"] = """SELECT f.file_id || '#q' || p.q || '#' || f.repo_url AS stmt_id, p.lo::BIGINT AS lo,
        p.expr, p.out AS "out", p.func FROM files f JOIN p_item p USING (tpl)"""

    key_count = "SELECT '{}', count(*) FROM all_key WHERE {}"
    flag_count = "SELECT 'queries_with_{0}', count(*) FROM queries WHERE has_{0}"
    f["f1_corpus_stats"] = " UNION ALL ".join([
        """SELECT 'nonempty_repos' AS metric, count(*)::BIGINT AS value
           FROM (SELECT repo_url FROM final_tables UNION SELECT repo_url FROM queries)""",
        "SELECT 'tables', count(*) FROM all_tables", "SELECT 'nonempty_tables', count(*) FROM final_tables",
        "SELECT 'columns', count(*) FROM all_col", "SELECT 'typed_columns', count(col_type) FROM all_col",
        key_count.format("primary_keys", "key_type = 'PrimaryKey'"),
        key_count.format("candidate_keys", "key_type = 'CandidateKey'"),
        key_count.format("unique_constraints", "key_type LIKE 'Unique%'"),
        key_count.format("indexes", "key_type IN ('Index', 'UniqueIndex')"),
        "SELECT 'foreign_keys', count(*) FROM fk_resolved", "SELECT 'queries', count(*) FROM queries",
        "SELECT 'binary_joins', sum(n_joins)::BIGINT FROM queries",
        "SELECT 'conditions', sum(n_conditions)::BIGINT FROM queries",
        *[flag_count.format(k) for k in ("projection", "aggregate", "selection", "groupby")]])
    f["f2_type_frequency"] = "SELECT coalesce(col_type, 'None') AS col_type, count(*) AS n FROM all_col GROUP BY 1"
    f["f3_missing_in_user"] = """SELECT total, found, found / total AS share FROM (
        SELECT count(*) AS total, count(*) FILTER (EXISTS (
            SELECT 1 FROM final_tables t JOIN (SELECT DISTINCT repo_url, "user" FROM files) u USING (repo_url)
            WHERE u."user" = x."user" AND lower(t.table_name) = lower(x.name)) AND NOT EXISTS (
            SELECT 1 FROM final_tables t WHERE t.repo_url = x.repo_url AND lower(t.table_name) = lower(x.name))) AS found
        FROM (SELECT f.*, u."user" FROM fail f JOIN (SELECT DISTINCT repo_url, "user" FROM files) u USING (repo_url)
              WHERE reason = 'table' AND name IS NOT NULL) x)"""
    f["f4_failure_counts"] = """SELECT count(*) AS total, count(*) FILTER (reason = 'table') AS table_failed,
        count(*) FILTER (reason = 'column') AS column_failed FROM fail"""
    f["f5_failure_sample"] = """SELECT repo_url, stmt_id, lo::BIGINT AS lo, condition, reason FROM (
          SELECT * FROM (SELECT *, md5(repo_url || '|s') AS o FROM fail QUALIFY row_number() OVER (
              PARTITION BY repo_url ORDER BY md5(stmt_id || '|' || lo || '|' || condition || '|s'), stmt_id, lo, condition) = 1)
          ORDER BY o, repo_url LIMIT 60)
        QUALIFY row_number() OVER (PARTITION BY reason ORDER BY o, repo_url) <= 25"""
    f["f6_table_sample"] = """SELECT repo_url, table_name, file_id FROM final_tables WHERE repo_url IN (
            SELECT repo_url FROM final_tables GROUP BY 1 HAVING count(*) >= 3 ORDER BY md5(repo_url || '|s'), repo_url LIMIT 20)
        QUALIFY row_number() OVER (PARTITION BY repo_url
            ORDER BY md5(repo_url || '|' || table_name || '|s'), table_name) = 1"""
    f["f7_fk_join_overlap"] = """SELECT fk_pairs, join_pairs, "both", "both" / fk_pairs AS share_of_fk,
          "both" / join_pairs AS share_of_join FROM (
        SELECT count(*) FILTER (k) AS fk_pairs, count(*) FILTER (j) AS join_pairs, count(*) FILTER (k AND j) AS "both" FROM (
          SELECT repo_url, least(a, b), greatest(a, b), bool_or(k) AS k, bool_or(NOT k) AS j FROM (
            SELECT repo_url, lower(table_name || '.' || unnest(string_split(cols, ','))) AS a,
                   lower(ref_name || '.' || unnest(string_split(ref_cols, ','))) AS b, true AS k FROM fk_resolved
            UNION ALL
            SELECT repo_url, lower(l_table || '.' || lc), lower(r_table || '.' || rc), false FROM pair WHERE op = 'Eq')
          GROUP BY 1, 2, 3))"""
    f["f8_dup_clusters"] = "SELECT cluster_key, count(*) AS n FROM signature GROUP BY 1"
    f["f8_keep_first"] = """SELECT repo_url, table_name, file_id, cluster_key FROM signature QUALIFY row_number() OVER (
        PARTITION BY cluster_key ORDER BY repo_url, file_id, table_name) = 1"""
    f["f9_filter_tables"] = "SELECT * FROM kept"
    f["f10_training_stats"] = " UNION ALL ".join([
        "SELECT 'input_tables' AS metric, count(*)::BIGINT AS value FROM all_tables",
        "SELECT 'skipped_no_constraint', count(*) FROM constraints WHERE n_none = n_cols",
        "SELECT 'skipped_high_notnull', count(*) FROM constraints WHERE n_none < n_cols AND notnull_share > 0.5",
        "SELECT 'duplicate_tables', (SELECT count(*) FROM kept) - (SELECT count(*) FROM kept_first)",
        "SELECT 'output_tables', count(*) FROM kept_first",
        "SELECT 'unique_columns', sum(n_unique)::BIGINT FROM kept_first",
        "SELECT 'notnull_columns', sum(n_notnull)::BIGINT FROM kept_first",
        "SELECT 'none_columns', sum(n_none)::BIGINT FROM kept_first"])
    f["f11_log_coverage"] = """SELECT value, o_custkey AS succ, o_orderkey AS failed,
        o_custkey / (o_custkey + o_orderkey) AS coverage FROM log_in WHERE o_orderkey % 4 = 2 AND o_custkey + o_orderkey > 0"""
    f["f11_log_totals"] = """SELECT total, succ, failed, repos, succ / total AS coverage FROM (
        SELECT sum(o_orderkey) FILTER (o_orderkey % 4 = 0)::BIGINT AS total, sum(o_custkey) FILTER (o_orderkey % 4 = 0)::BIGINT AS succ,
               count(*) FILTER (o_orderkey % 4 = 0) AS failed, count(*) FILTER (o_orderkey % 4 = 1) AS repos FROM log_in)"""
    f["f12_extraction_counts"] = """SELECT kind, 'ok' AS status, count(*) AS n FROM files JOIN p_ddl USING (tpl) GROUP BY 1
        UNION ALL SELECT 'query', CASE WHEN q.stmt_id IS NULL THEN 'failed' ELSE 'ok' END, count(*)
        FROM q_all LEFT JOIN queries q USING (stmt_id) GROUP BY 2"""

    f["g1_label_rows"] = 'SELECT repo_url, file, "table", "column", label FROM label'
    f["g2_training_csv"] = 'SELECT file, "table", "column", label FROM label'
    f["g3_reloaded_stats"] = f["f1_corpus_stats"]
    f["g3_catalog_folder"] = """SELECT repo_url, table_name, col_name, coalesce(col_type, '') AS col_type, origin FROM all_col"""
    f["g4_table_view"] = """SELECT t.repo_url, t.table_name,
          (SELECT string_agg(concat_ws(' ', col_name, coalesce(col_type, ''), not_null::VARCHAR), ';' ORDER BY concat_ws(' ', col_name, coalesce(col_type, ''), not_null::VARCHAR))
           FROM all_col c WHERE c.repo_url = t.repo_url AND c.table_name = t.table_name) AS cols,
          coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT key_type || '(' || cols || ')' AS x FROM all_key k
           WHERE k.repo_url = t.repo_url AND k.table_name = t.table_name)), '') AS keys,
          coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT cols || '>' || ref_name || '(' || ref_cols || ')' AS x FROM fk_resolved k
           WHERE k.repo_url = t.repo_url AND k.table_name = t.table_name)), '') AS fks
        FROM final_tables t"""
    f["g4_query_view"] = """SELECT q.stmt_id,
          coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT concat_ws(' ', j.lo::VARCHAR, l_table, join_type, r_table, '[' || conditions || ']') AS x
           FROM joins j JOIN q_scope s USING (stmt_id, lo) WHERE j.stmt_id = q.stmt_id)), '') AS joins,
          coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT concat_ws(' ', kind, func, table_name || '.' || col_name) AS x
           FROM refs r WHERE r.stmt_id = q.stmt_id)), '') AS refs FROM queries q"""
    return f


def all_sql() -> dict[str, str]:
    base = _base()
    return {name: f"{base}\n{body}" for name, body in _final().items()}
