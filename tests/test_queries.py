"""Query facts. One catalog, one repository per case, expected rows written by hand."""

import pytest
from pyspark.sql import functions as F

from scriptlode.operators import analytics as A, query_facts as QF, scopes as Q, statements as S

from .conftest import facts_of, listed, make_scripts

DDL = """create table crew (Rank_Name varchar(9), pay int);
create table cargo (portNo int, shipNo int, hold text, crates int);
create table port (id int, town text); create table ship (id int, draftCm int);
create table reels (reel int, take text); create table labels (ink text);
create table kiln (batchNo int, glaze text, heat int, hours int); create table potters (batchNo int, mark text);
create table tank (fish int, row_no int, depth int, salt int);
create table feed (row_no int, depth int, salt int, grams int);
create table a1 (k int, v int); create table b1 (k int, w int); create table c1 (k int, v int);
"""

# name: (query, joins, {kind: facts}, failures)
CASES = {
    "having": ("select rank_name, count(pay) from crew group by rank_name having count(pay) > 3", [],
               {"projection": "crew.Rank_Name crew.pay", "aggregate": "count crew.pay", "groupby": "crew.Rank_Name"}, []),
    "left_and_cross": ("""select f.grams, t.fish, crew.pay from tank t left join feed f on f.depth = t.depth and f.salt > t.salt
        cross join crew where crew.Rank_Name <> 'mate' and t.row_no between 2 and 5""",
        ["feed left tank: depth Eq depth; salt Gt salt"], {"projection": "feed.grams tank.fish crew.pay"}, []),
    "natural": ("select reel from reels natural join labels where ink = 'red' and take = 'b'", [],
                {"projection": "reels.reel", "selection": "labels.ink reels.take"}, []),
    "three_by_commas": ("select port.town from ship, port, cargo c where c.portNo = port.id and c.shipNo = ship.id and ship.draftCm < c.crates and town = 'ulm'",
                        ["cargo inner port: portNo Eq id", "cargo inner ship: crates Gt draftCm; shipNo Eq id"],
                        {"projection": "port.town", "selection": "port.town"}, []),
    "aggregates": ("select depth, min(grams) as low, avg(salt) from feed where row_no = 2 group by depth", [],
                   {"projection": "feed.depth feed.grams feed.salt", "aggregate": "min feed.grams|avg feed.salt",
                    "selection": "feed.row_no", "groupby": "feed.depth"}, []),
    "star_of_one": ("select b.*, v from a1 join b1 b on b.k = a1.k", ["a1 inner b1: k Eq k"], {"projection": "b1.k b1.w a1.v"}, []),
    "renamed_below": ("""select m.total from (select n.k, n.total from (select k, sum(w) total from b1 where w > 4 group by k) n
        join c1 on c1.k = n.k where c1.v = 2) m, a1 where a1.v >= m.total""",
        ["b1 inner c1: k Eq k", "a1 inner b1: v GtEq w"],
        {"projection": "b1.w b1.k", "aggregate": "sum b1.w", "groupby": "b1.k", "selection": "b1.w c1.v"}, []),
    "renamed_twice": ("select o.c from (select i.b as c from (select a.k as b from a1 a) i) o join c1 on c1.v = o.c",
                      ["a1 inner c1: k Eq v"], {"projection": "a1.k"}, []),
    "with": ("""with w as (select k as wid, v from a1), u as (select max(wid) top from w) select b1.w, u.top from b1
             join w on b1.k = w.wid join u on u.top > b1.w""", ["a1 inner b1: k Eq k; k Gt w"],
             {"projection": "b1.w a1.k a1.v", "aggregate": "max a1.k"}, []),
    "with_columns": ("with w (a, b) as (select k, v from c1) select w.b from w where w.a = 5", [],
                     {"projection": "c1.k c1.v", "selection": "c1.k"}, []),
    "with_recursive": ("with recursive r as (select k, w from b1 union all select a1.k, r.w from a1 join r on a1.v = r.k) select r.w from r",
                       ["a1 inner b1: v Eq k"], {"projection": "b1.k b1.w a1.k"}, []),
    "with_hides_a_table": ("select x.k from a1 x join (with c1 as (select w as k from b1) select k from c1) y on y.k = x.v",
                           ["a1 inner b1: v Eq w"], {"projection": "a1.k b1.w"}, []),
    "with_seen_below": ("""with w as (select k as id from c1) select v from a1 where exists (select 1 from w where w.id = a1.k)
                        union select w from b1 join w on w.id = b1.k""",
                        ["a1 inner c1: k Eq k", "b1 inner c1: k Eq k"], {"projection": "c1.k a1.v b1.w"}, []),
    "before_its_with": ("select 1 from a1 x join w on w.k = x.k union select 2 from (with w as (select k from b1) select k from w) z",
                        [], {"projection": "b1.k"}, ["left table w"]),
    "deep_from": ("select extract(year from f(g(h(i(x.v))))), y.w from a1 x join b1 y on x.k = y.k", ["a1 inner b1: k Eq k"],
                  {"projection": "b1.w"}, []),
    "where_in_parentheses": ("select count(*) filter (where x.v = 1) n, x.k from a1 x join b1 y on x.k = y.k where y.w = 2",
                             ["a1 inner b1: k Eq k"], {"projection": "a1.k", "selection": "b1.w"}, []),
    "value_words": ("select x.v from a1 x join b1 y on x.k = y.k and x.v <= current_date", ["a1 inner b1: k Eq k"],
                    {"projection": "a1.v"}, []),
    "correlated": ("select x.v from a1 x where exists (select 1 from b1 where b1.k >= x.k and x.nope = b1.w)",
                   ["a1 inner b1: k LtEq k"], {"projection": "a1.v"}, ["left column nope"]),
    "inner_alias_wins": ("select x.v from a1 x where x.k in (select x.k from c1 x join b1 y on x.k < y.k)",
                         ["b1 inner c1: k Gt k"], {"projection": "a1.v c1.k"}, []),
    "union_arms": ("select k from a1 x where x.k = 1 union all select w from b1 x where x.w = 2 and x.v = 3", [],
                   {"projection": "a1.k b1.w", "selection": "a1.k b1.w"}, []),
    "failures": ("select 1 from a1 x join gone g on x.k = g.k and x.zzz = x.k and x.v = q.v and nothing = x.k", [], {},
                 ["right table gone", "left column zzz", "right table q", "left table None"]),
    "dropped_atoms": ("""select 1 from a1 x, b1 y where x.k != y.k and x.k <> y.w and x.k = 5 and x.k = y.k + 1 and x.k = :p and x.k = ?
                      and x.k = true and x.v = f(y.k) and x.v in (1, 2) and x.k = @v and x."v" = y."w" and x.k::int = y.k""",
                      ["a1 inner b1: k Eq k; v Eq w"], {"selection": "a1.k"}, []),
    "from_in_functions": ("""select distinct extract(year from x.v), trim(both 'a' from x.k), x.k, y.w from a1 x
                          join b1 y on x.k = y.k""", ["a1 inner b1: k Eq k"], {"projection": "a1.k b1.w"}, []),
    "row_locks": ("select x.v from a1 x join b1 y on x.k = y.k where y.w = 3 for update",
                  ["a1 inner b1: k Eq k"], {"projection": "a1.v", "selection": "b1.w"}, []),
    "pages_of_rows": ("select x.v from a1 x join b1 y on x.k = y.k and x.v = y.w offset 5 rows fetch next 9 rows only",
                      ["a1 inner b1: k Eq k; v Eq w"], {"projection": "a1.v"}, []),
    "bare_sides": ("select 1 from b1, c1 where w = v and reel = c1.k", ["b1 inner c1: w Eq v", "c1 inner reels: k Eq reel"], {}, []),
    "bracketed_join": ("select [x].[v] from ([a1] as x left outer join `b1` as y on ((x.k = y.k))) order by 1",
                       ["a1 left b1: k Eq k"], {"projection": "a1.v"}, []),
    "right_majority": ("select 1 from a1 right join b1 on a1.k = b1.k right outer join c1 on c1.k = b1.k left join feed on feed.grams = a1.v",
                       ["a1 right b1: k Eq k", "a1 right feed: v Eq grams", "b1 right c1: k Eq k"], {}, []),
    "derived_alias": ("select d.total, d.k from (select k, sum(v) as total from a1 group by k) d join b1 on d.total > b1.w",
                      ["a1 inner b1: v Gt w"],
                      {"projection": "a1.k a1.v", "aggregate": "sum a1.v", "groupby": "a1.k"}, []),
    "insert_select": ("insert into b1 (k) select v from a1 where k = 1 limit 5", [],
                      {"projection": "a1.v", "selection": "a1.k"}, []),
    "group_by_alias": ("select v as val, count(*) from a1 group by val order by 2", [],
                       {"projection": "a1.v", "groupby": "a1.v"}, []),
}


@pytest.fixture(scope="module")
def built(spark):
    q = facts_of(spark, [(f"https://example.org/u/{n}", f, t) for n, case in CASES.items()
                         for f, t in (("ddl.sql", DDL), ("q.sql", case[0]))])
    take = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {"joins": take(q.binary_joins), "refs": take(q.refs), "failures": take(q.failures),
            "queries": take(q.queries), "facts": q}


@pytest.mark.parametrize("name", CASES)
def test_case(built, name):
    _, joins, facts, failures = CASES[name]
    mine = {k: [r for r in built[k] if r["repo_url"].endswith("/" + name)] for k in ("joins", "refs", "failures", "queries")}
    got = [f"{r['l_table']} {r['join_type']} {r['r_table']}: " + "; ".join(
        f"{c['l']} {c['op']} {c['r']}" for c in sorted(r["conditions"], key=str)) for r in mine["joins"]]
    assert sorted(got) == sorted(joins)
    by_kind = {}
    for r in mine["refs"]:
        fact = f"{r['table_name']}.{r['col_name']}"
        by_kind.setdefault(r["kind"], set()).add(f"{r['func']} {fact}" if r["func"] else fact)
    want = {k: set(v.split("|") if k == "aggregate" else v.split(" ")) for k, v in facts.items()}
    assert by_kind == want
    assert sorted(f"{r['side']} {r['reason']} {r['name']}" for r in mine["failures"]) == sorted(failures)
    if joins or facts:
        assert len(mine["queries"]) == 1 and mine["queries"][0]["n_joins"] == len(joins)


def test_joined_and_failed_are_all_candidates(built):
    q = built["facts"]
    assert (q.conditions.filter("reason is null").count() + q.failures.count()
            == QF.limit_conditions(q.parts).count())


def test_failure_reports(built, spark):
    q = built["facts"]
    counts = A.failure_counts(q.failures).first()
    assert counts["total"] == counts["table_failed"] + counts["column_failed"] == q.failures.count()
    sample = A.failure_sample(q.failures, 1, 1)
    assert sample.count() == 1
    tables = spark.createDataFrame([("https://example.org/u/else", "GONE")], "repo_url string, table_name string")
    assert tuple(A.missing_in_user(q.failures, tables).first()) == (3, 1, 1 / 3)


def brute_scopes(sql):
    """(lo order, parent order) of selects by a plain scan of parentheses."""
    import re
    toks = re.findall(r"[()]|[^()]+", sql)
    stack, out = [], []
    for i, t in enumerate(toks):
        if t == "(":
            is_sel = i + 1 < len(toks) and toks[i + 1].strip().startswith("select")
            stack.append(len(out) if is_sel else None)
            if is_sel:
                parents = [s for s in stack[:-1] if s is not None]
                out.append((i, parents[-1] if parents else -1))
        elif t == ")":
            if stack:
                stack.pop()
        elif i == 0 and "select" in t:
            stack.append(0)
            out.append((0, -1))
    return [(lo, out[p][0] if p >= 0 else -1) for lo, p in out]


def test_deep_nesting_against_brute_force(spark):
    import random
    rng = random.Random(3)

    def query(depth):
        parts = []
        for _ in range(rng.randint(1, 3)):
            roll = rng.random()
            if depth < 6 and roll < 0.5:
                parts.append(f"c{depth} in ({query(depth + 1)})")
            elif roll < 0.7:
                parts.append(f"(f(g(c{depth})) > (1 + 2) or c = 2)")
            else:
                parts.append(f"x{depth} = y")
        return f"select a{depth} from t{depth} where " + " and ".join(parts)

    texts = [query(0) for _ in range(60)]
    deep = "select a from t where b in (" * 40 + "select z from q" + ")" * 40
    rows = spark.createDataFrame([("r", "f", str(i), t) for i, t in enumerate([*texts, deep])],
                                 "repo_url string, file_id string, stmt_id string, stmt string")
    got = {}
    for r in Q.scopes(rows).collect():
        got.setdefault(int(r["stmt_id"]), []).append((r["lo"], -1 if r["parent_lo"] is None else r["parent_lo"]))
    for i, t in enumerate([*texts, deep]):
        assert sorted(got[i]) == sorted(brute_scopes(t)), t


def test_scopes_of_mixed_text(spark):
    text = "with w as (select a from t where b = '(select') select x from w where y = (select max(z) from u) -- (select q"
    rows = Q.scopes(S.query_statements(make_scripts(spark, {"f": text})))
    assert listed(rows, "depth", "own_text") == [
        (0, "with w as (#1) select x from w where y = (#5)"), (1, "select a from t where b = ''"),
        (1, "select max(z) from u")]


def test_union_flag(spark):
    rows = spark.createDataFrame([("select a from t UNION select b from u",), ("select reunion from t",)], "stmt string")
    assert [r["is_union"] for r in Q.is_union(rows).collect()] == [True, False]


def test_join_type_ties(spark):
    rows = spark.createDataFrame([("a join b",), ("a cross join b left join c",), ("a full outer join b",), ("a, b",)],
                                 "own_text string")
    assert [r["join_type"] for r in Q.scope_join_type(rows).collect()] == ["inner", "left", "full", "inner"]


def test_fk_overlap(spark):
    fks = spark.createDataFrame([("r", "c", ["pid", "x"], "p", ["id", "y"])],
                                "repo_url string, table_name string, cols array<string>, ref_name string, ref_cols array<string>")
    joins = spark.createDataFrame([("r", "P", "c", [("ID", "Eq", "pid"), ("a", "Lt", "b"), ("n", "Eq", "m")])],
                                  "repo_url string, l_table string, r_table string, conditions array<struct<l:string,op:string,r:string>>")
    assert tuple(A.fk_join_overlap(fks, joins).first()) == (2, 2, 1, 0.5, 0.5)


def test_query_view_and_kinds(built):
    q = built["facts"]
    kinds = [QF.projections(q.refs), QF.selections(q.refs), QF.aggregates(q.refs), QF.groupbys(q.refs)]
    assert sum(k.count() for k in kinds) == q.refs.count()
    assert q.refs.filter(F.col("col_name").isNull()).count() == 0


def test_script_text_in_the_form_of_a_placeholder(spark):
    q = facts_of(spark, {"ddl.sql": DDL, "q.sql": """select x.v from a1 x join (#1) y on x.k = y.k
        where x.v = (select max(w) from b1 where b1.w = 4)""", "r.sql": "select x.v from (a1) x, (b1) as y where x.k = y.k\u0001"})
    assert listed(q.failures, "reason", "name") == [("table", "#1")]
    assert listed(q.binary_joins, "l_table", "r_table") == [("a1", "b1")]


def test_intervals_against_brute_force(spark):
    import random
    from scriptlode.operators.intervals import within
    rng = random.Random(4)
    points = [(rng.randint(0, 2), rng.choice([0, 1, rng.randint(0, 70), 2 ** 31 - 2])) for _ in range(150)]
    spans = [(rng.randint(0, 2), a, rng.choice([a - 1, a, a + rng.randint(0, 40), 2 ** 31 - 1])) for a in
             (rng.choice([0, 1, rng.randint(0, 70)]) for _ in range(150))]
    got = within(spark.createDataFrame(points, "g int, x int"), spark.createDataFrame(spans, "g int, lo int, hi int"), ["g"], "x", "lo", "hi")
    want = [(g, x, lo, hi) for g, x in points for h, lo, hi in spans if g == h and lo <= x <= hi]
    assert sorted(tuple(r) for r in got.select("g", "x", "lo", "hi").collect()) == sorted(want)
