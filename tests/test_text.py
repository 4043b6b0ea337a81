import random
import time

from pyspark.sql import functions as F

from scriptlode.functions import text as X


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "s string").select(fn(F.col("s"))).first()[0]


def test_comments(spark):
    text = "a -- x 'y\n b /* c\n * d */ e # gone\nf #temp 'keep -- this' g"
    assert one(spark, text, X.normalize_text) == "a b e f #temp 'keep -- this' g"


def test_long_comment_needs_no_stack(spark):
    text = "a /*" + "x * y " * 20000 + "*/ b"
    assert one(spark, text, X.normalize_text) == "a b"


def test_clean_stmt(spark):
    text = "a int(11) comment 'x, (y)', b decimal( 10 , 2 ) COMMENT = 'z')"
    assert one(spark, text, X.clean_stmt) == "a int, b decimal)"


def test_hints(spark):
    assert one(spark, "t (NOLOCK) x(+) y (-) f(a)", X.strip_hints) == "t  x y  f(a)"


def test_identifiers(spark):
    assert one(spark, '"App" . `Tab`  DESC', X.clean_ident) == "App.Tab"
    assert one(spark, "[a b] nulls last", X.clean_ident) == "a b"
    assert one(spark, "[VarChar](max", X.norm_type) == "varchar"
    assert one(spark, "'x'::Text", X.norm_type) == "text"
    assert one(spark, "dbo.[#temp]", X.clean_table) == "temp"
    assert one(spark, "a VALUES b", lambda c: X.before_kw(c, " values")) == "a"
    assert one(spark, "x AS y as z", lambda c: X.after_kw(c, " as ")) == "y as z"
    assert one(spark, "no keyword", lambda c: X.after_kw(c, " as ")) == "no keyword"


def test_snake(spark):
    assert one(spark, "failureCount", X.to_snake) == "failure_count"
    assert one(spark, "HTTPServer2X", X.to_snake) == "httpserver2x"


def py_split(s):
    out, cur, depth = [], "", 0
    for ch in s:
        if ch == "," and depth <= 0:
            out, cur = out + [cur], ""
            continue
        depth += {"(": 1, ")": -1}.get(ch, 0)
        cur += ch
    return [x.strip(" ") for x in out + [cur] if x.strip(" ")]


def py_group(s):
    """Content of the first group; an unclosed one runs to the end."""
    if "(" not in s:
        return None
    depth, out = 1, ""
    for ch in s[s.index("(") + 1:]:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth == 0:
            break
        out += ch
    return out


def py_outer(s):
    depth, out = 0, ""
    for ch in s:
        if ch in "()":
            depth += 1 if ch == "(" else -1
        elif depth <= 0:
            out += ch
    return out


def test_nesting_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab ,()(),") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["f(" * 9 + "a,b" + ")" * 9 + ",c", "((((,a),b),c),d),e", "(" * 50, ")" * 5 + "a,(b,c)"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", X.split_top(F.col("s")), X.first_group(F.col("s")), X.outer_text(F.col("s"))).collect()
    for s, items, group, outer in rows:
        assert items == py_split(s), s
        assert group == py_group(s), s
        assert outer == py_outer(s), s


def py_hold(s):
    """Outermost groups by a stack; parentheses without a counterpart are plain characters."""
    stack, pair = [], {}
    for i, ch in enumerate(s):
        if ch == "(":
            stack.append(i)
        elif ch == ")" and stack:
            pair[stack.pop()] = i
    out, groups, i = "", [], 0
    while i < len(s):
        if i in pair:
            out += f"(\u0003{len(groups)}\u0003)"
            groups.append(s[i + 1:pair[i]])
            i = pair[i]
        else:
            out += s[i]
        i += 1
    return out, groups


def test_held_groups_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab ,()()") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["f(" * 9 + "a,b" + ")" * 9 + ",(c)", "(" * 50, ")" * 5 + "(b)(", "((a)", "(a))(b", "x" * 10]
    held = X.hold_groups(F.col("s"))
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", held.alias("h")).select(
        "s", "h.text", "h.groups", X.with_groups(F.col("h.text"), F.col("h.groups"))).collect()
    for s, text, groups, back in rows:
        assert (text, groups) == py_hold(s), s
        assert back == s


def test_running(spark):
    rng = random.Random(9)
    lists = [[rng.randint(-3, 3) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 1000)]
    rows = spark.createDataFrame([(v,) for v in lists], "v array<int>").select(
        "v", X.running(F.col("v")), X.running(F.col("v"), F.least)).collect()
    for v, total, least in rows:
        assert total == [sum(v[:i + 1]) for i in range(len(v))]
        assert least == [min(v[:i + 1]) for i in range(len(v))]


def test_a_megabyte_four_levels_deep(spark):
    """Long bodies cost about their length: every helper on 1 MB of nested clauses, each well under its share of five seconds."""
    clause = "c{0} int check ((c{0} > (f(a, (c{0} + (1)))))), "
    body = "".join(clause.format(i) for i in range(20_000))[:-2]
    assert len(body) > 1_000_000
    df = spark.createDataFrame([("create table t (" + body + ") x",)], "s string")
    group = X.first_group(F.col("s"))
    df.select(F.size(X.split_top(group))).first()  # compiled once
    for expr, want in ((F.size(X.split_top(group)), 20_000), (F.length(group), len(body)), (X.outer_text(F.col("s")), "create table t  x"),
                       (F.size(X.hold_groups(group)["groups"]), 20_000)):
        start = time.monotonic()
        assert df.select(expr).first()[0] == want
        assert time.monotonic() - start < 5
