"""Script corpus derived from the part and supplier tables by string concatenation.

One repository per supplier, one script file per part; p_size modulo 10 picks the template. The
same templates are rendered for Spark and for DuckDB, so both engines see the same texts.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# {T}, {U}: table names that exist in most repositories; {V} may be missing; {TU} is {T} in
# capitals; {k} is the name number.
TEMPLATES = {
    0: """-- table {T}
CREATE TABLE IF NOT EXISTS `{T}` (
  `id` int(11) NOT NULL PRIMARY KEY COMMENT 'row id',
  `userName` varchar(40) NOT NULL,
  `price` decimal(10,2) DEFAULT NULL,
  `status` char(1) default 'v',
  `note` text /* free, text */
) ENGINE=InnoDB;
""",
    1: """create table {T} (
  id integer primary key,
  userName varchar(64) not null,
  price float,
  status char(2),
  note text,
  created_at timestamp not null,
  constraint uq_user unique (userName, status)
);
""",
    2: """CREATE TABLE {T} (
  id int NOT NULL,
  code varchar(16) NOT NULL COMMENT 'a b',
  userName varchar(40),
  kind int CHECK ((kind > (0))),
  depth int CHECK ((kind + (id * (id + (kind + (id))))) > coalesce(kind, id)),
  PRIMARY KEY (id, code),
  UNIQUE KEY uk_code (code ASC),
  KEY ix_user (userName),
  KEY ix_bad (nope),
  INDEX ix_kind (kind),
  UNIQUE INDEX ux_kind (kind, id DESC),
  UNIQUE (kind, code)
);
""",
    3: """CREATE TABLE "{T}" (
  "id" bigint PRIMARY KEY REFERENCES "{V}" ("id") ON DELETE CASCADE,
  "ref_id" int NOT NULL REFERENCES {V}(id),
  "code" varchar(16) UNIQUE,
  "kind" int,
  CONSTRAINT fk_kind FOREIGN KEY (kind) REFERENCES {U} (kind),
  FOREIGN KEY (code) REFERENCES public.{U} ON DELETE CASCADE
);
""",
    4: """ALTER TABLE ONLY {T}
  ADD PRIMARY KEY (id),
  ADD CONSTRAINT fk_u FOREIGN KEY (id, kind) REFERENCES {U} (id, kind),
  ADD UNIQUE KEY uk_n (userName),
  ADD COLUMN extra varchar(8),
  ADD KEY kx (price),
  ADD CONSTRAINT pk_p PRIMARY KEY (id, price),
  ADD CONSTRAINT uq_p UNIQUE (price);
ALTER TABLE a_{k} ADD FOREIGN KEY (id) REFERENCES {U} (id), ADD id int, ADD INDEX ix (id), ADD UNIQUE INDEX ux (id);
""",
    5: """CREATE UNIQUE INDEX ux_{T} ON app.{T} USING btree (id, code DESC);
CREATE INDEX ix_{T} ON {T} (status);
CREATE TABLE c_{k} AS SELECT * FROM {T};
""",
    6: """INSERT INTO {T} (id, userName, memo) VALUES (1, 'a, b', 'x');
insert into log_{k} (id, msg) values (2, 'done');
create view v_{k} as select {T}.id, userName as who, {U}.* from {T}, {U};
""",
    7: """SELECT a.id, b.userName FROM {T} a INNER JOIN {U} AS b ON a.id = b.id WHERE a.status = 'v' AND b.price >= 10 AND a.kind < b.kind;

select a.code from {V} as a left join {T} b on (a.code = b.code) left outer join {U} c on c.id = b.id where 3 < c.kind or b.nosuch = a.id
""",
    8: """SELECT userName, COUNT(id) AS n, max(price) from {TU} GROUP BY userName;

select status st, Sum(price) total FROM {T} where kind = 3 group by st union all select code, count(*) from {U} group by code
""",
    9: """select x.id, y.n from {T} x join (select id as rid, kind, count(id) as n from {U} where kind > 2 group by id, kind) y on x.id = y.rid and y.kind <= x.kind
  \t
select * from {T} (nolock), {U} where {T}.id (+) = {U}.id and {T}.code <> {U}.code and userName = note;
select t.price from {T} t where exists (select 1 from {U} u where u.id = t.id and u.status in ('a', 'b'));
with w (rid, amount) as (select u.id, u.price from {U} u where u.kind = 4), deep as (select z.rid as zid from (select id as rid, code from {T} where code = 'c') z where z.rid > 0)
select w.amount, t.note from {T} t join w on t.id = w.rid right join deep d on d.zid = t.id;
with recursive r as (select id, kind from {U} union all select c.id, c.kind from {U} c join r on c.kind = r.id) select r.id from r full join {T} x on x.id == r.id;
select extract(year from f(g(h(j(t.created_at))))) as y, t.note from {T} t join {U} u on u.id (-) = t.id and u.kind >= current_date where (t.status = 'x');
""",
}


def _segments(template: str) -> list[str]:
    return [s for s in re.split(r"(\{\w+\})", template) if s]


def _text(template: str) -> Column:
    return F.concat(*[F.col(s[1:-1]) if s.startswith("{") else F.lit(s)
                      for s in _segments(template)])


def corpus(spark: SparkSession, sf_dir: str, extra: tuple = ()) -> DataFrame:
    """Scripts table with one file per part. `extra` keeps name columns."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return _scripts(spark, sf_dir, part, extra)


def large_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts table with one file per lineitem row, from the same templates."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p_partkey"),
        F.col("l_quantity").cast("int").alias("p_size"))
    return _scripts(spark, sf_dir, line, ())


def _scripts(spark: SparkSession, sf_dir: str, keys: DataFrame, extra: tuple) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    cores = spark.sparkContext.defaultParallelism
    if keys.rdd.getNumPartitions() < cores:
        # A small input is one file; spread its keys before any text is made.
        keys = keys.repartition(cores, "p_partkey")
    n = supplier.agg(F.count("*")).scalar()
    named = (keys.withColumn("n", n)
             .withColumn("s_suppkey", F.col("p_partkey") % F.col("n"))
             .withColumn("num", F.floor(F.col("p_partkey") / F.col("n")))
             .withColumn("k", (F.col("num") % 7).cast("string"))
             .withColumn("T", F.concat(F.lit("t_"), "k"))
             .withColumn("U", F.concat(F.lit("t_"), ((F.col("num") + 1) % 7).cast("string")))
             .withColumn("V", F.concat(F.lit("t_"), ((F.col("num") + 4) % 9).cast("string")))
             .withColumn("TU", F.upper("T")).withColumn("tpl", F.col("p_size") % 10))
    text = F.lit(None).cast("string")
    for number, template in TEMPLATES.items():
        text = F.when(F.col("tpl") == number, _text(template)).otherwise(text)
    repo = F.concat(F.lit("https://example.org/"), "user", F.lit("/"), "repo_name")
    return (named.join(supplier, "s_suppkey")
            .withColumn("user", F.concat(F.lit("user"), F.col("s_nationkey").cast("string")))
            .withColumn("repo_name", F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")))
            .withColumn("repo_url", repo)
            .withColumn("file_id", F.concat(F.col("p_partkey").cast("string"), F.lit(".sql")))
            .withColumn("raw_url", F.concat("repo_url", F.lit("/raw/"), "file_id"))
            .select("repo_url", "user", "repo_name", "file_id", "raw_url", text.alias("text"), *extra))


def _sql_text(template: str) -> str:
    return " || ".join(
        f'f."{s[1:-1]}"' if s.startswith("{") else "'" + s.replace("'", "''") + "'"
        for s in _segments(template))


def corpus_sql() -> str:
    """The same corpus as DuckDB common table expressions: files (names) and scripts (texts)."""
    cases = "\n".join(f"WHEN {number} THEN {_sql_text(t)}" for number, t in TEMPLATES.items())
    return f"""
    files AS (
      SELECT 'https://example.org/user' || s_nationkey || '/repo' || s_suppkey AS repo_url,
             'user' || s_nationkey AS "user", 'repo' || s_suppkey AS repo_name,
             p_partkey || '.sql' AS file_id, p_size % 10 AS tpl,
             CAST(num % 7 AS VARCHAR) AS "k", 't_' || (num % 7) AS "T",
             't_' || ((num + 1) % 7) AS "U", 't_' || ((num + 4) % 9) AS "V",
             'T_' || (num % 7) AS "TU"
      FROM (SELECT p_partkey, p_size, p_partkey % n AS sk, p_partkey // n AS num
            FROM part, (SELECT count(*) AS n FROM supplier)) p
      JOIN supplier ON s_suppkey = sk),
    scripts AS (
      SELECT f.repo_url, f."user", f.repo_name, f.file_id,
             f.repo_url || '/raw/' || f.file_id AS raw_url,
             CASE f.tpl {cases} END AS text
      FROM files f)"""
