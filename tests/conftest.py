import os
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptlode.operators import catalog as C, query_facts as QF, statements as S  # noqa: E402
from scriptlode.session import tune  # noqa: E402

SCRIPTS = "repo_url string, user string, repo_name string, file_id string, raw_url string, text string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


def make_scripts(spark, texts, repo="https://example.org/u1/r1"):
    """Scripts table from {file_id: text}, or from (repo, file_id, text) rows."""
    rows = texts if isinstance(texts, list) else [(repo, f, t) for f, t in texts.items()]
    return spark.createDataFrame(
        [(r, r.split("/")[-2], r.split("/")[-1], f, f"{r}/raw/{f}", t) for r, f, t in rows], SCRIPTS)


def catalog_of(spark, texts):
    return C.build_catalog(S.statements(make_scripts(spark, texts)))


def facts_of(spark, texts):
    scripts = make_scripts(spark, texts)
    return QF.build_query_facts(S.query_statements(scripts), C.build_catalog(S.statements(scripts)))


def listed(df, *cols):
    """Sorted rows as tuples, lists joined by commas."""
    out = []
    for name in cols:
        c = F.col(name)
        out.append(F.concat_ws(",", c) if df.schema[name].dataType.typeName() == "array" else c)
    return sorted((tuple(r) for r in df.select(*out).collect()), key=repr)
