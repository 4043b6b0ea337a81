"""Benchmark: extraction of the derived corpus and the reports on it, in seconds.

Reads $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS] and prints one JSON line. The first run of
an operator includes the start-up of the JVM's compiler; nothing is warmed up beforehand.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from scriptlode.operators import catalog as C, ddl as D, query_facts as QF, scopes as Q, statements as S
from scriptlode.plans import queries as P
from scriptlode.session import tune
from scriptlode.sources.corpus import corpus, large_corpus

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Reports and exports over the written fact tables.
REPORTS = ["d2_dropped_versions", "d4_resolve_table", "d7_foreign_keys", "d9_base_types", "d12_nearest_names",
           "e10_binary_joins", "e12_projections", "f1_corpus_stats", "f2_type_frequency", "f3_missing_in_user",
           "f7_fk_join_overlap", "f8_dup_clusters", "f10_training_stats", "f12_extraction_counts", "g1_label_rows",
           "g2_training_csv", "g4_table_view", "g4_query_view"]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = tune(SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
                 .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
                 .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    scripts = corpus(spark, SF)
    timed("statements", lambda: drain(S.statements(scripts)))
    timed("create_facts", lambda: drain(D.create_facts(S.statements(scripts))))
    timed("scope_parts", lambda: drain(Q.scope_parts(Q.scopes(S.query_statements(scripts)))))
    catalog = timed("build_catalog", lambda: C.build_catalog(S.statements(scripts)))
    facts = timed("build_query_facts", lambda: QF.build_query_facts(S.query_statements(scripts), catalog))
    app = spark.sparkContext.applicationId
    P._BUILT[(app, SF, "catalog")], P._BUILT[(app, SF, "queries")] = catalog, facts
    registered = P.all_queries()
    for name in REPORTS:
        timed(name, lambda name=name: drain(registered[name](spark, SF)))

    # One script per lineitem row: statements per second at a heavier load.
    big = large_corpus(spark, SF)
    timed("large_statements", lambda: drain(S.statements(big)))
    timed("large_create_facts", lambda: drain(D.create_facts(S.statements(big))))
    timed("large_query_scopes", lambda: drain(Q.scopes(S.query_statements(big))))
    big_catalog = timed("large_build_catalog", lambda: C.build_catalog(S.statements(big)))
    big_facts = timed("large_build_query_facts",
                      lambda: QF.build_query_facts(S.query_statements(big), big_catalog))
    n_statements = S.statements(big).count()
    n_queries = big_facts.statements.count()
    print(json.dumps({
        "metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
        "ddl_statements_per_sec": round(n_statements / times["large_build_catalog"]),
        "query_statements_per_sec": round(n_queries / times["large_build_query_facts"])}))
    spark.stop()


if __name__ == "__main__":
    main()
